from metablend.sources.carriers import (
    DOC_CATEGORICAL, DOC_CONTINUOUS, DOC_FEATURES, LINE_CONTINUOUS, doc_quality, lineitem_return,
    orders_status,
)
from metablend.sources.tables import normalise_names, read_csv_typed, read_table

__all__ = [
    "normalise_names", "read_csv_typed", "read_table", "doc_quality", "lineitem_return",
    "orders_status", "DOC_FEATURES", "DOC_CONTINUOUS", "DOC_CATEGORICAL", "LINE_CONTINUOUS",
]
