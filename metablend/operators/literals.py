"""Array literals built in one JVM call.

``F.lit([...])`` makes one gateway call per element; per-slot parameters
are instead written as one SQL expression that the JVM parses once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fmt(v, t: str) -> str:
    if v is None:
        return "NULL"
    if t == "double":
        return repr(float(v)) + "D" if math.isfinite(v) else f"double('{v}')"
    if t == "boolean":
        return "true" if v else "false"
    if t in ("bigint", "long"):
        return f"{int(v)}L"
    return str(int(v))


def arr_sql(values, t: str = "double") -> str:
    return f"CAST(array({','.join(_fmt(v, t) for v in values)}) AS ARRAY<{t}>)"


def arr(values, t: str = "double") -> Column:
    return F.expr(arr_sql(values, t))
