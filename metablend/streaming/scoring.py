"""Score a stream of rows with a fitted ensemble (no state, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from metablend.operators.binning import BinSpec, apply_bins
from metablend.operators.score import score_trees


def score_stream(stream: DataFrame, specs: list[BinSpec], trees: DataFrame, slot: int = 0,
                 combine: str = "sum", init: float = 0.0) -> DataFrame:
    """Bins the incoming rows with the training cuts and walks the stored
    trees; valid for batch and streaming DataFrames alike."""
    return score_trees(apply_bins(stream, specs), trees, slot, combine, init)
