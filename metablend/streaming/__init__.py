"""Streaming: the reference has no streams.  Scoring with a fitted tree
table is a narrow projection (bins from fixed cuts, literal-map tree walk),
so the batch scorer applies unchanged to a streaming DataFrame."""

from metablend.streaming.scoring import score_stream

__all__ = ["score_stream"]
