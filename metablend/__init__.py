"""metablend — Spark-native tabular ensemble and meta-learning engine.

Rows get a deterministic key, split and fold; features are scaled and binned
with plain DataFrame aggregation; tree ensembles grow by distributed histogram
aggregation; out-of-fold and fold-averaged probability tables feed a
meta-learner; metrics and two-source fidelity statistics are tables.
"""

from metablend.session import ensure_checkpoint_dir, local_session

__all__ = ["ensure_checkpoint_dir", "local_session"]
