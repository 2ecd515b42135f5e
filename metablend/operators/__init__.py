"""Operators: keys/splits/folds, scaling, binning, prefix sums, learners, search, meta."""
