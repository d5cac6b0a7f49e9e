"""Similarity scoring on Spark: features, exact and clustered nearest-neighbour search, evaluation."""
