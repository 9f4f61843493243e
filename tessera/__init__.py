"""Panel analytics on Spark: point-in-time panels, quality rules, forward targets, factor primitives."""
