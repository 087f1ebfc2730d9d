"""coreloom: Spark-first analytics for depth-interval, spatial and text-corpus data."""
