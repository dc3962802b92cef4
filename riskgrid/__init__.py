"""Table operators for gridded risk mapping on Spark."""
