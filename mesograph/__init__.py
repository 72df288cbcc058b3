"""Graph analytics on DataFrames: fix-point queries, binary graph files, locality metrics."""
