"""Set-based genetic-interaction analytics, and training-data operators, on Spark DataFrames."""
