"""Applied analytics operators for Spark DataFrames."""
