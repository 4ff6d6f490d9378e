"""Panel analytics and strategy back-testing on Spark DataFrames."""
