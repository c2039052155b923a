"""Grid-reliability analytics as lazy Spark DataFrames."""
