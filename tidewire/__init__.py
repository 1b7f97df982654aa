"""A news-intelligence analytics engine on Spark DataFrames."""
