"""cairn: repository-intelligence analytics and training-data preparation on Spark DataFrames."""
