"""Web-capture analytics and training-data preparation on Spark DataFrames."""
