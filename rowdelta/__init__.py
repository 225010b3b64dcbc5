"""Dataset comparison, schema validation and test-pair generation on Spark DataFrames."""
