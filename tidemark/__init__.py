"""tidemark: market-data analytics as plain PySpark DataFrame functions."""
