"""Reading and writing delimited text, JSON lines and Parquet."""
