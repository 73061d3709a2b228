"""Files, documents, tables and pixels as Spark DataFrames."""
