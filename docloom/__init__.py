"""docloom: document-collection operators on Spark DataFrames."""
