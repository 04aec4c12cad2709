"""Analytics over dependency-parsed text and word embeddings, on Spark DataFrames."""
