"""quillspan: full-text indexing, ranking and corpus data processing on Spark DataFrames."""
