"""arborql: symbol-graph and document-corpus analytics on Spark DataFrames."""
