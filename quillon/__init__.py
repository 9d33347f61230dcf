"""quillon: retrieval and document-understanding analytics on Spark DataFrames."""
