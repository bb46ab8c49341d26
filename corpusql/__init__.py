"""corpusql: retrieval over document collections, on PySpark DataFrames."""
