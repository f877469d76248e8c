"""cairn: incremental document indexing and corpus preparation on PySpark."""
