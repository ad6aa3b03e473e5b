"""Panel factor analytics on PySpark."""
