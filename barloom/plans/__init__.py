"""Expressions: parsing, compiling to Spark, and SQL for comparison."""
