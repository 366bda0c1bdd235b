"""Sequence analytics on Spark: word tables, class models, votes, taxonomy."""
