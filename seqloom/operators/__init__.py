"""Relational building blocks: word tables, models, votes, taxonomy."""
