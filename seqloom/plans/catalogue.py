"""All queries of the library by name, with the SQL that states the same rows."""

from . import classes, formats, numerics, taxa, words

PARTS = (words, classes, taxa, formats, numerics)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
