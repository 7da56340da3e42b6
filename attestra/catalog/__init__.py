"""Registered queries and their SQL twins."""

from attestra.catalog import articles, audit, landed, records, streams, text, work

_PARTS = (text, audit, articles, records, streams, work, landed)

QUERIES = {name: query for part in _PARTS for name, query in part.C.queries.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.C.sql.items()}
