"""All queries of this subpackage, by name."""

from tallyweave.llm import queries, queries_sql

QUERIES = dict(queries.QUERIES)
ORACLES = dict(queries_sql.ORACLES)
