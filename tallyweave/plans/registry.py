"""All queries of the core, by name."""

from __future__ import annotations

from functools import wraps

from tallyweave.plans import stream_quality, stream_quality_sql, stream_queries, tally_queries, tally_sql

QUERIES = tally_queries.QUERIES | stream_queries.QUERIES | stream_quality.QUERIES
ORACLES = tally_sql.ORACLES | stream_quality_sql.ORACLES
# Streams have to decide as the batch forms do.
ORACLES |= {"stream_admission": ORACLES["admission_decisions"], "stream_chain": ORACLES["chain"], "stream_p1_counts": ORACLES["p1_window_counts"]}
FLAGSHIP = "tally_all_dimensions"

#: Settings that a query needs of the session it is given.
NEEDED = {"spark.sql.session.timeZone": "UTC"}


def prepared(query):
    """The query with the session settings that it needs."""

    @wraps(query)
    def run(spark, directory):
        for key, value in NEEDED.items():
            spark.conf.set(key, value)
        return query(spark, directory)

    return run
