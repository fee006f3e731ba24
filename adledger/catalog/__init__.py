"""Registered queries over the given tables."""


def load():
    """All registered queries and the SQL they are checked against."""
    from adledger.catalog import (ads_queries, page_queries, state_queries,  # noqa: F401
                                  stream_queries)
    from adledger.catalog.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
