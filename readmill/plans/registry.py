"""Every registered query with the SQL it is held against."""

from readmill.plans import read_queries, set_queries

QUERIES: dict = {**read_queries.QUERIES, **set_queries.QUERIES}
ORACLES: dict = {**read_queries.ORACLES, **set_queries.ORACLES}
