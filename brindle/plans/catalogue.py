"""Registered queries of the retrieval engine."""

from brindle.plans import corpus, ranking, search, units

QUERIES: dict = {**search.QUERIES, **corpus.QUERIES, **ranking.QUERIES, **units.QUERIES}
ORACLE_SQL: dict = {**search.ORACLE_SQL, **corpus.ORACLE_SQL, **ranking.ORACLE_SQL, **units.ORACLE_SQL}
