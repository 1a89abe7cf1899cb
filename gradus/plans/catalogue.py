"""Registered queries and the SQL that each is compared with."""

from . import dedup, extraction, graphs, intake, learner, lookups, models, more, paths, progress, stored, streams, texts, triples

_PARTS = (learner, models, graphs, paths, texts, triples, extraction, dedup, intake, more, progress, stored, lookups, streams)
QUERIES: dict = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict = {k: s for part in _PARTS for k, s in part.SQL.items()}
