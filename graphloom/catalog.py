"""Every registered query by name, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from graphloom.operators import aggregates, cards, code, communities, decks, graph, groups, health, learning, modules, neighborhood, ranking, resolution, rollups, rules, speech, strings, text, timeline, vectors
from graphloom.registry import ORACLE_SQL, QUERIES
from graphloom.streaming import jobs

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "cards", "code", "communities", "decks", "graph", "groups", "health", "jobs", "learning", "modules", "neighborhood", "ranking", "resolution", "rollups", "rules", "speech", "strings", "text", "timeline", "vectors"]
