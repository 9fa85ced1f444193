"""Registered queries, and the SQL that states them again."""

from . import catalogue, connectors, oracles, parts

QUERIES = catalogue.QUERIES | connectors.QUERIES | parts.QUERIES
ORACLES = oracles.ORACLES | connectors.ORACLES | parts.ORACLES
