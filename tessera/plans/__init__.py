"""Registered queries, one module for each group of operators."""

from tessera.plans import catalogue, changes, context, memory, quality, recall, relational, routes, search, structure, upkeep, vectors  # noqa: F401
