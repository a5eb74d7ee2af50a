"""Collects queries and oracles."""

from __future__ import annotations

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` and, if SQL can state its
    result, the oracle."""

    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register
