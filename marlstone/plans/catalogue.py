"""Registry of the library's queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans import audits, changes, entities, facts, market, pages, people, serving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (market, changes, entities, people, pages, serving, facts, audits):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
