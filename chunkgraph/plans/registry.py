"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkgraph.plans import codegraph, corpus, evaluation, lines, stored
from chunkgraph.plans.oracles import ORACLES

_MODULES = (codegraph, corpus, lines, evaluation, stored)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for mod in _MODULES:
        out.update(mod.QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    q = all_queries()
    return {k: v for k, v in ORACLES.items() if k in q}
