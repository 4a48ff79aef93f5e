"""The engine's registered queries: callables on (spark, sf_dir) and the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import predicates, profile, ranking, synth, vectors, workload
from quarry.plans import candidates, ranker, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for module in (predicates, profile, ranking, workload, vectors, synth, tree, ranker, candidates):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
