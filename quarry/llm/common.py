"""What the corpus operators share: Arrow batches, word splitting, unsigned hashes and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import discard, ship, table, written

#: Rows of an Arrow batch sent to Python: with texts of up to a few hundred KB a batch stays within tens of MB.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def bounded(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python functions planned from now on; executors get the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches."""
    bounded(df.sparkSession)
    return df.mapInArrow(fn, schema)


def _state(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free hash: equal when nothing moved."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"] or 0


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a long, b long) as (id, component), component the smallest id.

    Alternates large-star and small-star steps until the stars stop changing; every step is a shuffle on the node
    with the neighbourhood's minimum as a window-free aggregate, so no neighbourhood is gathered in one row. The join of a star's
    links with its one minimum is one that Spark splits where a star is large (skewJoin). Each round is written to the shared folder,
    and the one before it deleted. Null ends and self links are ignored; an empty input gives no rows.
    """
    cur = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    state = _state(cur)
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours greater than the node go to its minimum
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the node and its smaller neighbours go to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = written(small.where("a <> b").distinct(), f"{name}-stars")
        mark, state = state, _state(new)
        discard(cur)
        cur = new
        if state == mark:
            return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
