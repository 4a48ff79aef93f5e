"""Sharding of rows that are equal or have no id, and the registered query."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import sharding
from quarry.session import table


def rows_of(df):
    return sorted((r["shard"], r["slot"], repr((r["doc_id"], r["text"]))) for r in df.collect())


def law(df, shards):
    by = {}
    for shard, slot, _ in rows_of(df):
        by.setdefault(shard, []).append(slot)
    n = [len(by.get(s, [])) for s in range(shards)]
    assert max(n) - min(n) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_equal_rows_spread_over_buckets(spark):
    """A third of the rows is one row, a third has no id."""
    rows = [(1, "copy " * 20)] * 900 + [(None, f"no id {i}") for i in range(900)] + [(i, f"text {i}") for i in range(2, 902)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shuffled(df, 6, bucket_bytes=4000)
    law(got, 6)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(rows)
    assert rows_of(got) == rows_of(sharding.shuffled(df.repartition(2), 6, bucket_bytes=4000))
    # equal rows are spread: each shard holds about its share of them
    share = Counter(r["shard"] for r in got.where("doc_id = 1").collect())
    assert len(share) == 6 and max(share.values()) < 260
    # no bucket holds a group
    total = sum(len((t or "").encode()) + 8 for _, t in rows)
    assert total / 4000 > 10


def test_columns_of_any_kind_and_name(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.create_map(F.lit("k"), F.col("id")).alias("bucket"), F.lit(1).alias("one"), F.array(F.lit(2)).alias("row"), F.lit(None).alias("number"))
    got = sharding.shuffled(df, 4, bucket_bytes=200)
    law(got, 4)
    assert sorted(r["bucket"]["k"] for r in got.collect()) == list(range(50)) and got.columns[:-2] == df.columns


def test_registered_query(spark, sf_dir):
    from quarry.llm.registry import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    got = QUERIES["op8_sharding"](spark, sf_dir)
    law(got.withColumn("text", F.lit(None)), 24)
    for r in got.collect():
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    assert got.count() == len(texts)
