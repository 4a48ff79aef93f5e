"""Sharding by a two-pass external shuffle: every order of the rows is as likely as any other, shard sizes differ by one at most.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash of the whole row. Pass two reads one bucket at a time
into memory, shuffles it by Fisher-Yates with a generator seeded by bucket, and writes it. Buckets in order make up one
global order; shards are its equal parts, so a shard's rows differ in number by one at most, and a row's slot is its place
in the shard. Buckets know where they begin from a count of hashes alone.

Rows that are equal in every column share a hash. Where they are more than HEAVY of a bucket, they are scattered by number: one of
them and their count are what is left of them after a partial aggregation, and the copies are made again in blocks, each hashed
with its number. So no bucket grows with a group of copies, and results depend on the rows alone.

Inputs: null and empty texts are rows like any other (size 8), and so are rows without an id. Groups of copies spread over all
shards. Within a bucket the order before shuffling is fixed by the rows' hash, so results are the same for any partitioning of the
input. Empty tables give no rows. Columns called shard or slot are replaced; any other name may stand in the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import arrow_map, documents
from quarry.session import written

#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 32_000_000
#: Share of a bucket's bytes from which equal rows are scattered by number, and copies made again at once.
HEAVY, BLOCK = 0.25, 1000


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A seeded permutation of 0..n-1: place i, from the last down, swaps with one drawn from 0..i."""
    order = list(range(n))
    draws = np.random.Generator(np.random.PCG64(seed)).random(max(0, n - 1))
    for i, u in zip(range(n - 1, 0, -1), draws.tolist()):
        j = int(u * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def edges(rows: int, shards: int) -> np.ndarray:
    """First global place of each shard, and the number of rows."""
    return np.array([rows * s // shards for s in range(shards + 1)], np.int64)


def _fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with a mark in front of each that is taken."""
    out = []
    for name in names:
        while name.lower() in map(str.lower, taken):
            name = f"_{name}"
        out.append(name)
    return out


def _hash(df: DataFrame, seed: int) -> Column:
    """A hash of every column; what has no hash of its own (maps, variants) by its JSON."""
    columns = [F.to_json(F.struct(f.name)) if re.search("map<|variant", f.dataType.simpleString()) else F.col(f.name) for f in df.schema.fields]
    return F.xxhash64(F.lit(seed), *columns)


def shuffled(df: DataFrame, shards: int, seed: int = 0, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`df` with shard and slot, in the global order bucket by bucket."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    one, two, bucket, number, row = _fresh([*df.columns, "size"], "one", "two", "bucket", "number", "row")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 8
    hashed = df.withColumns({one: _hash(df, seed), two: _hash(df, seed + 1)})
    each = written(hashed.groupBy(one, two).agg(F.count("*").alias(number), F.sum(size).alias("size")), "shard-hashes")
    total = each.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    large = HEAVY * min(bucket_bytes, max(total // n, 1 << 20))
    heavy = each.where(F.col("size") > large).select(one, two, number).collect()  # at most 1 / HEAVY rows a bucket
    place = F.pmod(F.xxhash64(F.lit(seed), one, two), F.lit(n)).cast("int")
    counts = np.zeros(n, np.int64)
    if heavy:
        few = F.broadcast(spark.createDataFrame(heavy, f"{one} long, {two} long, {number} long"))
        inside = hashed.join(few.drop(number), [one, two], "left_semi").groupBy(one, two).agg(F.first(F.struct(*df.columns)).alias(row))
        blocks = inside.join(few, [one, two]).withColumn(bucket, F.explode(F.sequence(F.lit(0), ((F.col(number) - 1) / BLOCK).cast("long"))))
        blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), one, two, bucket)
        copies = F.explode(F.sequence(F.col(bucket) * BLOCK, F.least((F.col(bucket) + 1) * BLOCK, number) - 1))
        by_number = F.pmod(F.xxhash64(F.lit(seed), one, two, number), F.lit(n)).cast("int")
        blocks = blocks.select(row, one, two, copies.alias(number))
        scattered = hashed.join(few, [one, two], "left_anti").withColumn(bucket, place).unionByName(blocks.select(f"{row}.*", one, two, by_number.alias(bucket)))
        spread = blocks.select(by_number.alias(bucket)).groupBy(bucket).count().collect()
        each = each.join(few, [one, two], "left_anti")
    else:
        scattered, spread = hashed.withColumn(bucket, place), []
    # a row a bucket: 16 bytes for bucket_bytes of text
    for b, held in [*each.select(place.alias(bucket), number).groupBy(bucket).agg(F.sum(number)).collect(), *spread]:
        counts[b] += held
    first = np.concatenate(([0], np.cumsum(counts)))
    cuts = edges(int(first[-1]), shards)
    shared = spark.sparkContext.broadcast((first, cuts))
    fields = df.schema.fields
    schema = StructType([*fields, StructField("shard", LongType()), StructField("slot", LongType())])
    width = len(fields)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, cuts = shared.value

        def deal(held: list[pa.RecordBatch], b: int) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            order = fisher_yates(rows.num_rows, (seed << 32) ^ b)
            for lo in range(0, rows.num_rows, 1000):
                some = rows.take(pa.array(order[lo : lo + 1000])).combine_chunks()
                place = first[b] + lo + np.arange(some.num_rows)
                shard = np.searchsorted(cuts, place, "right") - 1
                for batch in some.to_batches():
                    yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(shard), pa.array(place - cuts[shard])], [f.name for f in schema.fields])

        held: list[pa.RecordBatch] = []
        now = -1
        for batch in it:
            which = batch.column(width).to_numpy()
            steps = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)]
            for lo, hi in zip(steps, steps[1:]):
                if lo == hi:
                    continue
                if held and which[lo] != now:
                    yield from deal(held, now)
                    held = []
                now = int(which[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from deal(held, now)

    scattered = scattered.repartitionById(n, bucket).sortWithinPartitions(bucket, one, two)
    return arrow_map(scattered.select(*df.columns, bucket), batches, schema)


def sharded(df: DataFrame, shards: int, seed: int = 0, **kw: object) -> DataFrame:
    """`shuffled`, written as a folder for each shard, and read back."""
    return written(shuffled(df, shards, seed, **kw), "shards", partition_by=("shard",))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    rows = sharded(documents(spark, sf_dir), 24)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
