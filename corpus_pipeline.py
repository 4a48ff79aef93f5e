"""A training corpus from raw documents: quality rules, toxicity, near-duplicates, benchmark decontamination, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the columns of `documents`.
Stages decide row by row (a filter on the text, no shuffle of it) but for near-duplicates, which keep one document of each group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, common, decontaminate, quality, toxicity, wide_simhash
from quarry.session import discard, table, written

#: Words of a benchmark item from which a document that holds it goes: a word or two of one are in any text.
REJECT_WORDS = 5


def fresh(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list; rows of null or few words go."""
    rules = quality.learned(written(quality.statistics(docs), "pipeline-quality"), table(spark, sf_dir, "labels"))
    names = [x.split()[0] for x in quality.SCHEMA.split(", ")][1:]
    kinds = [x.split()[1] for x in quality.SCHEMA.split(", ")][1:]

    @F.arrow_udf("struct<" + ",".join(f"{n}:{k}" for n, k in zip(names, kinds)) + ">")
    def measured(text: pa.Array) -> pa.Array:
        columns = list(zip(*(quality.measure(x.as_py()) for x in text))) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.float64()) for c, k in zip(columns, kinds)], names=names)

    common.bounded(spark)
    own = fresh(docs, "stats")
    stats = docs.withColumn(own, measured("text"))
    of = lambda name: F.col(own)[name]
    return stats.where(~quality.base_failed(of) & quality.verdict(rules, of)).drop(own)


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the model learns from labelled documents of this input."""
    model = spark.sparkContext.broadcast(toxicity.train(docs, table(spark, sf_dir, "labels")))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(toxicity.scorer(model.value).score(text.to_pylist()), pa.float64())

    common.bounded(spark)
    return docs.where(score("text") < 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of a similarity of 0.8 or more on five-word shingles.

    Rows with equal ids and texts are one document; rows without an id are all kept."""
    first = wide_simhash.duplicate_groups(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    text = fresh(docs, "text_hash")
    rows = docs.join(first, "doc_id", "left_semi").withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))


def benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of REJECT_WORDS words or more, at most a fifth of its words edited."""
    common.bounded(spark)
    for index in decontaminate.indexes(table(spark, sf_dir, "benchmark"), min_words=REJECT_WORDS):
        docs = docs.where(~_holds(spark.sparkContext.broadcast(index))("text"))
    return docs


def _holds(index: Broadcast):
    @F.arrow_udf("boolean")
    def holds(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        out[[x for x, *_ in decontaminate.search(text.to_pylist(), index.value)]] = True
        return pa.array(out)

    return holds


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document."""
    return bpe.encoded(docs, bpe.vocabulary(spark), ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_texts),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_texts),
    ("bpe", token_ids),
]

#: Learned rules and models, fingerprints' components, edit distances and token ids are not SQL: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet, read by the next and then deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)
        docs = kept
    return docs
