"""Workload, plan and pool files: lines of fields between `#####`. Files are read and written by Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SEPARATOR = "#####"


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, sql) of lines `id#####sql`; blank lines are skipped."""
    parts = F.split("value", SEPARATOR)
    return spark.read.text(path).where(F.trim("value") != "").select(F.try_to_number(F.trim(parts[0]), F.lit("999999999999999999")).cast("long").alias("query_id"), F.trim(F.get(parts, F.lit(1))).alias("sql"))


def write_pool(queries: DataFrame, path: str) -> None:
    """Lines `id#####sql` of (query_id, sql)."""
    queries.select(F.concat_ws(SEPARATOR, F.col("query_id").cast("string"), "sql").alias("value")).write.text(path)


def read_plan_sets(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, cand_id, plan_json) of lines `id#####plan#####plan...`."""
    parts = F.split(F.trim("value"), SEPARATOR)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.trim(parts[0]).alias("query_id"), F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("cand_id", "plan_json"))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, cand_id, plan_json) of lines `plan#####plan...`: the training form, without ids.

    A line's hash stands for its id; a line that stands there several times is one query for each time, `hash-1` and so on."""
    lines = spark.read.text(path).where(F.trim("value") != "").groupBy("value").agg(F.count("*").alias("n"))
    each = lines.select("value", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("time"))
    name = F.concat(F.xxhash64("value").cast("string"), F.when(F.col("time") > 0, F.concat(F.lit("-"), F.col("time").cast("string"))).otherwise(""))
    return each.select(name.alias("query_id"), F.posexplode(F.split(F.trim("value"), SEPARATOR)).alias("cand_id", "plan_json"))


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """(plan_json): one plan a line."""
    return spark.read.text(path).select(F.trim("value").alias("plan_json")).where("plan_json <> ''")


def write_training(spark: SparkSession, source: str, path: str) -> None:
    """Plan sets without their ids."""
    parts = F.split(F.trim("value"), SEPARATOR)
    spark.read.text(source).where(F.trim("value") != "").select(F.concat_ws(SEPARATOR, F.slice(parts, F.lit(2), F.size(parts))).alias("value")).write.text(path)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at `path`, computed and written by `build()` if it is not there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_result(chosen: DataFrame, path: str) -> None:
    """Chosen latencies by query and a last row `sum`, as JSON lines."""
    rows = chosen.select(F.col("query_id").cast("string").alias("query"), F.col("latency").cast("double").alias("seconds"))
    rows.unionByName(rows.agg(F.lit("sum").alias("query"), F.sum("seconds").alias("seconds"))).coalesce(1).write.json(path)


def append_latency(spark: SparkSession, path: str, batch: int, total: float) -> None:
    """Add a batch's total latency in seconds to the series at `path`; a batch that is there already is replaced."""
    spark.createDataFrame([(float(total),)], "total double").coalesce(1).write.mode("overwrite").json(f"{path}/batch={batch}")


def read_latencies(spark: SparkSession, path: str) -> DataFrame:
    """(batch, total) of a series of batches."""
    return spark.read.schema("total double, batch int").json(path).select("batch", "total")


def read_jdbc(spark: SparkSession, url: str, name: str, user: str, password: str, **options: str) -> DataFrame:
    """A table of an external database, for workloads whose tables live there."""
    return spark.read.jdbc(url, name, properties={"user": user, "password": password, **options})


