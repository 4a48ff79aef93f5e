"""Candidate pairs, rank scores, choice of candidates and their evaluation.

On the driver's tables a customer stands for a query, its orders for candidate plans, an order's total price for the latency
of the plan and its summed quantity for the score a model would give it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import sigmoid
from quarry.session import table, written


def pairs(cands: DataFrame) -> DataFrame:
    """All pairs i < j of a query's candidates with label 1.0 where the first is no faster: an equi-join on the query."""
    a = cands.select("query_id", F.col("cand_id").alias("cand_a"), F.col("latency").alias("latency_a"))
    b = cands.select("query_id", F.col("cand_id").alias("cand_b"), F.col("latency").alias("latency_b"))
    both = a.join(b, "query_id").where("cand_a < cand_b")
    return both.select("query_id", "cand_a", "cand_b", F.when(F.col("latency_a") >= F.col("latency_b"), 1.0).otherwise(0.0).alias("label"))


def rank_scores(cands: DataFrame) -> DataFrame:
    """Place of each candidate by latency, from 1, ties by candidate, and the scores place ** 2, ** 4 and e ** place."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("latency", "cand_id"))
    out = cands.select("query_id", "cand_id", place.cast("long").alias("place"))
    return out.select("*", F.pow("place", F.lit(2)).alias("square"), F.pow("place", F.lit(4)).alias("fourth"), F.exp("place").alias("exponential"))


def choose(cands: DataFrame) -> DataFrame:
    """The candidate of the least score of each query, the first among equals; map-side combined."""
    return cands.groupBy("query_id").agg(F.min_by(F.struct("cand_id", "latency"), F.struct("score", "cand_id")).alias("x")).select("query_id", "x.cand_id", "x.latency")


def baseline(cands: DataFrame) -> DataFrame:
    """The first candidate of each query: the native optimizer's plan."""
    return cands.groupBy("query_id").agg(F.min_by("latency", "cand_id").alias("latency"), F.min("cand_id").alias("cand_id")).select("query_id", "cand_id", "latency")


def total(chosen: DataFrame) -> DataFrame:
    return chosen.agg(F.count("*").alias("n_queries"), F.round(F.sum("latency"), 2).alias("total"))


def rank_correlation(cands: DataFrame) -> DataFrame:
    """Spearman correlation of score and latency by query, ties at their average rank; null where either is constant."""
    w = Window.partitionBy("query_id")

    def rank(c: str):
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("query_id", c)) - 1) / F.lit(2.0)

    r = cands.select("query_id", rank("score").alias("x"), rank("latency").alias("y"))
    sums = r.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    vx, vy = F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    return sums.select("query_id", F.expr("n * sxy - sx * sy").alias("c"), vx.alias("vx"), vy.alias("vy")).select("query_id", F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.try_divide("c", F.sqrt(F.col("vx") * F.col("vy")))).alias("rho"))


def ranking_loss(cands: DataFrame) -> DataFrame:
    """1 - the mean correlation; queries without one are skipped. No queries: null."""
    return rank_correlation(cands).agg(F.round(1 - F.avg("rho"), 6).alias("ranking_loss"), F.count("rho").alias("n_queries"))


def numbered(df: DataFrame, *keys: str, name: str = "number") -> DataFrame:
    """`df` with consecutive numbers from 0 in the order of `keys`, which tell rows apart: ranges are sorted side by side, and a row a range says where it begins."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(width, *keys).withColumn("_range", F.spark_partition_id()), "numbered")
    before, starts = 0, []
    for r in sorted(ranged.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        starts.append((r["_range"], before))
        before += r["count"]
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "_range int, _first long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1 + F.col("_first")
    return ranged.join(first, "_range").withColumn(name, place).drop("_range", "_first")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, cand_id, latency, score) of the customers' orders."""
    score = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("score"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("cand_id"), F.col("o_totalprice").alias("latency"))
    return orders.join(score, orders.cand_id == score.l_orderkey, "left").select("query_id", "cand_id", "latency", F.coalesce("score", F.lit(0.0)).alias("score"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("cand_id"), F.col("o_totalprice").alias("latency"))


def _rounded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rank_scores(_orders(spark, sf_dir))
    return out.select("query_id", "cand_id", "place", "square", "fourth", F.round(F.log10("exponential"), 6).alias("log_exponential"))


def pair_probability(cands: DataFrame) -> DataFrame:
    """(query_id, cand_a, cand_b, probability): by the scores, that the first of two candidates is no faster."""
    a = cands.select("query_id", F.col("cand_id").alias("cand_a"), F.col("score").alias("score_a"))
    b = cands.select("query_id", F.col("cand_id").alias("cand_b"), F.col("score").alias("score_b"))
    return a.join(b, "query_id").where("cand_a < cand_b").select("query_id", "cand_a", "cand_b", sigmoid(F.col("score_a") - F.col("score_b")).alias("probability"))


QUERIES = {
    "pair_probability": lambda s, d: pair_probability(candidates(s, d)).withColumn("probability", F.round("probability", 6) + 0.0),
    "order_numbers": lambda s, d: numbered(table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "number"),
    "candidate_pairs": lambda s, d: pairs(_orders(s, d)),
    "rank_scores": _rounded_scores,
    "plan_choice_argmin": lambda s, d: choose(candidates(s, d)),
    "baseline_choice": lambda s, d: baseline(_orders(s, d)),
    "total_latency": lambda s, d: total(choose(candidates(s, d))),
    "spearman_ranking_loss": lambda s, d: ranking_loss(candidates(s, d)),
    "query_rank_correlation": lambda s, d: rank_correlation(candidates(s, d)).select("query_id", (F.round("rho", 6) + 0.0).alias("rho")),
}

_CANDS = "SELECT o_custkey AS query_id, o_orderkey AS cand_id, o_totalprice AS latency, COALESCE(score, 0.0) AS score FROM orders LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS score FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"
_CHOSEN = f"SELECT query_id, cand_id, latency FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score, cand_id) AS k FROM ({_CANDS})) WHERE k = 1"
_RHO = f"""WITH r AS (SELECT query_id, RANK() OVER (PARTITION BY query_id ORDER BY score) + (COUNT(*) OVER (PARTITION BY query_id, score) - 1) / 2.0 AS x,
    RANK() OVER (PARTITION BY query_id ORDER BY latency) + (COUNT(*) OVER (PARTITION BY query_id, latency) - 1) / 2.0 AS y FROM ({_CANDS}))
    SELECT query_id, CASE WHEN MIN(x) < MAX(x) AND MIN(y) < MAX(y) THEN CORR(x, y) END AS rho FROM r GROUP BY query_id"""
ORACLE_SQL = {
    "pair_probability": f"WITH c AS ({_CANDS}) SELECT query_id, a.cand_id AS cand_a, b.cand_id AS cand_b, ROUND(1 / (1 + EXP(b.score - a.score)), 6) + 0.0::DOUBLE AS probability FROM c a JOIN c b USING (query_id) WHERE a.cand_id < b.cand_id",
    "order_numbers": "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS number FROM orders",
    "candidate_pairs": "SELECT a.o_custkey AS query_id, a.o_orderkey AS cand_a, b.o_orderkey AS cand_b, CASE WHEN a.o_totalprice >= b.o_totalprice THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey",
    "rank_scores": "SELECT query_id, cand_id, place, POW(place, 2) AS square, POW(place, 4) AS fourth, ROUND(LOG10(EXP(place)), 6) AS log_exponential FROM (SELECT o_custkey AS query_id, o_orderkey AS cand_id, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS place FROM orders)",
    "plan_choice_argmin": _CHOSEN,
    "baseline_choice": "SELECT o_custkey AS query_id, MIN(o_orderkey) AS cand_id, ARG_MIN(o_totalprice, o_orderkey) AS latency FROM orders GROUP BY o_custkey",
    "total_latency": f"SELECT COUNT(*) AS n_queries, ROUND(SUM(latency), 2) AS total FROM ({_CHOSEN})",
    "spearman_ranking_loss": f"SELECT ROUND(1 - AVG(rho), 6) AS ranking_loss, COUNT(rho) AS n_queries FROM ({_RHO})",
    "query_rank_correlation": f"SELECT query_id, ROUND(rho, 6) + 0.0::DOUBLE AS rho FROM ({_RHO})",
}
