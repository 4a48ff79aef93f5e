"""Select-project-join counts and the predicate forms workloads use, run as SQL text on the session's views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import register, table

#: The same text runs on Spark and on the oracle, but for the cyclic join, which Spark gets in another order (`spj_cyclic_join`).
SPJ: dict[str, tuple[tuple[str, ...], str]] = {
    "spj_count_2way": (("orders", "lineitem"), "SELECT COUNT(*) AS n FROM orders o, lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 10 AND o.o_totalprice < 150000"),
    "spj_count_4way": (
        ("customer", "nation", "orders", "lineitem"),
        "SELECT COUNT(*) AS n FROM customer c, nation n, orders o, lineitem l WHERE c.c_nationkey = n.n_nationkey AND o.o_custkey = c.c_custkey AND l.l_orderkey = o.o_orderkey AND l.l_quantity >= 25 AND o.o_totalprice < 200000 AND c.c_mktsegment != 'BUILDING'",
    ),
    "spj_cyclic_join": (
        ("customer", "supplier", "orders", "lineitem"),
        "SELECT COUNT(*) AS n FROM customer c, supplier s, orders o, lineitem l WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_suppkey = s.s_suppkey AND s.s_nationkey = c.c_nationkey",
    ),
    "self_join_alias": (
        ("nation", "customer", "supplier", "orders", "lineitem"),
        "SELECT n1.n_name AS customer_nation, n2.n_name AS supplier_nation, COUNT(*) AS n FROM nation n1, nation n2, customer c, supplier s, orders o, lineitem l WHERE c.c_nationkey = n1.n_nationkey AND s.s_nationkey = n2.n_nationkey AND o.o_custkey = c.c_custkey AND l.l_orderkey = o.o_orderkey AND l.l_suppkey = s.s_suppkey AND n1.n_regionkey = 1 GROUP BY n1.n_name, n2.n_name",
    ),
    "spj_min_select": (("orders", "customer"), "SELECT MIN(c.c_name) AS first_customer, MIN(o.o_totalprice) AS least_total FROM customer AS c, orders AS o WHERE c.c_custkey = o.o_custkey AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "pred_numeric_ops": (
        ("lineitem",),
        "SELECT 'eq' AS op, COUNT(*) AS n FROM lineitem WHERE l_quantity = 10 UNION ALL SELECT 'ne', COUNT(*) FROM lineitem WHERE l_quantity != 10 UNION ALL SELECT 'gt', COUNT(*) FROM lineitem WHERE l_quantity > 10 UNION ALL SELECT 'lt', COUNT(*) FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT 'ge', COUNT(*) FROM lineitem WHERE l_quantity >= 10 UNION ALL SELECT 'le', COUNT(*) FROM lineitem WHERE l_quantity <= 10",
    ),
    "pred_string_eq": (("customer",), "SELECT 'eq' AS op, COUNT(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'ne', COUNT(*) FROM customer WHERE c_mktsegment != 'BUILDING'"),
    "pred_like": (("part",), "SELECT p_brand, COUNT(*) AS n FROM part WHERE p_type LIKE '%EC%' OR p_name LIKE '%re%' GROUP BY p_brand"),
    "pred_in": (("orders",), "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY o_orderstatus"),
    "pred_between": (("part",), "SELECT COUNT(*) AS n, MIN(p_retailprice) AS least, MAX(p_retailprice) AS most FROM part WHERE p_size BETWEEN 5 AND 15"),
    "pred_or_not": (("orders",), "SELECT COUNT(*) AS n FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT (o_orderpriority = '5-LOW')"),
    "pred_is_null": (
        ("orders", "customer"),
        "SELECT 'null' AS kind, COUNT(*) AS n FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 WHERE c.c_custkey IS NULL UNION ALL SELECT 'not null', COUNT(*) FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 WHERE c.c_custkey IS NOT NULL",
    ),
    "pred_same_table": (("lineitem",), "SELECT COUNT(*) AS n FROM lineitem l WHERE l.l_discount = l.l_tax"),
    "pred_quoted_literal": (("part",), "SELECT COUNT(*) AS n FROM part WHERE p_name != 'it''s' AND p_brand >= 'Brand#2'"),
}

#: Physical join strategies a hint selects; every one must give the same count.
STRATEGIES = ("BROADCAST", "MERGE", "SHUFFLE_HASH", "SHUFFLE_REPLICATE_NL")
_HINTED = "SELECT {hint} COUNT(*) AS n FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 100"


def sql_query(tables: tuple[str, ...], text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, *tables)
        return spark.sql(text)

    return run


def spj_cyclic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text's count with the cycle closed last, on both of its keys: orders take their customer's nation and lines their supplier's.

    Joined as the text lists its tables, customers first meet all suppliers of their nation, which grows with the square of the input."""
    read = lambda name, *columns: table(spark, sf_dir, name).select(*columns)
    orders = read("orders", "o_orderkey", "o_custkey").join(read("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = read("lineitem", "l_orderkey", "l_suppkey").join(read("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    closed = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))
    return orders.select("o_orderkey", "c_nationkey").join(lines.select("l_orderkey", "s_nationkey"), closed).agg(F.count("*").alias("n"))


def join_hint_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per physical join strategy, selected by hint."""
    register(spark, sf_dir, "customer", "nation")
    parts = [f"SELECT '{s}' AS strategy, n FROM ({_HINTED.format(hint=f'/*+ {s}(n) */')})" for s in STRATEGIES]
    return spark.sql(" UNION ALL ".join(parts))


QUERIES = {k: sql_query(*v) for k, v in SPJ.items()} | {"spj_cyclic_join": spj_cyclic_join, "join_hint_variants": join_hint_variants}
ORACLE_SQL = {k: v[1] for k, v in SPJ.items()} | {
    "join_hint_variants": " UNION ALL ".join(f"SELECT '{s}' AS strategy, n FROM ({_HINTED.format(hint='')})" for s in STRATEGIES)
}
