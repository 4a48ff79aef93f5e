"""Plan trees: candidate plans as JSON, flattened into binary trees of nodes and turned into feature vectors.

A plan with one input gets a second, unknown one, so trees are binary; nodes are numbered from 1 in preorder and 0 stands for
no node. Plans are kilobytes each: a plan is parsed in one row, and everything over plans is DataFrame work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import denormalized, normalized
from quarry.session import ship

# The order of the operators is part of the feature's format.
OPERATORS = (
    "Unknown", "Hash", "Materialize", "Sort", "Aggregate", "Incremental Sort", "Limit", "Seq Scan", "Index Scan",
    "Index Only Scan", "Bitmap Heap Scan", "Nested Loop", "Hash Join", "Merge Join", "Bitmap Index Scan",
)
SCANS = ("Seq Scan", "Index Scan", "Index Only Scan", "Bitmap Heap Scan")

NODES = "query_id long, cand_id int, pre_idx int, left_idx int, right_idx int, node_type string, relation string, plan_rows double, plan_width double, total_cost double, relations array<string>, execution_ms double"


def flatten(plan_json: str) -> list[tuple]:
    """(pre_idx, left, right, type, relation, rows, width, cost, relations below and at the node, execution time) in preorder.

    The plan may be in a list of one, and its tree may be JSON text. More than two inputs of a node are an error."""
    doc = json.loads(plan_json)
    doc = doc[0] if isinstance(doc, list) else doc
    root = doc["Plan"]
    root = json.loads(root) if isinstance(root, str) else root
    took = doc.get("Execution Time")
    rows: list[list] = []
    stack: list[tuple[dict | None, int, int]] = [(root, -1, 0)]  # node, its parent's place, the column it is entered in
    while stack:
        node, parent, side = stack.pop()
        me = len(rows)
        if parent >= 0:
            rows[parent][side] = me + 1
        if node is None:
            rows.append([me + 1, 0, 0, "Unknown", None, 0.0, 0.0, 0.0, [], took])
            continue
        inputs = node.get("Plans") or []
        if len(inputs) > 2:
            raise ValueError(f"a node with {len(inputs)} inputs: {node['Node Type']}")
        own = [node["Relation Name"]] if node["Node Type"] in SCANS and node.get("Relation Name") else []
        rows.append([me + 1, 0, 0, node["Node Type"], node.get("Relation Name"), float(node["Plan Rows"]), float(node["Plan Width"]), float(node.get("Total Cost", 0.0)), own, took])
        if inputs:
            stack += [(inputs[1] if len(inputs) == 2 else None, me, 2), (inputs[0], me, 1)]
    for r in reversed(rows):  # inputs come after the node they feed
        r[8] = sorted(r[8] + [x for at in (r[1], r[2]) if at for x in rows[at - 1][8]])
    return [tuple(r) for r in rows]


def plan_nodes(plans: DataFrame) -> DataFrame:
    """The nodes of (query_id, cand_id, plan_json)."""

    ship(plans.sparkSession)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODES.split(", ")]
        for pdf in it:
            yield pd.DataFrame([(q, c, *r) for q, c, p in zip(pdf["query_id"], pdf["cand_id"], pdf["plan_json"]) for r in flatten(p)], columns=names)

    return plans.select(F.col("query_id").cast("long"), F.col("cand_id").cast("int"), "plan_json").mapInPandas(batches, NODES)


def real(nodes: DataFrame) -> DataFrame:
    """Nodes of the plans themselves, without those that make trees binary."""
    return nodes.where("node_type <> 'Unknown' OR relation IS NOT NULL OR plan_rows > 0 OR plan_width > 0")


def bounds(nodes: DataFrame) -> DataFrame:
    """One row: least and greatest ln(1 + x) of rows, cost and time over all nodes."""
    x = real(nodes)
    aggs = [f(F.log1p(c)).alias(f"{n}_{c}") for c in ("plan_rows", "total_cost", "execution_ms") for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return x.agg(*aggs)


def relations_of(nodes: DataFrame) -> list[str]:
    """The relations that plans scan, sorted."""
    return [r["relation"] for r in nodes.where(F.col("relation").isNotNull()).select("relation").distinct().orderBy("relation").collect()]


def slot(node_type):
    """Place of an operator in the one-hot part; unknown ones share place 0."""
    return F.greatest(F.array_position(F.array(*[F.lit(o) for o in OPERATORS]), node_type).cast("int") - 1, F.lit(0))


def features(nodes: DataFrame, fitted: DataFrame, relations: list[str]) -> DataFrame:
    """(query_id, cand_id, pre_idx, left_idx, right_idx, feat, label, total_cost): operator one-hot, counts of relations with one place
    for unknown ones, width, normalised rows; the label is the normalised execution time."""
    known = F.array(*[F.lit(r) for r in relations]).cast("array<string>")
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(len(OPERATORS) - 1)), lambda i: F.when(i == slot(F.col("node_type")), 1.0).otherwise(0.0))
    counts = F.transform(known, lambda r: F.size(F.filter("relations", lambda x: x == r)).cast("double"))
    other = F.array(F.size(F.filter("relations", lambda x: ~F.array_contains(known, x))).cast("double"))
    n = nodes.crossJoin(F.broadcast(fitted))
    rows = F.when(F.col("plan_rows") == 0, 0.0).otherwise(normalized(F.col("plan_rows"), F.col("lo_plan_rows"), F.col("hi_plan_rows")))
    return n.select(
        "query_id", "cand_id", "pre_idx", "left_idx", "right_idx",
        F.concat(one_hot, counts, other, F.array(F.col("plan_width"), rows)).alias("feat"),
        normalized(F.col("execution_ms"), F.col("lo_execution_ms"), F.col("hi_execution_ms")).alias("label"),
        "execution_ms", "total_cost",
    )


def _node(kind: str, rows: float, width: float, *inputs: dict, relation: str | None = None) -> dict:
    out = {"Node Type": kind, "Plan Rows": rows, "Plan Width": width, "Startup Cost": 0.0, "Total Cost": round(rows * 0.01 + sum(i["Total Cost"] for i in inputs), 2)}
    return out | ({"Relation Name": relation} if relation else {}) | ({"Plans": list(inputs)} if inputs else {})


def _plan(tree: dict, ms: float) -> str:
    return json.dumps([{"Plan": tree, "Planning Time": 0.1, "Triggers": [], "Execution Time": ms}])


def sample_plans() -> list[tuple[int, int, str]]:
    """(query_id, cand_id, plan_json): small plans with unary and binary nodes, unknown operators and a relation scanned twice."""
    seq = lambda r, rows, w=8: _node("Seq Scan", rows, w, relation=r)
    hash_join = lambda rows, a, b: _node("Hash Join", rows, 16, a, _node("Hash", b["Plan Rows"], 8, b))
    loop = lambda rows, a, b: _node("Nested Loop", rows, 16, a, b)
    agg = lambda x: _node("Aggregate", 1, 8, x)
    return [
        (0, 0, _plan(agg(hash_join(900, seq("orders", 15000), seq("customer", 1500))), 12.5)),
        (0, 1, _plan(agg(loop(9000, seq("customer", 1500), _node("Index Scan", 10, 8, relation="orders"))), 48.0)),
        (0, 2, _plan(agg(_node("Merge Join", 900, 16, _node("Sort", 15000, 8, seq("orders", 15000)), _node("Sort", 1500, 8, seq("customer", 1500)))), 20.25)),
        (1, 0, _plan(agg(hash_join(25, seq("nation", 25), seq("nation", 25))), 1.0)),
        (1, 1, _plan(agg(_node("Gather", 25, 16, loop(25, seq("nation", 25), _node("Materialize", 25, 8, seq("nation", 25))))), 2.0)),
        (2, 0, _plan(agg(hash_join(60000, seq("lineitem", 60000), hash_join(15000, seq("orders", 15000), seq("customer", 1500)))), 150.0)),
        (2, 1, _plan(agg(loop(60000, hash_join(15000, seq("orders", 15000), seq("customer", 1500)), _node("Bitmap Heap Scan", 4, 8, _node("Bitmap Index Scan", 4, 0), relation="lineitem"))), 390.5)),
    ]


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sample_plans(), "query_id long, cand_id int, plan_json string")


def _preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_nodes(plans(spark)).select("query_id", "cand_id", "pre_idx", "left_idx", "right_idx", "node_type")


def _relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = plan_nodes(plans(spark)).select("query_id", "cand_id", "pre_idx", F.explode("relations").alias("relation"))
    return n.groupBy("query_id", "cand_id", "pre_idx", "relation").agg(F.count("*").alias("n"))


def _norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = plan_nodes(plans(spark))
    x = real(n).crossJoin(F.broadcast(bounds(n)))
    return x.select("query_id", "cand_id", "pre_idx", F.round(normalized(F.col("plan_rows"), F.col("lo_plan_rows"), F.col("hi_plan_rows")), 6).alias("norm_rows"), F.round(normalized(F.col("execution_ms"), F.col("lo_execution_ms"), F.col("hi_execution_ms")), 6).alias("norm_time"))


def _inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = plan_nodes(plans(spark))
    x = real(n).crossJoin(F.broadcast(bounds(n)))
    lo, hi = F.col("lo_plan_rows"), F.col("hi_plan_rows")
    return x.select("query_id", "cand_id", "pre_idx", F.round(denormalized(normalized(F.col("plan_rows"), lo, hi), lo, hi), 4).alias("plan_rows"))


def _one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_nodes(plans(spark)).select("query_id", "cand_id", "pre_idx", slot(F.col("node_type")).alias("slot"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = plan_nodes(plans(spark))
    f = features(n, bounds(n), relations_of(n))
    return f.select("query_id", "cand_id", "pre_idx", F.size("feat").alias("n_features"), F.round(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), 6).alias("feature_sum"))


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_nodes(plans(spark)).where("pre_idx = 1").select("query_id", "cand_id", (F.col("execution_ms") / 1000).alias("seconds"))


QUERIES = {
    "plan_seconds": _seconds,
    "plan_tree_preorder": _preorder,
    "plan_relation_counts": _relation_counts,
    "log_minmax_norm": _norm,
    "log_minmax_inverse": _inverse,
    "op_one_hot": _one_hot,
    "plan_features": _features,
}

_VALUES = ", ".join("({}, {}, '{}')".format(q, c, p.replace("'", "''")) for q, c, p in sample_plans())
_TREE = f"""WITH RECURSIVE p(query_id, cand_id, plan) AS (VALUES {_VALUES}),
    t AS (SELECT query_id, cand_id, []::INTEGER[] AS path, json_extract(plan, '$[0].Plan') AS node, CAST(json_extract(plan, '$[0]."Execution Time"') AS DOUBLE) AS ms FROM p
      UNION ALL SELECT t.query_id, t.cand_id, list_append(t.path, i), CASE WHEN i < json_array_length(t.node, '$.Plans') THEN json_extract(t.node, '$.Plans[' || i || ']') END, ms
        FROM t, (VALUES (0), (1)) v(i) WHERE json_array_length(t.node, '$.Plans') >= 1),
    n AS (SELECT CAST(query_id AS BIGINT) AS query_id, cand_id, path, CAST(ROW_NUMBER() OVER (PARTITION BY query_id, cand_id ORDER BY path) AS INTEGER) AS pre_idx,
      COALESCE(json_extract_string(node, '$."Node Type"'), 'Unknown') AS node_type, json_extract_string(node, '$."Relation Name"') AS relation,
      COALESCE(CAST(json_extract(node, '$."Plan Rows"') AS DOUBLE), 0) AS plan_rows, COALESCE(CAST(json_extract(node, '$."Plan Width"') AS DOUBLE), 0) AS plan_width, ms, node IS NOT NULL AS is_real FROM t)"""
_SCANS = ", ".join(f"'{s}'" for s in SCANS)
_SLOT = "GREATEST(COALESCE(list_position([" + ", ".join(f"'{o}'" for o in OPERATORS) + "], node_type), 1) - 1, 0)"
_COUNTS = f"SELECT a.query_id, a.cand_id, a.pre_idx, b.relation, COUNT(*) AS n FROM n a JOIN n b ON a.query_id = b.query_id AND a.cand_id = b.cand_id AND a.path = b.path[1:len(a.path)] WHERE b.node_type IN ({_SCANS}) GROUP BY ALL"
_BOUNDS = "(SELECT MIN(LN(1 + plan_rows)) AS lo, MAX(LN(1 + plan_rows)) AS hi, MIN(LN(1 + ms)) AS lot, MAX(LN(1 + ms)) AS hit FROM n WHERE is_real)"
_PREORDER = """SELECT a.query_id, a.cand_id, a.pre_idx, COALESCE(l.pre_idx, 0) AS left_idx, COALESCE(r.pre_idx, 0) AS right_idx, a.node_type FROM n a
    LEFT JOIN n l ON l.query_id = a.query_id AND l.cand_id = a.cand_id AND l.path = list_append(a.path, 0) LEFT JOIN n r ON r.query_id = a.query_id AND r.cand_id = a.cand_id AND r.path = list_append(a.path, 1)"""
ORACLE_SQL = {
    "plan_seconds": f"{_TREE} SELECT query_id, cand_id, ms / 1000 AS seconds FROM n WHERE pre_idx = 1",
    "plan_tree_preorder": f"{_TREE} {_PREORDER}",
    "plan_relation_counts": f"{_TREE} {_COUNTS}",
    "log_minmax_norm": f"{_TREE} SELECT query_id, cand_id, pre_idx, ROUND((LN(1 + plan_rows) - lo) / (hi - lo), 6) AS norm_rows, ROUND((LN(1 + ms) - lot) / (hit - lot), 6) AS norm_time FROM n, {_BOUNDS} WHERE is_real",
    "log_minmax_inverse": f"{_TREE} SELECT query_id, cand_id, pre_idx, plan_rows FROM n WHERE is_real",
    "op_one_hot": f"{_TREE} SELECT query_id, cand_id, pre_idx, CAST({_SLOT} AS INTEGER) AS slot FROM n",
    "plan_features": f"""{_TREE} SELECT query_id, cand_id, pre_idx, CAST({len(OPERATORS)} + (SELECT COUNT(DISTINCT relation) FROM n) + 3 AS INTEGER) AS n_features,
        ROUND(1 + COALESCE(c.n, 0) + plan_width + CASE WHEN plan_rows = 0 THEN 0 ELSE (LN(1 + plan_rows) - lo) / (hi - lo) END, 6) AS feature_sum
        FROM n LEFT JOIN (SELECT query_id, cand_id, pre_idx, SUM(n) AS n FROM ({_COUNTS}) GROUP BY ALL) c USING (query_id, cand_id, pre_idx), {_BOUNDS}""",
}
