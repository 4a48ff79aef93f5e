"""Learning to rank plans on Spark: training in one task on the labelled plans, scoring query by query in parallel.

What is trained on is what has been executed and timed: a bounded set, a hash sample of at most `max_queries` queries. A model
is a one-row table of its weights, shapes and feature bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.ranking import choose, ranking_loss, total
from quarry.plans import tree as T
from quarry.plans import treenet as N
from quarry.session import written

MODEL = "kind string, weights array<array<double>>, shapes array<array<int>>, relations array<string>, bounds array<double>"
_BOUNDS = ("lo_plan_rows", "hi_plan_rows", "lo_total_cost", "hi_total_cost", "lo_execution_ms", "hi_execution_ms")


def _trees(pdf: pd.DataFrame) -> tuple[list[tuple[int, int]], list[N.Tree], np.ndarray, np.ndarray]:
    """Keys, trees, labels and costs of a frame of node features, by query and candidate."""
    keys, trees, labels, costs = [], [], [], []
    for key, g in pdf.sort_values(["query_id", "cand_id", "pre_idx"]).groupby(["query_id", "cand_id"], sort=True):
        keys.append((int(key[0]), int(key[1])))
        trees.append(N.tree(list(zip(g["pre_idx"], g["left_idx"], g["right_idx"], g["feat"]))))
        labels.append(float(g["label"].iloc[0]) if g["label"].notna().iloc[0] else np.nan)
        costs.append(float(g["total_cost"].iloc[0]))
    return keys, trees, np.array(labels), np.array(costs)


def train(plans: DataFrame, kind: str = "pairwise", epochs: int = 100, seed: int = 0, max_queries: int = 20_000, start: DataFrame | None = None) -> DataFrame:
    """A one-row model of (query_id, cand_id, plan_json). kind: pairwise, pointwise, rank, uncertain (pairs with a variance, for
    `uncertain_pairs`), or pairwise_cost and rank_cost to learn from estimated costs.

    `start`: a model to go on from, with its bounds and relations. Plans without a time are left out of all but the cost kinds."""
    spark = plans.sparkSession
    n = plans.select("query_id").distinct().count()
    if n > max_queries:
        plans = plans.where(F.pmod(F.xxhash64("query_id"), F.lit(1_000_000)) < int(1_000_000 * max_queries / n))
    nodes = T.plan_nodes(plans)
    if start is None:
        fitted, relations = T.bounds(nodes), T.relations_of(nodes)
        begin = None
    else:
        m = start.first()
        fitted, relations = spark.createDataFrame([tuple(m["bounds"])], ", ".join(f"{c} double" for c in _BOUNDS)), m["relations"]
        begin = [np.array(w).reshape(s) for w, s in zip(m["weights"], m["shapes"])]
    bounds = [float(x) if x is not None else 0.0 for x in fitted.select(*_BOUNDS).first()]
    feats = T.features(nodes, fitted, relations)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, trees, labels, costs = _trees(pdf)
        value = costs if kind.endswith("_cost") else labels
        on = [i for i in range(len(keys)) if not np.isnan(value[i])]
        if kind == "uncertain" or kind.startswith("pairwise"):
            by: dict[int, list[int]] = {}
            for i in on:
                by.setdefault(keys[i][0], []).append(i)
            found = [(a, b, 1.0 if value[a] >= value[b] else 0.0) for g in by.values() for x, a in enumerate(g) for b in g[x + 1 :]]
            if kind == "uncertain":
                found = [(a, b, y, value[a] - value[b]) for a, b, y in found]
            fit_kind, new = (N.fit_uncertain, N.init_uncertain) if kind == "uncertain" else (N.fit_pairs, N.init)
            params = fit_kind(trees, found, epochs, seed=seed, params=begin) if found else begin or new(trees[0].feat.shape[1], seed)
        else:
            target = value.copy()
            if kind.startswith("rank"):
                for q in {keys[i][0] for i in on}:
                    g = sorted((i for i in on if keys[i][0] == q), key=lambda i: (value[i], keys[i][1]))
                    for place, i in enumerate(g, 1):
                        target[i] = float(place)
            params = N.fit_points([trees[i] for i in on], target[on], epochs, seed=seed, params=begin)
        return pd.DataFrame({"kind": [kind], "weights": [[p.ravel().tolist() for p in params]], "shapes": [[list(p.shape) for p in params]], "relations": [list(relations)], "bounds": [bounds]})

    return feats.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, MODEL)  # the labelled plans in one task


def scores(plans: DataFrame, model: DataFrame) -> DataFrame:
    """(query_id, cand_id, score, latency, embedding): a query's plans are one batch, whatever the partitioning."""
    spark, m = plans.sparkSession, model.first()
    shared = spark.sparkContext.broadcast([np.array(w).reshape(s) for w, s in zip(m["weights"], m["shapes"])])
    fitted = spark.createDataFrame([tuple(m["bounds"])], ", ".join(f"{c} double" for c in _BOUNDS))
    feats = T.features(T.plan_nodes(plans), fitted, m["relations"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, trees, _, _ = _trees(pdf)
        s, e = N.score(shared.value, trees)
        ms = pdf.drop_duplicates("cand_id").set_index("cand_id")["execution_ms"]
        return pd.DataFrame({"query_id": [k[0] for k in keys], "cand_id": [k[1] for k in keys], "score": s, "latency": [float(ms[k[1]]) / 1000 for k in keys], "embedding": [x.tolist() for x in e]})

    return feats.groupBy("query_id").applyInPandas(one, "query_id long, cand_id int, score double, latency double, embedding array<double>")


def pair_embeddings(plans: DataFrame, model: DataFrame) -> DataFrame:
    """(query_id, cand_a, cand_b, embedding_a, embedding_b) of all pairs i < j of a query's candidates; a query's plans are one batch."""
    e = written(scores(plans, model).select("query_id", "cand_id", "embedding"), "embeddings")  # each plan goes through the network once
    a, b = (e.select("query_id", F.col("cand_id").alias(f"cand_{x}"), F.col("embedding").alias(f"embedding_{x}")) for x in "ab")
    return a.join(b, "query_id").where("cand_a < cand_b").select("query_id", "cand_a", "cand_b", "embedding_a", "embedding_b")


def uncertain_pairs(plans: DataFrame, model: DataFrame) -> DataFrame:
    """(query_id, cand_a, cand_b, probability, variance) by a model of kind uncertain: that the first is no faster, for all pairs of a query's candidates."""
    spark, m = plans.sparkSession, model.first()
    shared = spark.sparkContext.broadcast([np.array(w).reshape(s) for w, s in zip(m["weights"], m["shapes"])])
    fitted = spark.createDataFrame([tuple(m["bounds"])], ", ".join(f"{c} double" for c in _BOUNDS))
    feats = T.features(T.plan_nodes(plans), fitted, m["relations"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, trees, _, _ = _trees(pdf)
        at = [(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys))]
        p, var = N.uncertain(shared.value, [trees[i] for i, _ in at], [trees[j] for _, j in at]) if at else ([], [])
        return pd.DataFrame({"query_id": [keys[i][0] for i, _ in at], "cand_a": [keys[i][1] for i, _ in at], "cand_b": [keys[j][1] for _, j in at], "probability": p, "variance": var})

    return feats.groupBy("query_id").applyInPandas(one, "query_id long, cand_a int, cand_b int, probability double, variance double")


def evaluate(plans: DataFrame, model: DataFrame) -> dict[str, DataFrame]:
    """Chosen plans, their total latency in seconds and the ranking loss."""
    s = scores(plans, model).select("query_id", "cand_id", "score", "latency")
    chosen = choose(s)
    return {"scores": s, "chosen": chosen, "total": total(chosen), "loss": ranking_loss(s)}


def _sample_model(spark: SparkSession) -> DataFrame:
    return train(T.plans(spark), epochs=2)


#: A small network of written-out weights: inputs and outputs of its three convolutions (a node and its two children) and two dense layers.
_LAYERS = ((6, 4), (12, 3), (9, 2), (2, 3), (3, 1))


def _weights() -> list[np.ndarray]:
    out = []
    for k, (a, b) in enumerate(_LAYERS):
        out += [np.array([[((7 * i + 3 * j + k) % 11 - 5) / 10 for j in range(b)] for i in range(a)]), np.array([((5 * j + k) % 7 - 3) / 10 for j in range(b)])]
    return out


def _network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, cand_id, score, embedding): the sample plans through the small network, a query's plans as one batch."""
    nodes = T.plan_nodes(T.plans(spark)).select("query_id", "cand_id", "pre_idx", "left_idx", "right_idx", F.log1p("plan_rows").alias("rows"), (F.col("plan_width") / 10).alias("width"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = list(pdf.groupby("cand_id", sort=True))
        s, e = N.score(_weights(), [N.tree(list(zip(g["pre_idx"], g["left_idx"], g["right_idx"], zip(g["rows"], g["width"])))) for _, g in groups])
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "cand_id": [c for c, _ in groups], "score": s, "first": e[:, 0], "second": e[:, 1]})

    out = nodes.groupBy("query_id").applyInPandas(one, "query_id long, cand_id int, score double, first double, second double")
    return out.select("query_id", "cand_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("score", "first", "second")])


def _conv_sql(k: int, leaky: bool) -> str:
    """Convolution k over v{k} (query_id, cand_id, pre, ch, val), normalised over a tree's nodes and channels, as v{k + 1}."""
    a, b = _LAYERS[k]
    return f"""y{k} AS (SELECT query_id, cand_id, i.pre, o AS ch, SUM((((7 * (role * {a // 3} + v.ch) + 3 * o + {k}) % 11) - 5) / 10.0::DOUBLE * val) + (((5 * o + {k}) % 7) - 3) / 10.0::DOUBLE AS val
        FROM idx i JOIN v{k} v USING (query_id, cand_id), (SELECT UNNEST(range({b})) AS o) WHERE v.pre = i.node GROUP BY query_id, cand_id, i.pre, o
        UNION ALL SELECT DISTINCT query_id, cand_id, 0, o, 0.0::DOUBLE FROM idx, (SELECT UNNEST(range({b})) AS o)),
    z{k} AS (SELECT query_id, cand_id, pre, ch, (val - AVG(val) OVER w) / (STDDEV_SAMP(val) OVER w + {N.EPS}) AS val FROM y{k} WINDOW w AS (PARTITION BY query_id, cand_id)),
    v{k + 1} AS (SELECT query_id, cand_id, pre, ch, {f"CASE WHEN val > 0 THEN val ELSE {N.SLOPE} * val END" if leaky else "val"} AS val FROM z{k})"""


def _dense_sql(k: int, source: str, leaky: bool) -> str:
    b = _LAYERS[k][1]
    value = f"SUM((((7 * ch + 3 * o + {k}) % 11) - 5) / 10.0::DOUBLE * val) + (((5 * o + {k}) % 7) - 3) / 10.0::DOUBLE"
    return f"v{k + 1} AS (SELECT query_id, cand_id, o AS ch, {f'CASE WHEN {value} > 0 THEN {value} ELSE {N.SLOPE} * ({value}) END' if leaky else value} AS val FROM {source}, (SELECT UNNEST(range({b})) AS o) GROUP BY query_id, cand_id, o)"


QUERIES = {
    "plan_scores": lambda s, d: scores(T.plans(s), _sample_model(s)).select("query_id", "cand_id", "score", "latency"),
    "plan_pair_embeddings": lambda s, d: pair_embeddings(T.plans(s), _sample_model(s)),
    "tree_network": _network,
}
ORACLE_SQL: dict[str, str] = {
    "tree_network": f"""{T._TREE}, o AS ({T._PREORDER}), m AS (SELECT query_id, MAX(pre_idx) AS m FROM o GROUP BY query_id),
    slots AS (SELECT DISTINCT query_id, cand_id, UNNEST(range(1, m + 1)) AS pre FROM o JOIN m USING (query_id)),
    idx AS (SELECT s.query_id, s.cand_id, s.pre, role, COALESCE(CASE role WHEN 0 THEN pre_idx WHEN 1 THEN left_idx ELSE right_idx END, 0) AS node
      FROM (SELECT * FROM slots, (VALUES (0), (1), (2)) r(role)) s LEFT JOIN o ON o.query_id = s.query_id AND o.cand_id = s.cand_id AND o.pre_idx = s.pre),
    v0 AS (SELECT query_id, cand_id, pre_idx AS pre, 0 AS ch, LN(1 + plan_rows) AS val FROM n UNION ALL SELECT query_id, cand_id, pre_idx, 1, plan_width / 10 FROM n
      UNION ALL SELECT DISTINCT query_id, cand_id, 0, ch, 0.0::DOUBLE FROM n, (VALUES (0), (1)) c(ch)),
    {_conv_sql(0, True)}, {_conv_sql(1, True)}, {_conv_sql(2, False)},
    pooled AS (SELECT query_id, cand_id, ch, MAX(val) AS val FROM v3 GROUP BY ALL), {_dense_sql(3, "pooled", True)}, {_dense_sql(4, "v4", False)}
    SELECT query_id, cand_id, ROUND(v5.val, 6) + 0.0::DOUBLE AS score, ROUND(MAX(p.val) FILTER (p.ch = 0), 6) + 0.0::DOUBLE AS first, ROUND(MAX(p.val) FILTER (p.ch = 1), 6) + 0.0::DOUBLE AS second
      FROM v5 JOIN pooled p USING (query_id, cand_id) GROUP BY query_id, cand_id, v5.val""",
}
