"""Operators without SQL of their own, against brute force on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import session
from quarry.functions.scalars import epoch_of_text
from quarry.operators import profile, ranking, synth, vectors, workload
from quarry.plans import ranker, tree
from quarry.plans import treenet as N
from quarry.sources import files
from quarry.streaming.progressive import follow


def test_tables_are_listed(spark, sf_dir):
    assert session.table_names(spark, sf_dir) == sorted(session.TABLES) == sorted(profile.SCHEMA)


def test_scratch_tables_are_discarded(spark):
    a, b = session.written(spark.range(3), "a"), session.written(spark.range(4), "b")
    session.discard(a)
    session.discard(spark.range(1))
    assert b.count() == 4
    with pytest.raises(Exception):
        a.count()


def test_text_to_epoch(spark):
    got = spark.createDataFrame([("1970-01-02 00:00:01",), ("1970-01-02",), ("x",), (None,)], "t string").select(epoch_of_text(F.col("t")).alias("e"))
    assert [r["e"] for r in got.collect()] == [86_401, None, None, None]


def test_equal_training_lines_are_queries_of_their_own(spark, tmp_path):
    (tmp_path / "t.txt").write_text("{a}#####{b}\n{a}#####{b}\n{c}\n")
    rows = files.read_training(spark, str(tmp_path / "t.txt")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["cand_id"], r["plan_json"]))
    assert sorted(sorted(v) for v in by.values()) == [[(0, "{a}"), (1, "{b}")]] * 2 + [[(0, "{c}")]]


def test_latency_series(spark, tmp_path):
    path = str(tmp_path / "series")
    for batch, total in ((1, 2.5), (2, 3.0), (1, 2.0)):
        files.append_latency(spark, path, batch, total)
    assert sorted(map(tuple, files.read_latencies(spark, path).collect())) == [(1, 2.0), (2, 3.0)]


def test_deep_plans():
    node = {"Node Type": "Seq Scan", "Relation Name": "t", "Plan Rows": 1, "Plan Width": 1}
    for _ in range(5000):
        node = {"Node Type": "Sort", "Plan Rows": 1, "Plan Width": 1, "Plans": [node]}
    doc = '{"Plan": ' + "".join('{"Node Type": "Sort", "Plan Rows": 1, "Plan Width": 1, "Plans": [' for _ in range(300)) + json.dumps({"Node Type": "Seq Scan", "Relation Name": "t", "Plan Rows": 1, "Plan Width": 1}) + "]}" * 300 + "}"
    rows = tree.flatten(doc)
    assert len(rows) == 601 and rows[0][1:3] == (2, 601) and all(r[8] == ["t"] for r in rows[:301])


def test_uncertain_gradients_and_training():
    def small(*values):
        return N.tree([(1, 2, 3, list(values[0])), (2, 0, 0, list(values[1])), (3, 0, 0, list(values[2]))])

    trees = [small((0, 1), (1, 2), (-3, 0)), small((16, 3), (0, 1), (5, 3)), small((2, 2), (7, 1), (1, 1))]
    params = N.init_uncertain(2, 1, (5, 4, 3), 6)
    args = ([trees[0], trees[1]], [trees[1], trees[2]], np.array([0.0, 1.0]), np.array([0.05, -2.0]))
    _, grads = N.uncertain_gradients(params, *args)
    rng = np.random.default_rng(0)
    for p, g in zip(params, grads):
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in p.shape)
            old = p[at]
            p[at] = old + 1e-6
            hi, _ = N.uncertain_gradients(params, *args)
            p[at] = old - 1e-6
            lo, _ = N.uncertain_gradients(params, *args)
            p[at] = old
            assert abs((hi - lo) / 2e-6 - g[at]) < 1e-5
    fitted = N.fit_uncertain(trees, [(0, 1, 0.0, -1.0), (1, 2, 1.0, 1.0)], epochs=80)
    p, var = N.uncertain(fitted, [trees[0], trees[1]], [trees[1], trees[2]])
    assert p[0] < 0.3 and p[1] > 0.7 and (var > 0).all()


def test_pairs_of_plans(spark):
    plans = tree.plans(spark)
    model = ranker.train(plans, epochs=1)
    model = spark.createDataFrame(model.collect(), model.schema)
    e = {(r["query_id"], r["cand_id"]): r["embedding"] for r in ranker.scores(plans, model).collect()}
    got = ranker.pair_embeddings(plans, model).collect()
    assert {(r["query_id"], r["cand_a"], r["cand_b"]) for r in got} == {(0, 0, 1), (0, 0, 2), (0, 1, 2), (1, 0, 1), (2, 0, 1)}
    assert all(np.allclose(r["embedding_a"], e[r["query_id"], r["cand_a"]]) and np.allclose(r["embedding_b"], e[r["query_id"], r["cand_b"]]) and len(r["embedding_a"]) == 64 for r in got)
    unsure = ranker.train(plans, "uncertain", epochs=2)
    unsure = spark.createDataFrame(unsure.collect(), unsure.schema)
    rows = ranker.uncertain_pairs(plans, unsure).collect()
    assert len(rows) == 5 and all(0 <= r["probability"] <= 1 and r["variance"] > 0 for r in rows)


def test_follow_trains_on_what_arrives(spark, tmp_path):
    src, out, models = (str(tmp_path / x) for x in ("in", "out", "models"))
    plans = tree.plans(spark)
    for number, query in enumerate((0, 1, 2)):
        plans.where(f"query_id = {query}").coalesce(1).write.mode("append").json(src)
        follow(spark, src, str(tmp_path / "cp"), out, models=models, epochs=1)
        assert spark.read.parquet(f"{models}/model-{number}").count() == 1
    assert spark.read.parquet(out).count() == 7
    series = sorted(map(tuple, files.read_latencies(spark, f"{models}/latency").collect()))
    assert [b for b, _ in series] == [1, 2] and series[0][1] in (0.0, 0.001, 0.002) and spark.read.parquet(f"{models}/model-2").first()["relations"] == ["customer", "lineitem", "nation", "orders"]


def test_several_aliases_of_a_table_share_a_column(spark, sf_dir):
    spec = synth.specification(spark, sf_dir)
    twice = [k for k, t in enumerate(spec.templates) if len({spec.tables[a] for a in t[1]}) < len(t[1])]
    found = 0
    for number in range(300):
        p = workload.parse(spark, synth.query(spec, "template", number, 0)) if twice else None
        names = {}
        for t, a in p.tables if p else ():
            names.setdefault(t, []).append(a)
        for t, aliases in names.items():
            if len(aliases) > 1:
                used = [{c.split(".")[1] for c in p.filter_columns if c.split(".")[0] == a} for a in aliases]
                found += bool(used[0] & used[1])
    assert found or not twice


def test_shared_predicates():
    import random

    spec = synth.Spec({"n1": "nation", "n2": "nation", "c": "customer"}, [], [], ["n1.name", "c.bal"], ([1], [1]), ([1], [1]), {"n1.name": ("string", 0, 0, False, ["a", "b", "c"]), "c.bal": ("numeric", 0, 9, True, [])})
    for seed in range(20):
        out, used = synth.shared(random.Random(seed), spec, ["n1", "n2", "c"], [("n1.key", "n2.key")], 5)
        assert len(out) == 2 and used == {"n1.name", "n2.name"}
    assert synth.shared(random.Random(0), spec, ["n1", "n2"], [], 1)[0] and synth.shared(random.Random(0), spec, ["n1", "c"], [], 5) == ([], set())


def test_numbers_follow_the_order(spark):
    rows = [(i, (i * 37) % 101) for i in range(100)]
    got = ranking.numbered(spark.createDataFrame(rows, "id long, k long").repartition(7), "k", "id").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["number"])] == [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert sorted(r["number"] for r in got) == list(range(100))
    assert ranking.numbered(spark.createDataFrame([], "k long"), "k").count() == 0


def test_similarity_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(1)
    u = [(i // 2, rng.normal(size=4).tolist()) for i in range(20)]
    u.append(u[0])
    known = [(i, rng.normal(size=4).tolist()) for i in range(9)]
    a, b = (spark.createDataFrame(x, "id long, vec array<double>") for x in (u, known))
    want = sorted((i, round(max(float(np.dot(v, w)) for _, w in known), 9)) for i, v in u)
    for block_bytes in (1, 8 * 4 * 4, 1 << 20):
        assert sorted((r["id"], round(r["similarity"], 9)) for r in vectors.max_similarity(a, b, block_bytes).collect()) == want
    assert {r["similarity"] for r in vectors.max_similarity(a, b.limit(0)).collect()} == {None}


def test_groups_of_many_equal_sets(spark):
    rows = [(i, [1, 2, 3]) for i in range(3000)] + [(5000, [1, 2, 3, 4]), (5001, [9]), (5002, []), (5003, [])]
    got = {r["id"]: (r["group_id"], r["size"]) for r in vectors.neighbour_groups(spark.createDataFrame(rows, "id long, items array<int>")).collect()}
    assert got[0] == got[2999] == got[5000] == (0, 3001) and got[5001] == (5001, 1) and got[5002] == got[5003] == (5002, 2)


def test_core_set_is_normalised(spark, sf_dir):
    u, known = vectors._vectors(spark, sf_dir)
    rows = sorted((r["id"], np.array(r["vec"])) for r in u.collect())
    ids, v = [i for i, _ in rows], np.stack([x for _, x in rows])
    w = np.stack([np.array(r["vec"]) for r in known.collect()])
    both = np.concatenate([v, w])
    std = both.std(axis=0)
    z = (both - both.mean(axis=0)) / np.where(std == 0, 1, std)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    v, w = z[: len(v)], z[len(v) :]
    pos = (v > 0).astype(int)
    common = pos @ pos.T
    union = pos.sum(1)[:, None] + pos.sum(1)[None] - common
    key = [tuple(x) for x in (2 * common >= union) | (union == 0)]
    group = [ids[key.index(k)] for k in key]
    largest = sorted(set(group), key=lambda g: (-group.count(g), g))[:8]
    want = set()
    for g in largest:
        members = [k for k in range(len(ids)) if group[k] == g]
        want |= {(g, place, ids[members[i]]) for place, i in enumerate(vectors.greedy(v[members], w, 3))}
    assert {tuple(r) for r in vectors.QUERIES["core_set"](spark, sf_dir).collect()} == want


def test_the_last_query_names_an_alias(spark):
    df = workload.parsed(spark, [(0, "SELECT COUNT(*) FROM a AS x, b AS y WHERE x.i = y.j"), (1, "SELECT COUNT(*) FROM c AS x WHERE x.i > 1"), (2, "broken (")])
    assert {tuple(r) for r in workload.alias_table(df).select("alias", "table").collect()} == {("x", "c"), ("y", "b")}


def test_entry_stands_without_the_corpus_part(monkeypatch, capsys):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def broken(name, *args, **kw):
        if name.startswith("quarry.llm"):
            raise ImportError("No module named 'ahocorasick'")
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", broken)
    assert set(entry.queries()) == set(entry.catalog.QUERIES) and set(entry.oracle_sql()) == set(entry.catalog.ORACLE_SQL)


def test_tables_of_an_external_database(spark):
    url, driver = "jdbc:derby:memory:quarry;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark.createDataFrame([(1, 2.5), (2, 3.5)], "id int, x double").write.jdbc(url, "small", "overwrite", driver)
    except Exception as e:
        pytest.skip(f"no database in this installation: {type(e).__name__}")
    got = files.read_jdbc(spark, url, "small", "", "", **driver)
    assert sorted((r[0], r[1]) for r in got.collect()) == [(1, 2.5), (2, 3.5)]
