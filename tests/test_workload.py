import pytest
from pyspark.sql import functions as F

from quarry.operators import predicates, synth, vectors, workload
from quarry.sources import files


def test_parse_kinds(spark):
    p = workload.parse(spark, "SELECT COUNT(*) FROM a AS x, b AS y WHERE x.i = y.j AND x.k = x.l AND (x.m = 1 OR y.n = 2) AND NOT (x.o > 3) AND y.p IS NOT NULL AND x.q = 1.5;")
    assert p.joins == ["x.i = y.j"] and len(p.filters) == 5
    assert p.filter_columns == {"x.k", "x.l", "x.m", "y.n", "x.o", "y.p", "x.q"}
    assert workload.parse(spark, "SELEC nothing") is None


def test_join_by_alias_or_by_table(spark):
    sql = "SELECT COUNT(*) FROM t AS a, t AS b WHERE a.x = b.x"
    assert workload.parse(spark, sql, "alias").joins and not workload.parse(spark, sql, "table").joins


def test_template_match_table(spark):
    base = "SELECT COUNT(*) FROM a AS x, b AS y WHERE x.i = y.j AND x.k > 1"
    queries = workload.parsed(spark, list(enumerate([base, base.replace("x.k > 1", "x.z = 2"), base.replace("x.i = y.j", "y.j = x.i"), base.replace("COUNT(*)", "MIN(x.k)"), base.replace("b AS y", "c AS z").replace("y.", "z."), "broken ("])))
    templates = workload.parsed(spark, [(0, base), (1, base)])
    got = {(r["query_id"], r["template_id"], r["same_filters"]) for r in workload.template_match(queries, templates).collect()}
    assert got == {(0, 0, True), (1, 0, False)}
    assert (2, 0, True) in {tuple(r) for r in workload.template_match(queries, templates, normalize_sides=True).collect()}


def test_files_round_trip(spark, tmp_path):
    q = spark.createDataFrame([(0, "SELECT 1"), (1, "SELECT 'a' -- x")], "query_id long, sql string")
    files.write_pool(q, str(tmp_path / "pool"))
    assert sorted(map(tuple, files.read_workload(spark, str(tmp_path / "pool")).collect())) == sorted(map(tuple, q.collect()))
    (tmp_path / "plans.txt").write_text("7#####{a}#####{b}\n\n8#####{c}\n")
    sets = files.read_plan_sets(spark, str(tmp_path / "plans.txt"))
    assert sorted(map(tuple, sets.collect())) == [("7", 0, "{a}"), ("7", 1, "{b}"), ("8", 0, "{c}")]
    files.write_training(spark, str(tmp_path / "plans.txt"), str(tmp_path / "train"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "train")).collect()) == ["{a}#####{b}", "{c}"]
    assert files.read_training(spark, str(tmp_path / "train")).count() == 3
    assert files.read_plans(spark, str(tmp_path / "train")).count() == 2
    built = []
    for _ in range(2):
        files.cached(spark, str(tmp_path / "cache"), lambda: built.append(1) or q)
    assert len(built) == 1
    files.write_result(spark.createDataFrame([(1, 2.0), (2, 3.5)], "query_id long, latency double"), str(tmp_path / "res"))
    assert {r["query"]: r["seconds"] for r in spark.read.json(str(tmp_path / "res")).collect()}["sum"] == 5.5


def test_synthesis(spark, sf_dir):
    spec = synth.specification(spark, sf_dir)
    from quarry.session import register

    register(spark, sf_dir)
    for kind in ("graph", "combination", "template"):
        one = sorted(map(tuple, synth.pool(spark, spec, kind, 30, seed=3).repartition(1).collect()))
        assert one == sorted((i, synth.query(spec, kind, i, 3)) for i in range(30))
        for _, sql in one[:8]:
            p = workload.parse(spark, sql)
            assert p is not None
            spark.sql(sql).schema
            reached, edges = {p.tables[0][1]}, [tuple(c.split(".")[0] for c in j.split(" = ")) for j in p.joins]
            for _ in p.tables:
                reached |= {x for e in edges if set(e) & reached for x in e}
            assert reached == {a for _, a in p.tables}
            same = synth.classes([tuple(j.split(" = ")) for j in p.joins])
            keys = [same.get(c, c) for c in p.filter_columns]
            assert len(keys) == len(set(keys))


def test_predicates_of_small_domains():
    import random

    rng = random.Random(0)
    assert synth.predicate(rng, "a.b", ("string", 0, 0, False, []), True) is None
    for _ in range(50):
        assert "a.b" in synth.predicate(rng, "a.b", ("string", 0, 0, False, ["it's"]), True)


def test_groups_and_coreset(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[0] = -np.abs(v[0])
    v[1] = -np.abs(v[1])
    u = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    known = spark.createDataFrame([(100 + i, x.tolist()) for i, x in enumerate(v[:5] * -1)], "id long, vec array<double>")
    sets = u.select("id", vectors.positive_set("vec").alias("items"))
    pos = [frozenset(np.flatnonzero(x > 0).tolist()) for x in v]
    near = lambda a, b: a == b or (a | b and len(a & b) >= 0.5 * len(a | b))
    key = [tuple(j for j in range(60) if near(pos[i], pos[j])) for i in range(60)]
    want = {i: key.index(key[i]) for i in range(60)}
    groups = vectors.neighbour_groups(sets)
    assert {r["id"]: r["group_id"] for r in groups.collect()} == want
    got = vectors.coreset(u, known, groups, 3, 4).collect()
    for g in {r["group_id"] for r in got}:
        members = [i for i in range(60) if want[i] == g]
        order = vectors.greedy(v[members], v[:5] * -1, 3)
        assert [r["id"] for r in sorted(got, key=lambda r: r["place"]) if r["group_id"] == g] == [members[i] for i in order]


def test_standardized_constant_dimension(spark):
    u = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 2.0])], "id long, vec array<double>")
    got = vectors.standardized(u, u.limit(0)).collect()
    assert all(r["vec"][1] == 0.0 for r in got)


def test_registered_groups_are_of_whole_vectors(spark, sf_dir):
    import numpy as np

    u, known = vectors._vectors(spark, sf_dir)
    rows = sorted((r["id"], np.array(r["vec"])) for r in u.collect())
    ids, v = [i for i, _ in rows], np.stack([x for _, x in rows])
    pos = (v > 0).astype(int)
    common = pos @ pos.T
    union = pos.sum(1)[:, None] + pos.sum(1)[None] - common
    near = (2 * common >= union) | (union == 0)
    key = [tuple(x) for x in near]
    want = {i: ids[key.index(k)] for i, k in zip(ids, key)}
    assert {r["id"]: r["group_id"] for r in vectors.QUERIES["jaccard_groups_whole"](spark, sf_dir).collect()} == want
    sizes = sorted(((-list(want.values()).count(g), g) for g in set(want.values())))[:8]
    assert sorted((-r["size"], r["group_id"]) for r in vectors.QUERIES["largest_groups_whole"](spark, sf_dir).collect()) == sizes
    got = vectors.QUERIES["coreset_select"](spark, sf_dir).collect()
    assert {r["group_id"] for r in got} == {g for _, g in sizes} and all(want[r["id"]] == r["group_id"] for r in got)


def test_groups_of_few_items_list_no_pairs(spark, monkeypatch):
    import numpy as np

    def listed(*args):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(vectors, "_jaccard_links", listed)
    rng = np.random.default_rng(2)
    for items, many, part, largest in ((20, 900, 40, 700), (70, 700, 4096, 65536), (64, 800, 50, 100)):
        has = rng.random((many, items)) < rng.choice([0.05, 0.3, 0.5], many)[:, None]
        has[::9] = has[5]
        has[1], has[2] = False, False
        common = has.astype(int) @ has.T
        union = has.sum(1)[:, None] + has.sum(1)[None] - common
        key = [x.tobytes() for x in 2 * common >= union]
        want = {i: (key.index(k), key.count(k)) for i, k in enumerate(key)}
        rows = [(i, None if i == 2 else [f"w{j}" for j in np.flatnonzero(x)]) for i, x in enumerate(has)]
        monkeypatch.setattr(vectors, "PART", part)
        monkeypatch.setattr(vectors, "LARGEST_PART", largest)
        monkeypatch.setattr(vectors, "FEW_PAIRS", 1000)
        got = vectors.neighbour_groups(spark.createDataFrame(rows, "id long, items array<string>"))
        assert {r["id"]: (r["group_id"], r["size"]) for r in got.collect()} == want
    monkeypatch.undo()
    monkeypatch.setattr(vectors, "BIT_ITEMS", 10)
    got = vectors.neighbour_groups(spark.createDataFrame(rows, "id long, items array<string>"))
    assert {r["id"]: (r["group_id"], r["size"]) for r in got.collect()} == want


def test_standardizing_computes_a_length_once_a_row(spark):
    u = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 2.0])], "id long, vec array<double>")
    plan = vectors.standardized(u, u.limit(0))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("sqrt(aggregate(") == 1


def test_a_choice_compares_different_vectors_of_its_groups_only(spark, monkeypatch):
    met, real = [], vectors.max_similarity
    monkeypatch.setattr(vectors, "max_similarity", lambda u, *a: met.append(u.count()) or real(u, *a))
    rows = [(i, [1.0, 0.1]) for i in range(30, 0, -1)] + [(i, [0.6, -0.8]) for i in range(40, 60)] + [(60, [0.5, -0.8])] + [(i, [-0.1, i / 100]) for i in range(70, 90)]
    u, known = (spark.createDataFrame(x, "id long, vec array<double>") for x in (rows, [(100, [0.3, 0.4]), (101, [0.2, -0.7])]))
    groups = u.select("id", (F.when(F.col("id") <= 30, 1).when(F.col("id") <= 60, 40).otherwise(70)).cast("long").alias("group_id"))
    got = sorted(tuple(r) for r in vectors.coreset(u, known, groups, 3, 2).collect())
    assert met == [3] and got == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (40, 0, 60), (40, 1, 40), (40, 2, 41)]


def test_the_cyclic_join_does_not_pair_a_nations_customers_and_suppliers(spark, tmp_path):
    import re

    data = {
        "customer": ([(i, i % 2) for i in range(40)] + [(3, 1), (None, 0), (41, None)], "c_custkey long, c_nationkey int"),
        "supplier": ([(i, i % 2) for i in range(30)] + [(4, 0), (31, None)], "s_suppkey long, s_nationkey int"),
        "orders": ([(i, i) for i in range(20)] + [(5, 6), (21, None), (22, 41)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(i, j) for i in range(20) for j in range(0, 32, 3)] + [(5, 4), (5, 4), (22, 31), (None, 1)], "l_orderkey long, l_suppkey long"),
    }
    for name, (rows, schema) in data.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    (c, s, o, li) = (data[k][0] for k in ("customer", "supplier", "orders", "lineitem"))
    want = sum(a == b and n is not None and n == m and k is not None and k == q and t is not None and t == u for a, n in c for k, b in o if b is not None for q, t in li for u, m in s)
    df = predicates.QUERIES["spj_cyclic_join"](spark, str(tmp_path))
    assert df.first()["n"] == want
    joined = re.findall(r"Join Inner, (.*)", df._jdf.queryExecution().optimizedPlan().toString())
    assert len(joined) == 3 and all("key" in x for x in joined) and not any("nationkey" in x and "orderkey" not in x for x in joined)


@pytest.mark.parametrize("name", ["largest_groups", "jaccard_groups_whole", "largest_groups_whole"])
def test_registered_groups_list_no_pairs(spark, sf_dir, monkeypatch, name):
    def listed(*args):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(vectors, "_jaccard_links", listed)
    groups = vectors.QUERIES["jaccard_groups"](spark, sf_dir).collect()
    by = {r["group_id"]: r["size"] for r in groups}
    want = [(r["id"], r["group_id"], r["size"]) for r in groups] if "jaccard" in name else sorted(by.items(), key=lambda x: (-x[1], x[0]))[:8]
    assert sum(by.values()) == len(groups) and sorted(map(tuple, vectors.QUERIES[name](spark, sf_dir).collect())) == sorted(want)
