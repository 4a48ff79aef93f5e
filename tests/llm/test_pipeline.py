import corpus_pipeline as P
import pytest

from quarry.llm import decontaminate, quality, toxicity, wide_simhash
from quarry.session import table


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """What goes into each stage and comes out of it."""
    out, docs = [], table(spark, sf_dir, "documents")
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return {n: (a, b) for n, a, b in out}


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_columns_and_rows(steps):
    for name, (before, after) in steps.items():
        if name != "bpe":
            assert after.columns == before.columns
            kept = after.select(*before.columns).collect()
            assert set(map(tuple, kept)) <= set(map(tuple, before.collect()))
    assert ids(steps["bpe"][1]) == ids(steps["bpe"][0])


def test_quality_stage(spark, sf_dir, steps):
    before, after = steps["quality_rules"]
    want = {r["doc_id"] for r in quality.quality(before, table(spark, sf_dir, "labels")).where("kept").collect()}
    assert ids(after) == want


def test_toxicity_stage(spark, sf_dir, steps):
    before, after = steps["toxicity"]
    assert ids(after) == {r["doc_id"] for r in toxicity.toxicity(before, table(spark, sf_dir, "labels")).where("predicted = 0").collect()}


def test_near_duplicate_stage(steps):
    before, after = steps["near_duplicates"]
    group = {r["doc_id"]: r["component_id"] for r in wide_simhash.duplicate_groups(before).collect()}
    assert ids(after) == set(group.values())
    text = {}
    for r in after.collect():
        assert text.setdefault(r["text"], r["doc_id"]) == r["doc_id"]


def test_decontamination_stage(spark, sf_dir, steps):
    before, after = steps["decontamination"]
    held = ids(decontaminate.matches(before, table(spark, sf_dir, "benchmark")))
    assert ids(after) == ids(before) - held
    items = [" ".join(w.decode() for w in decontaminate.words(r["text"])) for r in table(spark, sf_dir, "benchmark").collect()]
    for r in after.collect():
        joined = " ".join(w.decode() for w in decontaminate.words(r["text"]))
        assert not any(f" {x} " in f" {joined} " for x in items)


def test_stages_handle_odd_and_empty_tables(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, None, None), (3, "word " * 60, None, None, None), (4, " ".join(f"w{i}" for i in range(80)), "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, d, sf_dir)
            assert out.count() <= d.count()
    assert P.STAGES[0][1](spark, docs, sf_dir).count() == 1
