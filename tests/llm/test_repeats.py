"""What learning takes is bounded by labelled ids, however often an id is repeated."""

import random

import numpy as np

from quarry.llm import quality, toxicity


def rows():
    rng = random.Random(6)
    out, labels = [], []
    for i in range(400):
        w = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(70)]
        bad = i % 5 == 0
        if bad:
            w = [x + "###" for x in w]
            w[3] = w[40] = rng.choice(["gribzak", "flomuck", "plutzor"])
        out.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(bad)))
    return out, labels


def test_repeated_rows_teach_nothing_new(spark):
    out, labels = rows()
    docs = spark.createDataFrame(out, "doc_id long, text string")
    more = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id = 0"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert quality.learned(quality.statistics(docs), marks) == quality.learned(quality.statistics(more), marks)
    a, b = toxicity.train(docs, marks), toxicity.train(more, marks)
    assert np.allclose(a.logit, b.logit) and a.marked == b.marked


def test_sentences_are_sampled_by_their_words(monkeypatch):
    some = [[f"w{i}", "x"] for i in range(50)]
    kept = toxicity._bounded(some, 20)
    assert len(kept) == 20 and all(s in some for s in kept) and toxicity._bounded(some, 50) == some
    assert sorted(map(tuple, toxicity._bounded(some[::-1], 20))) == sorted(map(tuple, kept))
