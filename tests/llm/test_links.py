"""Links and components: rows without an id, spread copies."""

import pytest
import xxhash

from quarry.llm import simhash


@pytest.fixture
def bridge(spark, monkeypatch):
    """Three texts 4 bits apart from the next, 8 between the ends; the middle one has no id."""
    prints = {"one": 0, "two": 0b1111, "three": 0b11111111, "far": (1 << 40) - 1}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, size, a, b: spark.createDataFrame([(r["doc_id"], prints[r["text"]]) for r in docs.collect()], "doc_id long, fp long"))
    return lambda rows: simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 4)


def test_rows_without_an_id_link_others(bridge):
    got = {(r["doc_id"], r["component_id"]) for r in bridge([(1, "one"), (None, "two"), (3, "three"), (9, "far")]).collect()}
    assert got == {(1, 1), (None, 1), (3, 1), (9, 9)}


def test_a_component_without_ids_has_none(bridge):
    got = {(r["doc_id"], r["component_id"]) for r in bridge([(None, "one"), (None, "two"), (9, "far")]).collect()}
    assert got == {(None, None), (9, 9)}


def test_registered_query_gives_hex_digits(spark, sf_dir):
    from quarry.llm.registry import QUERIES
    from quarry.session import table

    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op1_simhash"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i][0] == f"{bits:016x}"
    number = {i: int(f, 16) for i, (f, _) in got.items()}
    parent = {i: i for i in number}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(number)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (number[a] ^ number[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {i: c for i, (_, c) in got.items()} == {i: find(i) for i in ids}
