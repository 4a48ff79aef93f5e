"""Decontamination: short items, and windows in bounded slices."""

import random

from quarry.llm import decontaminate


def texts_and_items():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(["alpha", "beta", "gamma", *[word() for _ in range(rng.randrange(5, 20))]])) for i in range(60)]
    items += [(100, "the"), (101, "of the"), (102, "four words in all"), (103, "not there")]
    texts = []
    for k in range(25):
        part = items[k][1].split()
        part[rng.randrange(3, len(part))] = "zzz"
        texts.append(" ".join([*["alpha beta gamma"] * rng.randrange(40), *part, "of the", *[word() for _ in range(30)]]))
    return [*texts, "four words in all", "four words in between all", "", None], items


def test_short_items_are_found_word_for_word():
    got = {(x, m): (a, n, e) for x, m, a, n, e in decontaminate.search(["x OF the, of the", "four words in all", "four words all", None], decontaminate.build([(7, "the"), (8, "of the"), (9, "four words in all")]))}
    assert got == {(0, 0): (2, 1, 0), (0, 1): (1, 2, 0), (1, 2): (0, 4, 0)}


def test_slices_do_not_change_results(monkeypatch):
    texts, items = texts_and_items()
    index = decontaminate.build(items)
    want = sorted(decontaminate.search(texts, index))
    assert len(want) > 40
    for windows in (1, 10, 500):
        monkeypatch.setattr(decontaminate, "WINDOWS", windows)
        assert sorted(decontaminate.search(texts, index)) == want


def test_windows_are_embedded_in_bounded_numbers(monkeypatch):
    items = [(i, " ".join(["alpha", "beta", "gamma", *[f"w{i}x{k}" for k in range(7)]])) for i in range(300)]
    index, most, embed = decontaminate.build(items), [], decontaminate.embed
    monkeypatch.setattr(decontaminate, "WINDOWS", 5000)
    monkeypatch.setattr(decontaminate, "embed", lambda flat, starts, n, rep: most.append(len(starts)) or embed(flat, starts, n, rep))
    decontaminate.search(["alpha beta gamma " * 400], index)
    assert max(most) <= 2 * 5000


def test_every_edited_copy_is_reached_by_the_repetitions():
    for n in (5, 10, 15, 40, 80):
        assert decontaminate.repetitions(n) >= 1


def test_few_words_reject_no_document_in_the_pipeline(spark):
    b = spark.createDataFrame([(1, "the"), (2, "five words stand in here")], "item_id long, text string")
    assert [len(i.items) for i in decontaminate.indexes(b)] == [2]
    assert [len(i.items) for i in decontaminate.indexes(b, min_words=5)] == [1]
