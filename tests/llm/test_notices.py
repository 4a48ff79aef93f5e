"""Fuzzy notices against brute force over all spans of words."""

import random

from quarry.llm import licenses


def slow_distance(p, t):
    row = list(range(len(t) + 1))
    for i, x in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


NOTICES = (("a", "all rights reserved"), ("m", "released under the mit license"), ("b", "licensed under the bsd license"))


def slow_places(words, notice):
    """(start, end, edits) in characters of all spans of whole words within the edits."""
    k, out, at = licenses.edits_of(notice), [], 0
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + 9) + 1):
            span = " ".join(words[i:j])
            if abs(len(span) - len(notice)) <= k and (e := slow_distance(notice, span)) <= k:
                out.append((at, at + len(span), e))
        at += len(words[i]) + 1
    return out


def test_matches_are_exact_and_none_is_missed():
    rng = random.Random(3)
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"w{rng.randrange(20)}" for _ in range(rng.randrange(3))]
            text = list(rng.choice(NOTICES)[1])
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(text))
                kind = rng.randrange(3)
                if kind == 0:
                    text[at] = "q"
                elif kind == 1:
                    text.insert(at, "q")
                elif text[at] != " ":
                    del text[at]
            words += "".join(text).split()
        joined, found = " ".join(words), licenses.scan(" ".join(words), NOTICES).found
        every = {(s, e): (label, d) for label, n in NOTICES for s, e, d in slow_places(words, n)}
        for m in found:
            notice = min((n for label, n in NOTICES if label == m.label), key=lambda n: slow_distance(n, joined[m.start : m.end]))
            assert slow_distance(notice, joined[m.start : m.end]) == m.edits <= licenses.edits_of(notice)
            assert joined[: m.start].count(" ") == m.first_word
        for s, e in every:  # what is within the edits is found, or something that overlaps it is
            assert any(m.start < e and s < m.end for m in found), (joined[s:e], joined)
        assert all(a.end <= b.start for a, b in zip(found, found[1:]))


def test_adjoining_notices_are_all_found():
    got = [(m.label, m.edits) for m in licenses.scan("all rigts reserved all rights reserved al rights reserved").found]
    assert got == [("all-rights-reserved", 1), ("all-rights-reserved", 0), ("all-rights-reserved", 1)]


def test_many_notices_take_time_in_proportion():
    import time

    took = []
    for n in (2000, 16_000):
        t = time.process_time()
        assert len(licenses.scan("all rights reserved " * n).found) == n
        took.append(time.process_time() - t)
    assert took[1] < 24 * took[0] + 0.5
