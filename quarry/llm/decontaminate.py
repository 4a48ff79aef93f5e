"""Benchmark decontamination: CGK embedding and repeated bit sampling over item-sized windows, then exact verification.

Texts and items are sequences of words. An item of n words may differ in k = n // 5 word edits (a similarity of 0.8). The CGK
random walk reads a window and moves on or stays by a random bit of step and word, so few edits change few of its 3 n output
places; a repetition samples some places, and windows that agree with an item on all of them are candidates. There are as
many repetitions as reach the target recall at k edits, by the agreement measured on random edits of random items. Windows
are as long as an item and start wherever a match could: a match with k edits keeps one of k + 1 parts of the item whole, so
only windows around such a part are embedded. Candidates are verified by exact edit distance (bit-parallel) in their region.
Windows are made and embedded in slices of at most WINDOWS, so memory does not grow with the places that share a part.

Inputs: null and empty texts match nothing, and items without a word are not searched. Items of fewer than EDIT_EACH words may have
no edits: they are found word for word. Of places with equally few edits the first is reported. Items come from the
benchmark in blocks of bounded size, a pass over the documents each. Repeated doc_ids give rows of their own; repeated
items are searched under each of their ids. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, documents
from quarry.llm.licenses import WORDS
from quarry.session import table

MIN_WORDS, EDIT_EACH = 1, 5
#: Sampled places of a repetition, target recall at the greatest number of edits, and bytes of items searched in one pass.
SAMPLES, RECALL, BLOCK_BYTES = 3, 0.995, 16_000_000
#: Windows embedded at once.
WINDOWS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and any other non-ASCII characters, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


def edits_of(n: int) -> int:
    return n // EDIT_EACH


def pieces(n: int) -> list[tuple[int, int]]:
    """One part more than a match may have edits: (offset, length)."""
    k = edits_of(n) + 1
    return [(n * i // k, n * (i + 1) // k - n * i // k) for i in range(k)]


def _plan(n: int, rep: int) -> tuple[np.ndarray, np.ndarray]:
    """A repetition's odd multipliers by step and its sampled places, in order, for windows of n words."""
    rng = np.random.Generator(np.random.PCG64([n, rep, 20_240]))
    walk = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return walk, np.sort(rng.choice(3 * n, min(SAMPLES, 3 * n), replace=False))


def embed(flat: np.ndarray, starts: np.ndarray, n: int, rep: int) -> np.ndarray:
    """Hash of the sampled places of the CGK embedding of flat[start : start + n], by start."""
    walk, places = _plan(n, rep)
    at = np.zeros(len(starts), np.int64)
    key = np.full(len(starts), rep + 1, np.uint64)
    upto = 0
    for step in range(int(places[-1]) + 1):
        inside = at < n
        sym = np.where(inside, flat[starts + np.minimum(at, n - 1)] + np.uint64(1), np.uint64(0))
        if step == places[upto]:
            key = (key ^ (sym * MIX)) * np.uint64(0xD6E8FEB86659FD93) + (key >> np.uint64(29))
            upto += 1
        mixed = sym * MIX
        mixed ^= mixed >> np.uint64(32)
        at += ((mixed * walk[step]) >> np.uint64(63)).astype(np.int64) & inside
    return key


def repetitions(n: int, trials: int = 96, reps: int = 6) -> int:
    """Repetitions for RECALL at the greatest number of edits, from the agreement on random edits of random items."""
    k = edits_of(n)
    if not k:
        return 1
    rng = np.random.Generator(np.random.PCG64([n, 77]))
    a = rng.integers(1, 1 << 40, (trials, n), dtype=np.uint64)
    b = np.zeros((trials, n), np.uint64)
    for t in range(trials):
        row = a[t].tolist()
        for _ in range(k):
            kind, i = rng.integers(0, 3), int(rng.integers(0, len(row)))
            if kind == 0:
                row[i] = int(rng.integers(1 << 41, 1 << 42))
            elif kind == 1:
                row.insert(i, int(rng.integers(1 << 41, 1 << 42)))
            else:
                del row[i]
        row = (row + rng.integers(1 << 41, 1 << 42, n).tolist())[:n]
        b[t] = row
    starts = np.arange(trials) * n
    flat_a, flat_b = a.ravel(), b.ravel()
    p = np.array([(embed(flat_a, starts, n, r) == embed(flat_b, starts, n, r)) for r in range(reps)]).mean(axis=0)
    late, r = np.flatnonzero(p == 0), reps
    while len(late):  # pairs that have not agreed yet: on, until they do
        agreed = embed(flat_a, starts[late], n, r) == embed(flat_b, starts[late], n, r)
        r += 1
        p[late[agreed]] = 1 / r
        late = late[~agreed]
    # the mean over items of the chance to miss in R repetitions must stay below 1 - RECALL
    r = 1
    while np.mean((1 - p) ** r) > 1 - RECALL:
        r += 1
    return r


class Index(NamedTuple):
    """What is searched in one pass."""

    vocab: dict[bytes, int]
    items: list[tuple[int, list[int]]]  # (item_id, word numbers)
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted hashes, item, offset
    reps: dict[int, int]  # by n
    keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]  # by (n, repetition): sorted keys, item


def rolling(flat: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` numbers; runs with a 0 get 0."""
    m = len(flat) - length + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out, full = np.full(m, length, np.uint64), np.ones(m, bool)
    for j in range(length):
        out = (out ^ (flat[j : j + m] * MIX)) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(31)
        full &= flat[j : j + m] != 0
    return np.where(full, out | np.uint64(1), np.uint64(0))


def build(rows: list[tuple[int, str]], min_words: int = MIN_WORDS) -> Index:
    vocab: dict[bytes, int] = {}
    items = []
    for item_id, text in rows:
        found = words(text)
        if len(found) >= min_words:
            items.append((item_id, [vocab.setdefault(w, len(vocab) + 1) for w in found]))
    seeds: dict[int, list[tuple[int, int, int]]] = {}
    by_n: dict[int, list[int]] = {}
    for i, (_, numbers) in enumerate(items):
        by_n.setdefault(len(numbers), []).append(i)
        flat = np.array(numbers, np.uint64)
        for offset, length in pieces(len(numbers)):
            seeds.setdefault(length, []).append((int(rolling(flat[offset : offset + length], length)[0]), i, offset))
    packed = {}
    for length, found in seeds.items():
        found.sort()
        packed[length] = tuple(np.array(c, t) for c, t in zip(zip(*found), (np.uint64, np.int64, np.int64)))
    reps, keys = {}, {}
    for n, members in by_n.items():
        reps[n] = repetitions(n)
        flat = np.array([x for i in members for x in items[i][1]], np.uint64)
        for r in range(reps[n]):
            key = embed(flat, np.arange(len(members)) * n, n, r)
            order = np.argsort(key, kind="stable")
            keys[n, r] = key[order], np.array(members)[order]
    return Index(vocab, items, packed, reps, keys)


def _pairs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of all positions lo..hi-1 of each row."""
    size = hi - lo
    row = np.repeat(np.arange(len(lo)), size)
    return row, lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _near(pair: np.ndarray, start: np.ndarray, seen: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Windows (pair, start) that start within k words of a candidate (seen, at) of their own pair: its region holds all of a match that starts there."""
    pairs, group = np.unique(seen, return_inverse=True)
    width = max(int(start.max()), int(at.max())) + 2 * k + 2
    known = np.sort(group * width + at + k)
    own = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
    value = own * width + start + k
    return (pairs[own] == pair) & (np.searchsorted(known, value - k, "left") < np.searchsorted(known, value + k, "right"))


def distance(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of the text, and where that part ends first (bit-parallel)."""
    m = len(pattern)
    where: dict[int, int] = {}
    for i, x in enumerate(pattern):
        where[x] = where.get(x, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = mask, 0, m, m, 0
    for j, x in enumerate(text):
        eq = where.get(x, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & mask, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1, mh << 1
        up, down = (mh | ~(xv | ph)) & mask, ph & xv & mask
        if score < best:
            best, end = score, j + 1
    return best, end


def search(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text's place, item's place, first word, words, edits) of the best match of each text and item."""
    get = index.vocab.get
    found = [[get(w, 0) for w in words(x)] for x in texts]
    bounds = np.cumsum([0] + [len(f) + 1 for f in found])
    flat = np.zeros(int(bounds[-1]) + 1, np.uint64)
    for f, lo in zip(found, bounds):
        flat[lo : lo + len(f)] = f
    sizes = np.array([len(numbers) for _, numbers in index.items], np.int64)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}  # by text and item: edits, first word, words
    held: list[np.ndarray] = []

    def flush() -> None:
        code = np.unique(np.concatenate(held))  # a start that several parts give counts once
        bases, hints = code // len(sizes) - len(flat), code % len(sizes)
        for lo, hi in _slices(2 * (sizes[hints] // EDIT_EACH) + 1, WINDOWS):
            _verify(_candidates(flat, bounds, sizes, bases[lo:hi], hints[lo:hi], index), found, bounds, index, best)
        held.clear()

    for length, (hashes, item, offset) in index.seeds.items():
        own = rolling(flat, length)
        at = np.flatnonzero(own)
        left, right = np.searchsorted(hashes, own[at], "left"), np.searchsorted(hashes, own[at], "right")
        on = right > left
        at, left, right = at[on], left[on], right[on]
        for lo, hi in _slices(right - left, WINDOWS):
            row, seed = _pairs(left[lo:hi], right[lo:hi])
            held.append((at[lo:hi][row] - offset[seed] + len(flat)) * len(sizes) + item[seed])  # an item's start by this part, and the item
            if sum(map(len, held)) > WINDOWS:
                flush()
    if held:
        flush()
    return [(x, m, first, n, edits) for (x, m), (edits, first, n) in sorted(best.items())]


def _slices(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose counts add up to about `most`."""
    total, lo = np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _candidates(flat: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, bases: np.ndarray, hints: np.ndarray, index: Index) -> dict[tuple[int, int], list[int]]:
    """By (text's place, item's place): starts of windows within the edits of a base that agree with the item in a repetition."""
    k = sizes[hints] // EDIT_EACH
    row, start = _pairs(bases - k, bases + k + 1)
    start, hint = np.unique(np.stack([start, hints[row]]), axis=1)
    ok = start > -int(sizes.max(initial=0))
    start, hint = start[ok], hint[ok]
    doc = np.searchsorted(bounds, np.maximum(start, 0), "right") - 1
    # windows may hang over a text's edges by the edits allowed: there they read the 0 between texts, or its neighbour's words,
    # which verification does not see
    k = sizes[hint] // EDIT_EACH
    over = (start >= bounds[doc]) | (start >= 0)
    fits = over & (start + sizes[hint] - k <= bounds[doc + 1] - 1)
    start, hint, doc = start[fits], hint[fits], doc[fits]
    wide = np.concatenate([flat, np.zeros(int(sizes.max(initial=0)) + 1, np.uint64)])
    regions: dict[tuple[int, int], list[int]] = {}
    n_of = sizes[hint]
    for n in np.unique(n_of).tolist():
        on = n_of == n
        s, h, d = start[on], hint[on], doc[on]
        for rep in range(index.reps[n]):
            if not len(s):
                break
            unique, back = np.unique(s, return_inverse=True)
            keys, members = index.keys[n, rep]
            own = embed(wide, unique, n, rep)
            left, right = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            hit = np.flatnonzero(right > left)
            if not len(hit):
                continue
            row, place = _pairs(left[hit], right[hit])
            at, member = unique[hit][row], members[place]
            docs = np.searchsorted(bounds, at, "right") - 1
            for a, m, x in zip(at.tolist(), member.tolist(), docs.tolist()):
                regions.setdefault((x, m), []).append(a)
            rest = ~_near(d * len(sizes) + h, s, docs * len(sizes) + member, at, int(n) // EDIT_EACH)
            s, h, d = s[rest], h[rest], d[rest]
    return regions


def _verify(regions: dict[tuple[int, int], list[int]], found: list[list[int]], bounds: np.ndarray, index: Index, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
    """Put the best match of each region into `best`, by exact edit distance."""
    for (x, m), at in regions.items():
        pattern = index.items[m][1]
        n = len(pattern)
        k, lo, hi = edits_of(n), int(bounds[x]), int(bounds[x + 1]) - 1
        at.sort()
        a = b = None
        for p in [*at, None]:
            if a is not None and (p is None or p - k > b):
                text = found[x][a - lo : b - lo]
                score, end = distance(pattern, text)
                if score <= k:
                    # the shortest reading of the match's start
                    tail = text[max(0, end - n - k) : end][::-1]
                    _, size = _prefix(pattern[::-1], tail)
                    best[x, m] = min(best.get((x, m), (score + 1, 0, 0)), (score, a - lo + end - size, size))
                a = None
            if p is None:
                break
            lower, upper = max(lo, p - k), min(hi, p + n + 2 * k)
            if a is None:
                a, b = lower, upper
            else:
                b = max(b, upper)


def _prefix(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to a start of the text, and that start's length."""
    row = list(range(len(text) + 1))
    for i, x in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    best = min(range(len(row)), key=lambda j: (row[j], j))
    return row[best], best


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in blocks of about `limit` bytes, a block at a time on the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r["text"]) > limit:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def indexes(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS) -> Iterator[Index]:
    """What is searched, a pass over the documents each; items of fewer than `min_words` words are left out."""
    for block in _blocks(benchmark, block_bytes):
        index = build(block, min_words)
        if index.items:
            yield index


SCHEMA = "doc_id long, item_id long, first_word long, n_words long, edits long, item_words long"


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item that it holds with at most a fifth of the item's words edited: the best place."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index in indexes(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(index)  # a few times block_bytes

        def batches(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in it:
                got = search(batch.column(1).to_pylist(), index)
                ids = batch.column(0).to_pylist()
                cols = zip(*[(ids[x], index.items[m][0], a, n, e, len(index.items[m][1])) for x, m, a, n, e in got])
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] or [pa.array([], pa.int64())] * 6, names)

        part = arrow_map(rows, batches, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's benchmark passages."""
    return matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
