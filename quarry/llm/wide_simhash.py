"""Near-duplicates by similarity: SimHash fingerprints of several words of bits, banded, each band's trie joined with itself.

A 64-bit fingerprint tells copies of a similarity of 0.8 from others only roughly, so here a document has WORDS of them, one
for each of as many mixes of its distinct shingles' hashes. Two documents of Jaccard similarity s differ in a share
acos(2s / (1 + s)) / pi of the bits; candidates may differ in that many bits and three standard deviations. Documents that agree on
a band of bits meet in that band's trie, whose node pairs are walked together, adding up differing bits until they exceed the
budget (`group_links`, over bits of all words). A band begins every BAND_STEP bits: by the formula about 0.98 of the pairs at the
similarity asked for agree on one and are within the budget, and more above it.

The components of the candidates are then taken apart by the exact similarity of their members' sets of shingles (`set_links`):
a link that is returned has the similarity asked for, and inside of such a component none is missed.

A band's value or a component that more than SPLIT_AT documents share is dealt to chunks first; then every two chunks of it meet, but for those of one
component by all links so far, so no task holds an unbounded group and no link is lost. That is linear in a group of
near copies and quadratic in one of documents that aren't. Only links of spanning forests leave a task.

Inputs: null and empty texts have the fingerprint of no bits and are copies of each other. Documents are told apart by id: rows with the
same id count as one, with the least fingerprint. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, components
from quarry.llm.simhash import group_links, shingle_hashes
from quarry.session import written

WORDS, BAND_BITS, BAND_STEP, SPLIT_AT = 10, 16, 8, 4096
#: Candidates' ids and fingerprints (about 100 bytes each) that are broadcast; more are joined by a shuffle.
SENT_ROWS = 100_000


def budget_bits(similarity: float, bits: int) -> int:
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + 3 * math.sqrt(bits * share * (1 - share)))


def fingerprint(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """`words` times 64 bits: bit i of word k is 1 if it is set in over half of the hashes' k-th mix."""
    out = np.zeros(words, np.uint64)
    if not len(hashes):
        return out
    for k in range(words):
        mixed = hashes
        if k:
            mixed = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & (1 << 64) - 1)
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed = mixed ^ (mixed >> np.uint64(31))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 1 << 15):
            ones += np.unpackbits(mixed[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[k] = int.from_bytes(np.packbits(2 * ones > len(mixed)).tobytes(), "big")
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], size: int, words: int, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """(id, fp) of rows (id, text), and with `whole` their shingles' hashes."""
    for batch in batches:
        sets = [np.unique(shingle_hashes(x.as_py(), size)) for x in batch.column(1).cast(pa.binary())]
        prints = pa.array([fingerprint(x, words).astype(">u8").tobytes() for x in sets], pa.binary())
        more = [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))] if whole else []
        yield pa.RecordBatch.from_arrays([batch.column(0), prints, *more], ["id", "fp", "shingles"][: 2 + whole])


def set_links(sets: list[np.ndarray], known: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest over sets of distinct values whose Jaccard similarity is at least `similarity`, between sets of different `known` components only."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cuts = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(codes, kind="stable")
    values, owners = codes[order], owner[order]  # of sets that are left, and of some that no longer are
    left, indexed = np.ones(n, bool), n
    order = np.argsort(known, kind="stable")
    lo, hi = np.searchsorted(known[order], known, "left"), np.searchsorted(known[order], known, "right")
    out = []
    for start in range(n):
        if not left[start]:
            continue
        queue = order[lo[start] : hi[start]].tolist()
        left[queue] = False
        while queue and (rest := int(left.sum())):
            if 2 * rest <= indexed:
                on = left[owners]
                values, owners, indexed = values[on], owners[on], rest
            i = queue.pop()
            own = codes[cuts[i] : cuts[i + 1]]
            a, b = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            step = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange(int((b - a).sum()))
            common = np.bincount(owners[step], minlength=n)
            for j in np.flatnonzero(left & (common / np.maximum(size + size[i] - common, 1) >= similarity)).tolist():
                if left[j]:
                    out.append((i, j))
                    more = order[lo[j] : hi[j]].tolist()
                    left[more] = False
                    queue += more
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows sorted by their first column, as tables of whole groups, of at least so many rows but for the last."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy()
        lo = 0
        if rows >= least:  # a bounded number of whole groups at a time
            change = np.flatnonzero(group != last)
            if len(change):
                lo = int(change[0])
                if lo:
                    held.append(batch.slice(0, lo))
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        held.append(batch.slice(lo))
        rows, last = rows + batch.num_rows - lo, group[-1]
    if held:
        yield pa.Table.from_batches(held)


def _link_batches(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows (grp, id, fingerprint) or (grp, id, fingerprint, component) sorted by grp: links (a, b), between components only."""
    for t in _whole_groups(batches, 100_000):
        group, ids, part = (t.column(k).to_numpy() for k in (0, 1, 3 if t.num_columns > 3 else 1))
        keys = np.frombuffer(b"".join(t.column(2).to_pylist()), ">u8").astype(np.uint64).reshape(len(ids), -1)
        order = np.lexsort((ids, *keys.T[::-1], group))
        group, ids, keys, part = group[order], ids[order], keys[order], part[order]
        cuts = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(ids)]))
        same = np.lexsort((part, group))  # stable: a component's first key comes first
        first = np.concatenate(([True], (group[same][1:] != group[same][:-1]) | (part[same][1:] != part[same][:-1])))
        parent = np.empty(len(ids), np.int64)
        parent[same] = same[np.flatnonzero(first)][np.cumsum(first) - 1]
        a, b, _ = group_links(keys, cuts, budget, parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])


def _set_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (grp, id, shingles) or (grp, id, shingles, component) sorted by grp: links (a, b), between components only."""
    for t in _whole_groups(batches, 2_000):
        t = t.combine_chunks()
        group, ids, part = (t.column(k).to_numpy() for k in (0, 1, 3 if t.num_columns > 3 else 1))
        sets = t.column(2).combine_chunks()
        values, ends = sets.flatten().to_numpy(), np.cumsum(sets.value_lengths().to_numpy())
        sets = np.split(values, ends[:-1])
        cuts = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(ids)])).tolist()
        found = [(lo + i, lo + j) for lo, hi in zip(cuts[:-1], cuts[1:]) if hi - lo > 1 for i, j in set_links(sets[lo:hi], part[lo:hi], similarity)]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])


def _joined(rows: DataFrame, link: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("grp", "id", "value", *(["component"] if "component" in rows.columns else [])).repartition(width, "grp").sortWithinPartitions("grp")
    return arrow_map(dealt, link, "a long, b long")


def _chunk_pairs(inside: DataFrame) -> DataFrame:
    """Rows of hot groups (grp, id, value, component) once for each two chunks that they are to be compared in; grp: the two chunks.

    A chunk is a part of one component or some whole small ones; two parts of one component don't meet."""
    half = SPLIT_AT // 2
    sizes = inside.groupBy("grp", "component").agg(F.count("*").alias("n"))
    small = F.when(F.col("n") <= half, F.col("n"))
    groups = sizes.groupBy("grp").agg(F.count("*").alias("parts"), F.ceil(F.coalesce(F.sum(small), F.lit(0)) / half).alias("bins")).where("parts > 1")
    large = F.col("n") > half
    sizes = written(sizes.join(groups, "grp").select("grp", "component", "n", "bins"), "wide-parts")
    rows = inside.join(sizes, ["grp", "component"])
    place = F.when(large, F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / half))).otherwise(F.pmod(F.xxhash64("component"), F.col("bins")))
    rows = rows.select("grp", "id", "value", "component", F.when(large, F.col("component")).alias("whole"), place.alias("place"))
    rows = written(rows.withColumn("chunk", F.xxhash64("grp", F.col("whole").isNull(), F.coalesce("whole", F.lit(0)), "place")), "wide-chunks")
    chunks = rows.select("grp", "chunk", "whole").distinct()
    x, y = (chunks.select("grp", F.col("chunk").alias(c), F.col("whole").alias(f"{c}_whole")) for c in "xy")
    met = x.join(y, "grp").where("x <= y and not coalesce(x_whole = y_whole, false)").select("grp", "x", "y")
    each = met.select("grp", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("chunk"))
    return rows.join(each, ["grp", "chunk"]).select(F.xxhash64("grp", "x", "y").alias("grp"), "id", "value", "component")


def _all_links(rows: DataFrame, link: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(a, b): links of spanning forests over the groups of `rows` (grp, id, value); groups over SPLIT_AT rows are compared in chunks."""
    size = rows.groupBy("grp").count().where(F.col("count") > SPLIT_AT)
    hot = written(size.select("grp", F.ceil(F.col("count") / SPLIT_AT).cast("int").alias("chunks")), "wide-hot")
    out = _joined(rows.join(hot, "grp", "left_anti"), link)
    if not hot.limit(1).count():
        return out
    inside = rows.join(F.broadcast(hot), "grp")  # as many groups as all rows / SPLIT_AT
    chunk = F.xxhash64("grp", F.pmod(F.xxhash64("id"), F.col("chunks")))
    out = written(out.unionByName(_joined(inside.withColumn("grp", chunk), link)), "wide-links")
    known = components(out, "wide-known")
    inside = inside.join(known, "id", "left").select("grp", "id", "value", F.coalesce("component", "id").alias("component"))
    return out.unionByName(_joined(_chunk_pairs(written(inside, "wide-inside")), link))


def links(prints: DataFrame, budget: int, words: int = WORDS) -> DataFrame:
    """(a, b): links of spanning forests over `prints` (id, fp), ids distinct. Bands that don't overlap are met at once, the others after them."""
    out = None
    for first in range(0, BAND_BITS, BAND_STEP):
        bands = []
        for at in range(first, 64 * words - BAND_BITS + 1, BAND_BITS):
            bands.append(F.xxhash64(F.lit(at), F.substring("fp", at // 8 + 1, BAND_BITS // 8)))
        rows = prints.select(F.explode(F.array(*bands)).alias("grp"), "id", F.col("fp").alias("value"))
        found = written(_all_links(rows, partial(_link_batches, budget=budget)), "wide-band-links")
        out = found if out is None else out.unionByName(found)
    return out


def duplicate_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, words: int = WORDS) -> DataFrame:
    """(doc_id, component_id) of every document id: the smallest id reachable over links of the similarity asked for."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    prints = written(arrow_map(rows, partial(_fingerprint_batches, size=size, words=words), "id long, fp binary"), "wide-fp")
    one = prints.groupBy("id").agg(F.min("fp").alias("fp"))
    distinct = written(one.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "wide-distinct")
    near = components(links(distinct.select("id", "fp"), budget_bits(similarity, 64 * words), words), "wide-near")
    near = written(distinct.select("id", "fp").join(near, "id"), "wide-candidates")
    few = near.limit(SENT_ROWS + 1).count() <= SENT_ROWS  # then texts needn't be shuffled
    near = F.broadcast(near) if few else near
    texts = rows.join(near.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    again = arrow_map(texts, partial(_fingerprint_batches, size=size, words=words, whole=True), "id long, fp binary, shingles array<long>")
    sets = again.join(near, ["id", "fp"]).dropDuplicates(["id"])
    sets = written(sets.select(F.col("component").alias("grp"), "id", F.col("shingles").alias("value")), "wide-sets")
    parts = components(_all_links(sets, partial(_set_batches, similarity=similarity)), "wide")
    known = distinct.join(parts, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return one.join(known, "fp").select(F.col("id").alias("doc_id"), "component_id")
