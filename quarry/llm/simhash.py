"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary-trie self-join.

`fingerprints` makes one row per document. `links` finds which distinct fingerprints differ in few bits: fingerprints
that differ in at most `budget` bits agree wholly in one of budget + 1 blocks (pigeonhole), so each is dealt once per
block; a partition then holds tries whose first bits are a block, and two nodes of a trie are walked together, adding
up their differing bits and dropping the pair once they exceed the budget. Blocks that too many fingerprints share are
split again by blocks of their other bits, up to three levels, before they reach a task. A task returns a spanning
forest of its links, never all pairs of a group.

Links and components are between fingerprints, so rows without an id link others like any row does. Documents meet their component
by fingerprint; where a third of them share one, such as that of the empty text, Spark splits that join's partition (skewJoin, set
in the session and on by default).

Inputs: null and empty texts have fingerprint zero, linked like any other. Repeated doc_ids are rows of their own with
the same id; rows without an id get the smallest id of their component, null if it has none. Empty tables give empty results. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, components, documents
from quarry.session import written

BITS = 64
#: Members of a block beyond which it is split by a block of the other bits, and levels of splitting.
SPLIT_AT, LEVELS = 4096, 3
#: Node pairs expanded at once, pairs of keys below which two nodes are compared directly, and such pairs at once.
FRONTIER, DIRECT, AT_ONCE = 400_000, 4096, 2_000_000


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between runs of space, tab, newline, vertical tab, form feed and return."""
    return text.lower().split()


def shingle_hashes(text: bytes | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `size` words, repeats included; of the whole sequence if it is shorter; none if empty."""
    found = words(text) if text else []
    if not found:
        return np.empty(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(found)
    if len(found) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; no hashes: 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        prints = np.array([fingerprint(shingle_hashes(x.as_py(), size)) for x in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), partial(_fingerprint_batches, size=size), "doc_id long, fp long")


def blocks(n: int, low: int = 0, high: int = BITS) -> list[tuple[int, int]]:
    """n runs of bits [low, high), as even as can be."""
    edges = [low + (high - low) * i // n for i in range(n + 1)]
    return list(zip(edges[:-1], edges[1:]))


def _free(taken: tuple[tuple[int, int], ...]) -> list[int]:
    return [b for b in range(BITS) if not any(lo <= b < hi for lo, hi in taken)]


def group_links(keys: np.ndarray, cuts: np.ndarray, budget: int, parent: np.ndarray | None = None, prefix: int = 0, direct_to: int = DIRECT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a spanning forest of each group's keys within `budget` bits, and each key's component. keys: rows of 64-bit words, sorted
    within groups; cuts: where groups begin, and the end.

    A group's keys are a trie, a node is a run of keys that agree in the bits so far. Pairs of nodes go down together a bit at a time,
    adding up their differing bits; a pair over the budget, or whose keys are known to be one component already, is dropped, and
    a small one is compared directly. prefix: bits in which all keys of a group agree. parent: the first key of each key's
    component, as far as it is known; links inside of it are left out. direct_to: pairs of keys that are compared directly."""
    n = len(keys)
    parent = np.arange(n) if parent is None else parent
    runs = np.cumsum(np.concatenate(([0], (parent[1:] != parent[:-1]).astype(np.int64))))
    out_a, out_b = [], []

    def union(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal parent, runs
        while True:
            ra, rb = parent[a], parent[b]
            keep = ra != rb
            a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
            if not len(a):
                break
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            _, first = np.unique(hi, return_index=True)
            out_a.append(a[first])
            out_b.append(b[first])
            parent[hi[first]] = lo[first]
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
        runs = np.cumsum(np.concatenate(([0], (parent[1:] != parent[:-1]).astype(np.int64))))

    def split(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if bit not in ones:
            ones.clear()
            ones[bit] = np.concatenate(([0], np.cumsum((keys[:, bit // 64] >> np.uint64(63 - bit % 64)) & np.uint64(1), dtype=np.int64)))
        return hi - (ones[bit][hi] - ones[bit][lo])

    ones: dict[int, np.ndarray] = {}
    bits = 64 * keys.shape[1]
    lo, hi = cuts[:-1], cuts[1:]
    more = hi - lo > 1
    stack = [(prefix, np.stack([lo[more], hi[more], lo[more], hi[more], np.zeros(int(more.sum()), np.int64)]))]
    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            stack += [(bit, x) for x in reversed(np.array_split(pairs, -(-pairs.shape[1] // FRONTIER), axis=1))]
            continue
        one = (runs[pairs[0]] == runs[pairs[1] - 1]) & (runs[pairs[2]] == runs[pairs[3] - 1]) & (parent[pairs[0]] == parent[pairs[2]])
        pairs = pairs[:, ~one]
        if not pairs.shape[1]:
            continue
        size = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
        direct = size <= direct_to if bit < bits else size >= 0
        near, far, size = pairs[:, direct], pairs[:, ~direct], size[direct]
        while near.shape[1]:
            k = max(1, int(np.searchsorted(np.cumsum(size), AT_ONCE, "right")))
            some, n_some, near, size = near[:, :k], size[:k], near[:, k:], size[k:]
            which = np.repeat(np.arange(len(n_some)), n_some)
            step = np.arange(len(which)) - np.repeat(np.cumsum(n_some) - n_some, n_some)
            width = (some[3] - some[2])[which]
            a, b = some[0][which] + step // width, some[2][which] + step % width
            on = (a < b) & (parent[a] != parent[b])
            a, b = a[on], b[on]
            d = np.zeros(len(a), np.int64)
            for w in range(keys.shape[1]):  # differing bits add up word by word; pairs over the budget drop out
                d += np.bitwise_count(keys[a, w] ^ keys[b, w])
                if w + 1 < keys.shape[1]:
                    on = d <= budget
                    a, b, d = a[on], b[on], d[on]
            union(a[d <= budget], b[d <= budget])
        if not far.shape[1]:
            continue
        la, ha, lb, hb, d = far
        ma, mb = split(la, ha, bit), split(lb, hb, bit)
        cross = la != lb
        grown = np.concatenate([np.stack([la, ma, mb, hb, d + 1]), np.stack([ma, ha, lb, mb, d + 1])[:, cross], np.stack([la, ma, lb, mb, d]), np.stack([ma, ha, mb, hb, d])], axis=1)
        stack.append((bit + 1, grown[:, (grown[0] < grown[1]) & (grown[2] < grown[3]) & (grown[4] <= budget)]))
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64), parent
    return np.concatenate(out_a), np.concatenate(out_b), parent


def trie_links(keys: np.ndarray, prefix: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over sorted distinct `keys` that agree in `prefix` high bits and differ in <= budget."""
    high = keys >> np.uint64(BITS - prefix) if prefix else np.zeros(len(keys), np.uint64)
    cuts = np.concatenate(([0], np.flatnonzero(high[1:] != high[:-1]) + 1, [len(keys)]))
    a, b, _ = group_links(keys[:, None], cuts, budget, prefix=prefix, direct_to=64)  # a comparison of one word is cheap, but so is a step down
    return a, b


def _taken_bits(levels: str) -> tuple[tuple[int, int], ...]:
    return tuple(tuple(map(int, x.split("-"))) for x in levels.split(",") if x)


def _link_batches(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """A partition's rows (block path, key of the group, fp, id), sorted by path and group: links of each path's tries.

    Groups of one path are walked as one trie whose first bits are the group's, in blocks of whole groups."""
    held: list[pa.RecordBatch] = []

    def flush(path: str) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held)
        group, fp, ids = (t.column(i).to_numpy() for i in (1, 2, 3))
        fp = fp.view(np.uint64)
        bits = [b for lo, hi in _taken_bits(path) for b in range(lo, hi)]
        order = [*bits, *_free(_taken_bits(path))]
        keys = np.zeros(len(fp), np.uint64)  # the fingerprint with the path's bits moved to the top
        for at, b in enumerate(order):
            keys |= ((fp >> np.uint64(BITS - 1 - b)) & np.uint64(1)) << np.uint64(BITS - 1 - at)
        rank = np.argsort(keys, kind="stable")
        a, b = trie_links(keys[rank], len(bits), budget)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids[rank[a]]), pa.array(ids[rank[b]])], ["a", "b"]) if len(a) else None

    at, rows = None, 0
    for batch in batches:
        paths = batch.column(0).to_numpy(zero_copy_only=False)
        groups = batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((paths[1:] != paths[:-1])) + 1).tolist(), len(paths)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if held and (paths[lo] != at[0] or (rows >= 500_000 and groups[lo] != at[1])):
                if (out := flush(at[0])) is not None:
                    yield out
                rows = 0
            held.append(batch.slice(lo, hi - lo))
            at, rows = (paths[hi - 1], groups[hi - 1]), rows + hi - lo
    if held and (out := flush(at[0])) is not None:
        yield out


def _value(lo: int, hi: int):
    """Bits lo..hi-1 of column fp, counted from the top."""
    return F.shiftrightunsigned("fp", BITS - hi).bitwiseAND((1 << (hi - lo)) - 1)


def _deal(prints: DataFrame, taken: tuple[tuple[int, int], ...], budget: int) -> DataFrame:
    """`prints` once per block of the bits that are not taken: (path, grp, fp, id); equal grp: all bits of the path agree."""
    free = _free(taken)
    parts = []
    for lo, hi in blocks(budget + 1, 0, len(free)):
        bits = free[lo:hi]
        runs, start = [], bits[0]  # the free bits may straddle a taken run
        for x, y in zip(bits, [*bits[1:], None]):
            if y != x + 1:
                runs.append((start, x + 1))
                start = y
        path = (*taken, *runs)
        parts.append(F.struct(F.lit(",".join(f"{a}-{b}" for a, b in path)).alias("path"), F.xxhash64(*[_value(a, b) for a, b in path]).alias("grp")))
    return prints.select(F.explode(F.array(*parts)).alias("x"), "fp", "id").select("x.path", "x.grp", "fp", "id")


def links(prints: DataFrame, budget: int, name: str = "simhash") -> DataFrame:
    """(a, b) of a spanning forest's links between ids of distinct fingerprints `prints` (id, fp) within `budget` bits."""
    spark = prints.sparkSession
    dealt, paths, ready = _deal(prints, (), budget), [()], []
    for level in range(LEVELS):
        if level == LEVELS - 1:
            ready.append(dealt)
            break
        dealt = written(dealt, f"{name}-dealt{level}")
        size = dealt.groupBy("path", "grp").count()
        hot = written(size.where(F.col("count") > SPLIT_AT).select("path", "grp"), f"{name}-hot{level}")
        paths = [r["path"] for r in hot.select("path").distinct().collect()]  # at most (budget + 1) ** level of them
        if not paths:
            ready.append(dealt)
            break
        ready.append(dealt.join(hot, ["path", "grp"], "left_anti"))
        inside = dealt.join(hot, ["path", "grp"], "left_semi")
        parts = [_deal(inside.where(F.col("path") == p).select("fp", "id"), _taken_bits(p), budget) for p in paths]
        dealt = parts[0]
        for p in parts[1:]:
            dealt = dealt.unionByName(p)
    rows = ready[0]
    for r in ready[1:]:
        rows = rows.unionByName(r)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(width, "path", "grp").sortWithinPartitions("path", "grp")
    return arrow_map(dealt, partial(_link_batches, budget=budget), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per document; component_id the smallest doc_id reachable over links of <= budget bits."""
    prints = written(fingerprints(docs, size, id_col, text_col), "simhash-fp")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-distinct")
    parts = components(links(distinct.select("fp", F.col("fp").alias("id")), budget), "simhash").withColumnRenamed("id", "fp")
    known = written(distinct.join(parts, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component")), "simhash-known")
    least = known.groupBy("component").agg(F.min("id").alias("component_id"))
    return prints.join(known.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    """A long column as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, fingerprints linked at 4 or fewer differing bits, over every document."""
    found = near_duplicates(documents(spark, sf_dir), size=4, budget=4)
    return found.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")
