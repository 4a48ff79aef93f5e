"""Token ids as files of canonical, length-limited Huffman codes.

A file set is two Parquet tables of binary blocks: `codes` (symbol, length) and `blocks`. Code lengths come from the ids'
counts over all documents by package-merge under a limit of bits; codes are canonical, so lengths are all that is stored. A
block holds whole documents' ids, most significant bit first, with the bit offset of every STRIDE-th id, so a reader decodes
a block without any other, and all checkpoints of it side by side with one table look-up an id.

Documents are written in ascending order of their id column: ranges of it are the files, rows inside are sorted. Repeated
ids stand side by side, in the order of their texts' hashes; nulls come first. Null and empty texts are documents of the end
id alone. An empty table gives empty files. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import vocabulary
from quarry.llm.common import arrow_map, bounded, documents
from quarry.llm.library import gathered, library
from quarry.session import scratch_path, written

END, STRIDE, BLOCK_TOKENS, MAX_BITS, COUNTS = 2, 256, 1 << 16, 16, -1


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code length of each symbol (0: not used) of the least total under the limit, by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols do not fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, weights = [], leaf
    is_leaf = np.ones(len(leaf), bool)
    for _ in range(max_bits):
        levels.append(is_leaf)
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        rank = np.argsort(both, kind="stable")
        weights, is_leaf = both[rank], rank < len(leaf)
    take, deep = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        deep[:n] += 1
        take = 2 * (take - n)
        if not take:
            break
    lengths[order] = deep
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by symbol: in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for s in order.tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


class Encoder(NamedTuple):
    codes: np.ndarray
    lengths: np.ndarray

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Packed bits of the ids and the bit offset of every STRIDE-th."""
        size = self.lengths[ids]
        ends = np.cumsum(size, dtype=np.int64)
        at = ends - size
        total = int(ends[-1]) if len(ends) else 0
        low = (at & 7).astype(np.uint32)
        value = self.codes[ids] << (np.uint32(32) - size - low)  # a code of up to 24 bits within 32 of its byte
        byte, n = at >> 3, (total + 7) // 8
        out = np.zeros(n + 4, np.float64)
        for k in range((int(size.max(initial=1)) + 14) // 8):
            out[k:] += np.bincount(byte, ((value >> np.uint32(24 - 8 * k)) & np.uint32(255)).astype(np.float64), n + 4)[: n + 4 - k]
        return out[:n].astype(np.uint8).tobytes(), at[::STRIDE]


class Decoder:
    """Decodes blocks by a table of all bit patterns of the longest code's length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=0)))
        self.entry = np.ones(1 << self.bits, np.uint32)  # symbol and length of the code a bit pattern begins with
        codes = canonical(lengths)
        for s in np.flatnonzero(lengths).tolist():
            n = int(lengths[s])
            lo = int(codes[s]) << (self.bits - n)
            self.entry[lo : lo + (1 << (self.bits - n))] = s << 6 | n

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
        """The ids of each block: every checkpoint of every block is a lane, and all lanes take a step at once."""
        if not payloads:
            return []
        raw = np.frombuffer(b"".join(payloads) + b"\0\0\0\0", np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        base = np.cumsum([0] + [len(p) for p in payloads])[:-1]
        at = np.concatenate([8 * b + c for b, c in zip(base, checkpoints)])
        left = np.concatenate([np.minimum(STRIDE, n - STRIDE * np.arange(len(c))) for n, c in zip(sizes, checkpoints)])
        out = np.zeros((STRIDE, len(at)), np.uint32)
        shift, mask = np.uint32(32 - self.bits), np.uint32((1 << self.bits) - 1)
        for step in range(int(left.max(initial=0))):
            lane = np.flatnonzero(left > step) if step >= left.min() else slice(None)
            pos = at[lane]
            entry = self.entry[(window[pos >> 3] >> (shift - (pos & 7).astype(np.uint32))) & mask]
            out[step, lane] = entry >> np.uint32(6)
            at[lane] = pos + (entry & np.uint32(63))
        out = np.ascontiguousarray(out.T)
        found, lane = [], 0
        for n, c in zip(sizes, checkpoints):
            found.append(out[lane : lane + len(c)].reshape(-1)[:n])
            lane += len(c)
        return found


def _id_batches(it: Iterator[pa.RecordBatch], vocab: Broadcast, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder, part, seq = library(vocab.value), TaskContext.get().partitionId(), 0
    tail, total = pa.scalar(np.array([end], encoder.dtype).tobytes()), np.zeros(max(encoder.size, end + 1), np.int64)
    names = ["part", "seq", "doc_id", "ids"]
    for batch in gathered(it, 1):
        n = batch.num_rows
        ids = pc.binary_join_element_wise(encoder.encode_all(batch.column(1)), tail, b"") if n else pa.array([], pa.binary())
        for lo in range(0, n, 100):
            some = pa.concat_arrays([ids.slice(lo, 100)])
            at = np.frombuffer(some.buffers()[1], np.int32)[[some.offset, some.offset + len(some)]]
            total += np.bincount(np.frombuffer(some.buffers()[2], np.uint8)[at[0] : at[1]].view(encoder.dtype), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), batch.column(0), ids], names)
        seq += n
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([COUNTS], pa.int64()), pa.array([None], pa.int64()), pa.array([total.tobytes()], pa.binary())], names)


def token_ids(docs: DataFrame, vocab: Broadcast, end: int = END) -> DataFrame:
    """(part, seq, doc_id, ids): little-endian ids with the end id; part and seq count up with doc_id. A row of seq COUNTS ends each part: how often each id stands in it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges from the ids alone, so that no text is read to find them
    at = rows.agg(F.percentile_approx("doc_id", [i / width for i in range(1, width)] or [0.5], 100 * width).alias("q")).first()["q"]
    shared = docs.sparkSession.sparkContext.broadcast(np.unique(np.array(at or [], np.int64))[: width - 1])

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        value = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(shared.value, value, "left").astype(np.int32))

    bounded(docs.sparkSession)
    ranged = rows.withColumn("part", part("doc_id")).repartitionById(width, "part").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return arrow_map(ranged.select("doc_id", "text"), lambda it: _id_batches(it, vocab, end), "part int, seq long, doc_id long, ids binary")


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id stands in all documents: the parts' counts summed in Spark; a row an id, at most."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in it:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["symbol", "n"])

    out = np.zeros(size, np.int64)
    parts = ids.where(F.col("seq") == COUNTS).select("ids")
    for r in arrow_map(parts, batches, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        out[r["symbol"]] = r["n"]
    return out


BLOCKS = "part int, first long, n_tokens long, payload binary, checkpoints binary, doc_ids array<long>, doc_tokens array<long>"
_BLOCK_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def encode_files(ids: DataFrame, lengths: np.ndarray, dtype: str, path: str) -> None:
    """Write the file set under `path`. A block holds a run of a part's documents; `first` is the run's first seq."""
    spark = ids.sparkSession
    spark.createDataFrame([(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)], "symbol int, length int").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast(Encoder(canonical(lengths), lengths.astype(np.uint32)))  # 8 bytes an id of the vocabulary
    width = np.dtype(dtype).itemsize

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, owners = shared.value, [], []
        part = first = size = -1

        def flush() -> pa.RecordBatch:
            sizes = [len(x) // width for x in held]
            bits, marks = encoder.encode(np.frombuffer(b"".join(held), dtype))
            row = [part, first, sum(sizes), bits, marks.astype("<u8").tobytes(), list(owners), sizes]
            held.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _BLOCK_KINDS)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in it:
            for p, seq, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (p != part or seq != first + len(held) or size >= BLOCK_TOKENS):
                    yield flush()
                if not held:
                    part, first, size = p, seq, 0
                held.append(raw)
                owners.append(doc)
                size += len(raw) // width
        if held:
            yield flush()

    arrow_map(ids.where(F.col("seq") != COUNTS).select("part", "seq", "doc_id", "ids"), batches, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def decode_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a file set, from its files alone."""
    code = spark.read.parquet(f"{path}/codes").collect()  # a row an id of the vocabulary
    lengths = np.zeros(1 + max([r["symbol"] for r in code], default=0), np.uint8)
    for r in code:
        lengths[r["symbol"]] = r["length"]
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for whole in it:
            for at in range(0, whole.num_rows, 16):  # some blocks at a time: a megabyte of lanes
                batch = whole.slice(at, 16)
                part, first, sizes, payloads, marks, owners, tokens = (c.to_pylist() for c in batch.columns)
                rows: list[tuple] = []
                for p, f, ids, docs, ns in zip(part, first, decoder.decode(payloads, [np.frombuffer(m, "<u8").astype(np.int64) for m in marks], sizes), owners, tokens):
                    ids, lo = ids.astype("<u4"), 0
                    for doc, n in zip(docs, ns):
                        own = ids[lo : lo + n]
                        rows.append((p, f, lo, doc, n, zlib.crc32(own.tobytes()), own.astype("<i4") if keep_ids else None))
                        lo += n
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                columns = list(zip(*rows)) or [()] * 7
                n = 7 if keep_ids else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds[:n])], ["part", "first", "inside", "doc_id", "n_tokens", "ids_crc32", "ids"][:n])

    schema = "part int, first long, inside long, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    found = arrow_map(blocks, batches, schema)
    # tokens before a block: of its part's earlier blocks, and of the earlier parts (a row a part, of which there are as many as files)
    before = Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "first", "n_tokens").withColumn("ahead", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    totals, ahead = [], 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["part"]):
        totals.append((r["part"], ahead))
        ahead += r["n"]
    base = spark.createDataFrame(totals, "part int, base long")
    starts = starts.join(F.broadcast(base), "part").select("part", "first", (F.col("base") + F.col("ahead")).alias("block_start"))
    return found.join(starts, ["part", "first"]).select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def write_files(docs: DataFrame, path: str, vocab: Broadcast, end: int = END, max_bits: int = MAX_BITS) -> None:
    """Encode every row of `docs` (doc_id, text) into a file set under `path`."""
    ids = written(token_ids(docs, vocab, end), "huffman-ids", compression="snappy")
    known = library(vocab.value)
    lengths = code_lengths(id_counts(ids, max(known.size, end + 1)), max_bits)
    encode_files(ids, lengths, known.dtype, path)


def op5_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as Huffman files and read back."""
    path = scratch_path(spark, "huffman")
    write_files(documents(spark, sf_dir), path, vocabulary(spark))
    return decode_files(spark, path)
