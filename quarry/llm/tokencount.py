"""Token counts by section: whole documents are encoded once, tokens belong to sections by their character spans.

A section is a line with the newline that ends it, so sections cover a text without gaps. A token's span follows from the
bytes its id stands for (byte-level tokens are the text's own bytes); a token that holds a part of a character has that
character's span, as the tokenizers library reports it. Tokens and sections are joined as intervals. A token that crosses
an edge goes, whole, to the section that holds most of its characters, among equals to the first.

Inputs: a null or empty text has one section, without tokens. Repeated doc_ids are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import vocabulary
from quarry.llm.common import arrow_map, documents
from quarry.llm.library import gathered, library

SCHEMA = "doc_id long, section int, first_char long, n_chars long, n_tokens long, n_crossing long"


def spans(raw: np.ndarray, byte_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one character of each token, of a text's bytes and its tokens' numbers of bytes."""
    ends = np.cumsum(byte_sizes)
    begins = ends - byte_sizes
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # character of each byte
    return char[begins], char[ends - 1] + 1


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and tokens that cross an edge, by section. starts: first character of each section, from 0."""
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, last - 1, "right") - 1
    owner = a.copy()
    crossing = np.flatnonzero(a != b)
    edge = np.append(starts, np.iinfo(np.int64).max)
    for t in crossing.tolist():
        best = -1
        for s in range(a[t], b[t] + 1):
            held = min(last[t], edge[s + 1]) - max(first[t], edge[s])
            if held > best:
                best, owner[t] = held, s
    return np.bincount(owner, minlength=len(starts)), np.bincount(owner[crossing], minlength=len(starts))


def _batches(it: Iterator[pa.RecordBatch], vocab: Broadcast) -> Iterator[pa.RecordBatch]:
    encoder = library(vocab.value)
    if not encoder.as_expected:
        raise ValueError("tokens' spans follow from their bytes in byte-level BPE only")
    sizes = encoder.lengths
    for batch in gathered(it, 1):
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        texts = batch.column(1).to_pylist()
        for doc, text, ids in zip(batch.column(0).to_pylist(), texts, encoder.encode_all(batch.column(1)).to_pylist()):
            text, ids = text or "", np.frombuffer(ids, encoder.dtype)
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            after = np.flatnonzero(raw == 10) + 1  # bytes at which a line may begin
            after = after[after < len(raw)]
            char = np.cumsum((raw & 0xC0) != 0x80) - 1
            starts = np.concatenate(([0], char[after])).astype(np.int64)
            if len(ids):
                tokens, crossing = attribute(*spans(raw, sizes[ids]), starts)
            else:
                tokens = crossing = np.zeros(1, np.int64)
            n = len(starts)
            for column, x in zip(out, ([doc] * n, np.arange(n), starts, np.diff(np.append(starts, len(text))), tokens, crossing)):
                column.extend(x if isinstance(x, list) else x.tolist())
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def section_tokens(docs: DataFrame, vocab: Broadcast) -> DataFrame:
    """A row for each section of every row of `docs` (doc_id, text)."""
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda it: _batches(it, vocab), SCHEMA)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_tokens(documents(spark, sf_dir), vocabulary(spark))
