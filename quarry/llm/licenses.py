"""License scans: base phrases, and short notices found with a bounded number of edits.

A notice of n characters may differ in n // EDIT_EACH edits, at least one. It is split into one more piece than it may have edits, so
one piece stands exactly in every match (pigeonhole). An automaton of all pieces finds them in a text's normalised words;
around each the regex library searches the notice with its bound on errors and reports span and edits: the best match of a
window first, then of what is left before and after it. Windows of one notice are joined while they are short, so the work grows
with the number of seeds, not with its square. Of overlapping matches the one with the fewest edits for its length stays,
among equals the longest, then the first, then the notice that is listed first.

Inputs: a null or empty text has no words, no places, empty labels, null first and last words and score 0. Texts are scanned
whole, however long. Repeated doc_ids are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, documents

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices by label, as normalised words.
NOTICES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("bsd", "licensed under the bsd license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc0", "dedicated to the public domain under cc0 1 0"),
    ("all-rights-reserved", "all rights reserved"),
)
EDIT_EACH = 12
#: Bytes that end a word become spaces; A-Z become a-z.
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


class Match(NamedTuple):
    label: str
    first_word: int
    n_words: int
    start: int  # characters of the normalised words joined by one space
    end: int
    edits: int
    score: float


class Scan(NamedTuple):
    n_words: int
    base: list[tuple[int, str]]  # (first word, label) of every place
    found: list[Match]


def edits_of(notice: str) -> int:
    return max(1, len(notice) // EDIT_EACH)


def seeds(notice: str) -> list[tuple[int, str]]:
    """(offset, piece): one piece more than the notice may have edits."""
    k, n = edits_of(notice) + 1, len(notice)
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def compiled(notices: tuple[tuple[str, str], ...]) -> tuple[ahocorasick.Automaton, list[regex.Pattern]]:
    where: dict[str, list[tuple[int, int]]] = {}
    for i, (_, notice) in enumerate(notices):
        for offset, piece in seeds(notice):
            where.setdefault(piece, []).append((i, offset))
    automaton = ahocorasick.Automaton()
    for piece, places in where.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton, [regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(n, special_only=True)}){{e<={edits_of(n)}}}(?!\S)") for _, n in notices]


def scan(text: str | None, notices: tuple[tuple[str, str], ...] = NOTICES) -> Scan:
    """Words, base places and fuzzy matches of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()
    if not words:
        return Scan(0, [], [])
    joined = b" ".join(words).decode("utf-8", "surrogatepass")
    base, padded = [], f" {joined} "
    for phrase, label in BASE.items():
        at = padded.find(f" {phrase} ")
        seen, upto = 0, 0  # spaces before upto
        while at >= 0:
            seen, upto = seen + padded.count(" ", upto, at), at
            base.append((seen, label))
            at = padded.find(f" {phrase} ", at + 1)
    automaton, patterns = compiled(notices)
    windows: dict[int, list[list[int]]] = {}
    for end, (size, places) in automaton.iter(joined):
        for i, offset in places:
            notice, k = notices[i][1], edits_of(notices[i][1])
            lo, hi = end + 1 - size - offset - k, end + 1 - size - offset + len(notice) + k
            got = windows.setdefault(i, [])
            if got and got[-1][0] <= lo <= got[-1][1] and hi - got[-1][0] <= 2 * (len(notice) + 2 * k):
                got[-1][1] = max(got[-1][1], hi)
            else:
                got.append([lo, hi])
    hits: set[tuple[float, int, int, int, int]] = set()  # (edits for its length, start, end, notice, edits)
    for i, spans in windows.items():
        for lo, hi in spans:
            lo = joined.rfind(" ", 0, max(0, lo)) + 1
            hi = h if (h := joined.find(" ", min(hi, len(joined)))) >= 0 else len(joined)
            left = [(lo, hi + 1)]  # in the padded text, from the space before: no letter can be inserted where a search begins
            while left:
                lo, hi = left.pop()
                if m := patterns[i].search(padded, lo, hi):
                    edits = sum(m.fuzzy_counts)
                    hits.add((edits / len(notices[i][1]), m.start() - 1, m.end() - 1, i, edits))
                    left += [(lo, m.start()), (m.end(), hi)]
    found: list[Match] = []
    starts: list[int] = []  # of the spans taken so far, which do not overlap; and their ends
    ends: list[int] = []
    for cost, start, end, i, edits in sorted(hits, key=lambda h: (h[0], h[1] - h[2], h[1], h[3])):
        at = bisect_left(starts, end)
        if at and ends[at - 1] > start:
            continue
        starts.insert(at, start)
        ends.insert(at, end)
        found.append(Match(notices[i][0], 0, joined.count(" ", start, end) + 1, start, end, edits, round(1 - cost, 6)))
    found.sort(key=lambda m: m.start)
    seen, upto = 0, 0
    for k, m in enumerate(found):
        seen, upto = seen + joined.count(" ", upto, m.start), m.start
        found[k] = m._replace(first_word=seen)
    return Scan(len(words), sorted(base), found)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64()), ("score", pa.float64())]))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    for batch in batches:
        rows = []
        for x in batch.column(1):
            s = scan(x.as_py())
            base = {label for _, label in s.base}
            starts = [p for p, _ in s.base]
            score = 1.0 if base else max((m.score for m in s.found), default=0.0)
            rows.append((
                s.n_words, len(s.base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {m.label for m in s.found})), score,
                [{"label": m.label, "first_word": m.first_word, "n_words": m.n_words, "edits": m.edits, "score": m.score} for m in s.found],
            ))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): counts, base places, labels, score and the matches' spans and edits."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,n_words:long,edits:long,score:double>>"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan_batches, schema)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and notices."""
    return license_scan(documents(spark, sf_dir)).drop("matches")
