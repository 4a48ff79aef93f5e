"""Quality rules: a base rule on text statistics, then a decision list learned by sequential covering.

`statistics` makes one row of numbers per whole text. `learn` takes labelled rows and covers the rejected class rule by
rule: a rule grows by the threshold of the best information gain on two thirds of the rows, is pruned from its end on the
other third, and joins the list only if it is precise there. `verdict` turns the list into one ordered Spark conditional.

Inputs: a null or empty text has no words (all counts 0; base_failed, not kept). Repeated doc_ids are rows of their own.
Without labelled rows of both classes the list is empty and only the base rule decides. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, documents
from quarry.session import table, written

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What a rule's thresholds are on: ratios, so that a rule holds for any length.
FEATURES = ("word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "distinct_ratio")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in FEATURES)
#: Labelled rows that a list is learned from, at most: a hash sample of the labelled documents' statistics.
MAX_LABELLED = 60_000

Rule = tuple[tuple[str, str, float], ...]


def repeat_words(words: list) -> int:
    """Words inside 3-word windows that are found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    twice = {w for w, n in Counter(windows).items() if n > 1}
    total, upto = 0, 0  # words before `upto` are counted already
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def measure(text: str | None) -> tuple:
    """The numbers of SCHEMA after doc_id, for a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    size = lambda chars: len(raw) - len(raw.translate(None, chars))
    letters = len(text) - size(SPACE)
    symbols, n = size(SYMBOLS), len(words)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    dup, repeat = len(lines) - len(set(lines)), repeat_words(words)
    each = lambda x, of: x / of if of else 0.0
    return (
        n, letters, symbols, dup, repeat,
        each(letters, n), each(symbols, n), each(dup, len(lines)), each(repeat, n),
        each(size(UPPER), letters), each(size(DIGITS), letters), each(size(MARKS), n), each(len(set(words)), n),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        columns = zip(*(measure(x.as_py()) for x in batch.column(1))) if batch.num_rows else []
        kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(FEATURES)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] or [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, ratios) of every row of `docs` (doc_id, text)."""
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _measure_batches, SCHEMA)


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    """The base rule; `of` gives the column of a number's name."""
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, sign, cut in rule:
        v = x[:, FEATURES.index(name)]
        hit &= v > cut if sign == ">" else v <= cut
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], longest: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < longest:
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        if not n0:
            break
        best, gain = None, 1e-9
        before = np.log2(p0 / (p0 + n0))
        for f, name in enumerate(FEATURES):
            v, b = x[inside, f], bad[inside]
            for sign in (">", "<="):
                hit = v[:, None] > cuts[f][None, :] if sign == ">" else v[:, None] <= cuts[f][None, :]
                p, n = (hit & b[:, None]).sum(0), (hit & ~b[:, None]).sum(0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -1.0)
                if len(g) and g.max() > gain:
                    gain, best = g.max(), (name, sign, float(cuts[f][int(g.argmax())]))
        if best is None:
            break
        rule += (best,)
        inside &= _covers((best,), x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[Rule, int, int]:
    """The rule's shortest start of the best (p - n) / (p + n), and its p and n."""
    best = None
    for k in range(1, len(rule) + 1):
        hit = _covers(rule[:k], x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if best is None or worth > best[0] + 1e-9:
            best = (worth, rule[:k], p, n)
    return best[1:] if best else ((), 0, 0)


def _centred(rule: Rule, x: np.ndarray) -> Rule:
    """Each threshold halfway between the nearest values on its two sides, among rows that meet the other conditions."""
    out = []
    for i, (name, sign, cut) in enumerate(rule):
        v = x[_covers(rule[:i] + rule[i + 1 :], x), FEATURES.index(name)]
        low, high = v[v <= cut], v[v > cut]
        out.append((name, sign, float((low.max() + high.min()) / 2) if len(low) and len(high) else cut))
    return tuple(out)


def learn(x: np.ndarray, bad: np.ndarray, third: np.ndarray, precision: float = 0.95, longest: int = 4, most: int = 16, n_cuts: int = 48) -> list[Rule]:
    """Rules that reject, in order. x: rows of FEATURES; bad: labelled 0; third: rows kept for pruning."""
    rules: list[Rule] = []
    if not bad.any() or bad.all():
        return rules
    left = np.ones(len(x), bool)
    while len(rules) < most:
        g, v = left & ~third, left & third
        if bad[g].sum() < 5:
            break
        cuts = [np.unique(np.concatenate([np.quantile(x[g, f], np.linspace(0, 1, n_cuts)), np.quantile(x[g & bad, f], np.linspace(0, 1, n_cuts))])) for f in range(len(FEATURES))]
        rule, p, n = _prune(_grow(x[g], bad[g], cuts, longest), x[v], bad[v])
        if not rule or p < 3 or p / (p + n) < precision:
            break
        rule = _centred(rule, x[left])
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def verdict(rules: list[Rule], of: Callable[[str], Column] = F.col) -> Column:
    """True unless a rule of the list rejects: WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true."""
    out = F
    for rule in rules:
        cond = F.lit(True)
        for name, sign, cut in rule:
            cond = cond & (of(name) > cut if sign == ">" else of(name) <= cut)
        out = out.when(cond, F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def learned(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The list for `stats`, from `labels` (doc_id, quality): a hash sample of at most about `max_labelled` rows."""
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    total = known.count()
    if total > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / total))
    rows = stats.where(~base_failed()).join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*FEATURES)).alias("x"))  # a row an id, however often it stands there
    rows = rows.select("doc_id", "quality", "x.*").toPandas().sort_values("doc_id", kind="stable")
    third = np.array([zlib.crc32(b"prune%d" % i) % 3 == 0 for i in rows["doc_id"]], bool)
    return learn(rows[list(FEATURES)].to_numpy(float), (rows["quality"] == 0).to_numpy(bool), third)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, ratios, base_failed, kept) of every document."""
    stats = written(statistics(docs), "quality-stats")
    rules = learned(stats, labels)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, base rule and verdict."""
    return quality(documents(spark, sf_dir), table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept")


def flat(rules: list[Rule]) -> list[str]:
    """The list as text."""
    return [" AND ".join(chain.from_iterable([f"{a} {s} {c:g}"] for a, s, c in rule)) for rule in rules]
