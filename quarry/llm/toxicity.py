"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks, trained on the sentences of labelled documents.

The kernel of two words is the gap-weighted count of the three-letter subsequences they share (letters up to SPAN apart; each
skipped letter costs a factor DECAY), on words with start and end marks, divided by the words' own weights, and sharpened by an
exponential. Inserted letters and gaps only weaken it; marks between letters are dropped first, and runs of single letters
are read as words. A sentence's margin is the greatest of its words'.

Learning takes sentences with their documents' labels, as bags of words (multiple instances). A sentence takes part as its best
word, by the last machine, at first by how over-represented words are in toxic documents. Of a toxic document few sentences are
to blame: those with a clearly over-represented word are positive first, then those that the last machine marks. All sentences of
clean documents are negative, each by its best word and by one that its hash picks, so the words nearest to insults count as
often as they stand in clean text. Both kinds also take part with a letter inserted and one doubled. A word is seen through its
kernel values with the landmarks only (Nyström), which a compact table of the landmarks' subsequences gives. A logistic model on
held-back training documents turns a document's number, share and best margin of marked words into the score.

Sentences end at a token that ends in . ! or ? and at a line's end. Words of more than LONG letters are
read in overlapping parts, of which each landmark takes the nearest; runs of more than eight single letters as the words of five to
eight letters in them. These rules hold for every text alike.

Inputs: null and empty texts have no words and get the score of a document without marked ones. Rows with null labels are not
learned from. If either class is missing, every score is 0. Repeated doc_ids are rows of their own; extra columns are
ignored. Texts are scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, documents
from quarry.session import table, written

SPAN, DECAY = 5, 0.6
#: Letters of a word beyond which it is read in overlapping parts, and how far these are apart.
LONG, STEP = 24, 12
CODES = 64
#: What learning takes at most: documents of each class, bytes of text, sentences of each class, by hash.
MAX_DOCS, MAX_BYTES, MAX_SENTENCES = 3000, 16_000_000, 40_000
#: Landmarks, rounds of multiple instances, standard errors from which a word is clearly over-represented.
LANDMARKS, ROUNDS, CLEAR = 128, 3, 4.0
#: Sharpness of the kernel, chosen on the documents held back.
SHARPNESS = (4.0, 8.0)
#: Weight of the sentences' errors against the machine's norm.
C = 3.0
#: Margins from which a word may count as marked; chosen like the sharpness.
MARKS = (0.4, 0.7, 1.0)
#: Toxic documents below which the logistic model learns from the same documents as the words.
FEW = 60
#: Words whose margins a worker remembers.
TABLE = 400_000
SPELLED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
CLOSERS = "\"')]}»”’"


class Machine(NamedTuple):
    """Margin of a word: sum over landmarks of weight * exp(sharpness * (kernel - 1)), plus bias."""

    row_of: np.ndarray  # by code of three letters: its row in `land`, 0 if no landmark has it
    land: np.ndarray  # weights of the landmarks' subsequences, a column a landmark
    sharpness: float
    weights: np.ndarray
    bias: float


class Model(NamedTuple):
    machine: Machine
    marked: float  # margin from which a word counts as marked
    logit: np.ndarray  # intercept, log1p(marked words), log1p(1000 * share), best margin


def letters(token: str) -> str:
    """The token's letters and nothing else, in lower case."""
    token = token.lower()
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def parts(word: str) -> list[str]:
    """The word, or overlapping parts of it if it is long."""
    return [word] if len(word) <= LONG else [word[i : i + LONG] for i in range(0, len(word) - LONG + STEP, STEP)]


def _offsets() -> list[tuple[int, int, float]]:
    return [(i, j, DECAY ** (j - 2)) for j in range(2, SPAN) for i in range(1, j)]


def _codes(words: list[str], n: int) -> np.ndarray:
    """Letters of words of one length as codes below CODES, with a start and an end mark."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n)
    low = points - 96
    code = np.where((points > 96) & (points < 123), low, 28 + points % (CODES - 28)).astype(np.int32)
    out = np.empty((len(words), n + 2), np.int32)
    out[:, 0], out[:, -1], out[:, 1:-1] = 0, 27, code
    return out


def subsequences(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all subsequences of words of length n, their weights, and what makes each word's vector one of unit norm."""
    c = _codes(words, n)
    width = n + 2
    found, weights = [], []
    for i, j, w in _offsets():
        if width > j:
            found.append((c[:, : width - j] * CODES + c[:, i : width - j + i]) * CODES + c[:, j:])
            weights.append(np.full(width - j, w))
    w, codes = np.concatenate(weights), np.concatenate(found, axis=1)
    scale = np.full(len(words), 1 / np.sqrt((w * w).sum()))
    order = np.argsort(codes, axis=1)
    low = np.take_along_axis(codes, order, 1)
    new = np.ones(low.shape, bool)
    new[:, 1:] = low[:, 1:] != low[:, :-1]
    twice = np.flatnonzero(~new.all(axis=1))
    if len(twice):  # equal subsequences add up
        sums = np.add.reduceat(w[order[twice]].ravel(), np.flatnonzero(new[twice].ravel()))
        scale[twice] = 1 / np.sqrt(np.add.reduceat(sums * sums, np.concatenate(([0], np.cumsum(new[twice].sum(axis=1))[:-1]))))
    return codes, w, scale


def _raw_kernels(words: list[str], row_of: np.ndarray, land: np.ndarray) -> np.ndarray:
    """Kernel of words of at most LONG letters with each landmark."""
    out = np.zeros((len(words), land.shape[1]), np.float32)
    by_length: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        by_length.setdefault(len(word), []).append(k)
    for n, at in by_length.items():
        if not n:
            continue
        for lo in range(0, len(at), 1000):
            some = np.array(at[lo : lo + 1000])
            codes, w, scale = subsequences([words[k] for k in some], n)
            rows = row_of[codes]
            hits = np.count_nonzero(rows, axis=1)
            rank = np.argsort(-hits, kind="stable")  # words of many hits first: the k-th hits of all words that have so many are added at once
            word, place = np.nonzero(rows[rank])
            slot = np.arange(len(word)) - np.searchsorted(word, word)
            at_row = np.zeros((int(hits.max(initial=0)), len(some)), np.int32)
            weight = np.zeros(at_row.shape, np.float32)
            at_row[slot, word], weight[slot, word] = rows[rank][word, place], w[place] * scale[rank][word]
            total = np.zeros((len(some), land.shape[1]), np.float32)
            for k, n_words in enumerate(np.searchsorted(-hits[rank], -np.arange(len(at_row)), "left").tolist()):
                total[:n_words] += land[at_row[k, :n_words]] * weight[k, :n_words, None]
            out[some[rank]] = total
    return out


def kernels(words: list[str], row_of: np.ndarray, land: np.ndarray, sharpness: float) -> np.ndarray:
    """exp(sharpness * (kernel - 1)) of words with each landmark; of a long word, its nearest part's."""
    out = _raw_kernels([w if len(w) <= LONG else "" for w in words], row_of, land)
    cut = [(k, part) for k, w in enumerate(words) if len(w) > LONG for part in parts(w)]
    for lo in range(0, len(cut), 10_000):
        some = cut[lo : lo + 10_000]
        np.maximum.at(out, [k for k, _ in some], _raw_kernels([x for _, x in some], row_of, land))
    return np.exp(np.float32(sharpness) * (out - 1))


def margins(words: list[str], machine: Machine) -> np.ndarray:
    """Margin of each word."""
    out = np.empty(len(words))
    for lo in range(0, len(words), 20_000):
        out[lo : lo + 20_000] = kernels(words[lo : lo + 20_000], *machine[:3]) @ machine.weights + machine.bias
    return out


def ends(token: str) -> bool:
    """Whether a sentence ends with the token."""
    return token.rstrip(CLOSERS)[-1:] in (".", "!", "?")


def spelled(text: str) -> list[str]:
    """Words that runs of four or more single characters spell; of long runs, the words of five to eight letters in them."""
    out = []
    for m in SPELLED.findall(text):
        run = m.replace(" ", "")
        out += [run] if len(run) <= 8 else [run[i : i + n] for n in (5, 6, 7, 8) for i in range(len(run) - n + 1)]
    return out


def tokens(text: str) -> list[str]:
    """White-space separated tokens, and spelled words."""
    return text.split() + spelled(text)


def sentences(text: str) -> list[list[str]]:
    """The text's sentences as letters of their words, without those that have none."""
    out: list[list[str]] = [[]]
    for line in text.splitlines():
        for token in line.split():
            if word := letters(token):
                out[-1].append(word)
            if out[-1] and ends(token):
                out.append([])
        if out[-1]:
            out.append([])
    out += [[w] for token in spelled(text) if (w := letters(token))]
    return [s for s in out if s]


def document_features(m: np.ndarray, marked: float) -> tuple[float, float, float]:
    """Of the words' margins: soft number of marked ones (a margin of 0.25 above the mark counts as one, less as its part), per mille, best margin."""
    if not len(m):
        return 0.0, 0.0, -2.0
    soft = float(np.clip((m - marked) / 0.25, 0.0, 1.0).sum())
    return float(np.log1p(soft)), float(np.log1p(1000 * soft / len(m))), float(np.clip(m.max(), -2.0, 2.0))


def _svm(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], c: float, steps: int = 40) -> np.ndarray:
    """Primal L2-regularised squared-hinge machine by Newton steps over parts (rows, signs, weights), some rows at a time; the last
    column is constant and not regularised."""
    width = parts[0][0].shape[1]
    w, reg = np.zeros(width), np.eye(width)
    reg[-1, -1] = 1e-6
    for _ in range(steps):
        g, h = reg @ w, reg.copy()
        for x, y, weight in parts:
            for lo in range(0, len(x), 10_000):
                some, sign = x[lo : lo + 10_000].astype(float), y[lo : lo + 10_000]
                gap = 1 - sign * (some @ w)
                on = gap > 0
                a = some[on] * weight[lo : lo + 10_000][on, None]
                g -= 2 * c * (a.T @ (sign[on] * gap[on]))
                h += 2 * c * (a.T @ some[on])
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def _rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, those of features that would count against toxicity set to 0."""
    on = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        w[on] = _logistic(x[:, on], y)
        if (w[1:] >= 0).all():
            return w
        on[1 + int(np.argmin(w[1:]))] = False


def firsts(texts: list[list[list[str]]]) -> np.ndarray:
    """Which texts, as sentences, are no near copies of an earlier one (the least hashes of their sentences under one of
    four pairs of salts agree)."""
    seen: set[tuple[int, int, int]] = set()
    out = np.ones(len(texts), bool)
    for k, text in enumerate(texts):
        base = np.array([zlib.crc32(" ".join(s).encode("utf-8", "surrogatepass")) for s in text if s], np.uint64)
        if not len(base):
            continue
        least = [int((((base + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15 + (salt << 33))) >> np.uint64(20)).min()) for salt in range(1, 9)]
        keys = {(salt, least[salt], least[salt + 1]) for salt in range(0, 8, 2)}
        out[k] = not keys & seen
        seen |= keys
    return out


def _landmarks(marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row of each code and the rows: how much of each landmark's unit vector is on the code."""
    found = [(m, subsequences([part], len(part))) for m, word in enumerate(marks) for part in parts(word)]
    codes = np.unique(np.concatenate([c[0] for _, (c, _, _) in found]))
    row_of = np.zeros(CODES**3, np.int32)
    row_of[codes] = np.arange(1, len(codes) + 1)
    land = np.zeros((len(codes) + 1, len(marks)), np.float32)
    several = np.bincount([m for m, _ in found], minlength=len(marks))  # a long landmark is the mean of its parts
    for m, (c, w, scale) in found:
        np.add.at(land, (row_of[c[0]], m), w * scale[0] / several[m])
    return row_of, land


def bent(word: str) -> list[str]:
    """The word with a letter inserted and with one doubled, at places its hash gives; itself if it is short."""
    if len(word) < 5:
        return [word, word]
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    at = 1 + h % (len(word) - 1)
    return [word[:at] + "xqzk"[h % 4] + word[at:], word[:at] + word[at - 1] + word[at:]]


def over_represented(toxic: list[set[str]], clean: list[set[str]]) -> dict[str, float]:
    """By word of toxic documents: how many standard errors the share of documents with it lies above the clean ones'."""
    pos, neg = Counter(w for bag in toxic for w in bag), Counter(w for bag in clean for w in bag)
    n_pos, n_neg, out = len(toxic), len(clean), {}
    for w, k in pos.items():
        if len(w) >= 2 and k >= 2:
            p1, p0, p = k / n_pos, (neg[w] + 0.5) / (n_neg + 1), (k + neg[w] + 0.5) / (n_pos + n_neg + 1)
            out[w] = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n_pos + 1 / n_neg) + 1e-12)
    return out


def _bounded(rows: list[list[str]], most: int) -> list[list[str]]:
    """At most `most` sentences, by their words' hash."""
    if len(rows) <= most:
        return rows
    marks = [zlib.crc32(" ".join(s).encode("utf-8", "surrogatepass")) for s in rows]
    return [rows[k] for k in sorted(sorted(range(len(rows)), key=lambda k: (marks[k], k))[:most])]


class Sample:
    """Labelled sentences and the kernel values of their words with the landmarks; machines of any sharpness are trained on it."""

    def __init__(self, texts: list[list[list[str]]], toxic: np.ndarray):
        """texts: documents as sentences of words."""
        bags = [set().union(*map(set, t)) if t else set() for t in texts]
        z = over_represented([b for b, t in zip(bags, toxic) if t], [b for b, t in zip(bags, toxic) if not t])
        rank = sorted(z, key=lambda w: (-z[w], w))
        often = Counter(w for b, t in zip(bags, toxic) if not t for w in b)
        clean = [w for w in sorted(often, key=lambda w: (-often[w], w)) if len(w) >= 2 and z.get(w, 0) < 1][: LANDMARKS // 4]
        self.marks = [w for w in rank if z[w] > 0][: LANDMARKS - len(clean)] + clean
        pos = _bounded([s for k, t in enumerate(texts) if toxic[k] for s in t], MAX_SENTENCES)
        neg = _bounded([s for k, t in enumerate(texts) if not toxic[k] for s in t], MAX_SENTENCES)
        self.n_pos, rows = len(pos), pos + neg
        self.vocab = sorted(set().union(*map(set, rows)))
        place = {w: k for k, w in enumerate(self.vocab)}
        self.words = np.fromiter((place[w] for s in rows for w in s), np.int64)
        self.first = np.cumsum([0, *map(len, rows)])[:-1]  # of each sentence
        self.z = np.array([z.get(w, -9.0) for w in self.vocab])
        hashed = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in self.vocab], float)
        self.picked = self.best(hashed)[0][self.n_pos :]
        if self.marks:
            self.row_of, self.land = _landmarks(self.marks)

    def best(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each sentence's first word of the greatest value, and that value."""
        if not len(self.first):
            return np.empty(0, np.int64), np.empty(0)
        own = value[self.words]
        top = np.maximum.reduceat(own, self.first)
        size = np.diff(np.append(self.first, len(own)))
        at = np.flatnonzero(own == np.repeat(top, size))
        sentence = np.searchsorted(self.first, at, "right") - 1
        return self.words[at[np.unique(sentence, return_index=True)[1]]], top

    def machine(self, sharpness: float) -> Machine | None:
        """The machine after ROUNDS rounds of multiple instances."""
        if not self.marks or not self.n_pos or self.n_pos == len(self.first):
            return None
        gram = kernels(self.marks, self.row_of, self.land, sharpness).astype(float)
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        root = vector / np.sqrt(np.maximum(value, 1e-3))  # from kernel values to Nyström features

        def features(words: list[str]) -> np.ndarray:
            x = np.ones((len(words), len(root) + 1), np.float32)
            for lo in range(0, len(words), 10_000):
                x[lo : lo + 10_000, :-1] = kernels(words[lo : lo + 10_000], self.row_of, self.land, sharpness) @ root.astype(np.float32)
            return x

        x = features(self.vocab)
        at, top = self.best(self.z)
        positive = at[: self.n_pos][top[: self.n_pos] >= CLEAR]
        if not len(positive):
            positive = at[: self.n_pos]
        w = None
        for step in range(ROUNDS):
            blocks = []
            for words, label, share in ((positive, 1.0, 0.15), (np.concatenate([at[self.n_pos :], self.picked]), -1.0, 0.85)):
                some, count = np.unique(words, return_counts=True)  # equal words are one row of their weight
                each = share * count / (3 * count.sum())
                for rows, times in ((x[some], 1), (features([b for k in some for b in bent(self.vocab[k])]), 2)):
                    blocks.append((rows, np.full(len(rows), label), np.repeat(each, times)))
            total = sum(len(rows) for rows, _, _ in blocks)
            w = _svm([(rows, y, weight * total) for rows, y, weight in blocks], C)
            del blocks
            if step < ROUNDS - 1:
                at, top = self.best(x @ w.astype(np.float32))
                marked = top[: self.n_pos] > 0
                positive = at[: self.n_pos][marked] if marked.any() else positive
        return Machine(self.row_of, self.land, sharpness, root @ w[:-1], float(w[-1]))


def learn(texts: list[str], toxic: np.ndarray, back: np.ndarray) -> Model | None:
    """The model of labelled whole texts. back: texts held back for the logistic model, unless FEW are toxic."""
    if toxic.all() or not toxic.any():
        return None
    one: dict[str, str] = {}  # equal words share one string
    cut = [[[one.setdefault(w, w) for w in s] for s in sentences(x)] for x in texts]
    own = firsts(cut)  # copies of one text would make all of its words look like witnesses
    cut, toxic, back = [s for s, o in zip(cut, own) if o], toxic[own], back[own]
    if toxic.all() or not toxic.any():
        return None
    if toxic.sum() < FEW or min((toxic & back).sum(), (~toxic & back).sum(), (~toxic & ~back).sum()) < 5:
        back = np.ones(len(cut), bool)
    fit = ~back if not back.all() else back
    sample = Sample([s for s, f in zip(cut, fit) if f], toxic[fit])
    best, y = None, toxic[back].astype(float)
    held = [s for s, b in zip(cut, back) if b]
    vocab = sorted(set().union(*(w for t in held for w in map(set, t))))
    for sharpness in SHARPNESS:
        machine = sample.machine(sharpness)
        if machine is None:
            return None
        margin = dict(zip(vocab, margins(vocab, machine).tolist()))
        found = [np.array([margin[w] for s in t for w in s]) for t in held]
        for marked in MARKS:
            x = np.array([(1.0, *document_features(m, marked)) for m in found])
            logit = _rising(x, y)
            p = 1 / (1 + np.exp(-np.clip(x @ logit, -30, 30)))
            loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
            if best is None or loss < best[0]:
                best = (loss, Model(machine, marked, logit))
    return best[1]


class Scorer:
    """Scores whole texts; remembers the margins of up to TABLE tokens."""

    def __init__(self, model: Model | None):
        self.model = model
        self.known: dict[str, float] = {}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(texts))
        found = [tokens(x) if x else [] for x in texts]
        known = self.known
        new = set().union(*map(set, found)).difference(known) if found else set()
        if len(known) + len(new) > TABLE:
            known.clear()
            new = set().union(*map(set, found))
        plain = dict(zip(new, map(letters, new)))
        words = list(set(plain.values()) - {""})
        margin = dict(zip(words, margins(words, self.model.machine).tolist())) | {"": np.nan}
        known.update([(raw, margin[word]) for raw, word in plain.items()])
        get = known.__getitem__
        out = np.empty(len(texts))
        for k, doc in enumerate(found):
            m = np.fromiter(map(get, doc), float, len(doc))
            x = np.array((1.0, *document_features(m[~np.isnan(m)], self.model.marked)))
            out[k] = 1 / (1 + np.exp(-np.clip(x @ self.model.logit, -30, 30)))
        return out


_last: list[Scorer] = []


def scorer(model: Model | None) -> Scorer:
    """The worker's scorer, kept as long as the model is the same object."""
    if not _last or _last[0].model is not model:
        _last[:] = [Scorer(model)]
    return _last[0]


def held_out() -> Column:
    """Whether a row is never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model | None:
    """The model from the labelled rows of `docs` that are not held out: a hash sample of each class within the bounds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    least = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(least) < 2:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))

    def chosen(share: dict[int, float]) -> Column:
        keep = F.lit(False)
        for toxic, part in share.items():
            keep = keep | ((F.col("toxic") == toxic) & (place < int(1_000_000 * min(1.0, part))))
        return keep

    few = known.where(chosen({t: max_docs / n for t, n in least.items()}))  # about max_docs ids of each class: small enough to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # a row an id, however often it stands there
    rows = written(rows, "toxicity-labelled")
    size = {r["toxic"]: r["b"] for r in rows.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    if len(size) < 2:
        return None
    keep = chosen({t: min(1.0, max_docs / least[t]) * max_bytes / 2 / max(b, 1) for t, b in size.items() if b > max_bytes / 2} | {t: 1.0 for t, b in size.items() if b <= max_bytes / 2})
    got = sorted(((r["doc_id"], r["text"], r["toxic"]) for r in rows.where(keep).select("doc_id", "text", "toxic").toLocalIterator()), key=lambda r: (r[0], r[1]))
    back = np.array([zlib.crc32(b"back%d" % i) % 3 == 0 for i, _, _ in got], bool)
    return learn([x for _, x, _ in got], np.array([t == 1 for _, _, t in got], bool), back)


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row of `docs` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the landmarks' subsequences and weights: about 10 MB

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value).score
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batches, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = scores(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model of its folds 0, 1 and 3."""
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
