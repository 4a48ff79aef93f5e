"""Byte-level BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

`Merges` holds a merge list and its sufficient lookahead: how many bytes past a boundary can still change whether it is
one. `Stream` takes a text in pieces and gives ids as soon as no continuation can change them; what it holds is bounded by
the lookahead, whatever the text's or a word's length. `Decoder` turns ids into text piece by piece: bytes that are an
unfinished character wait for the next id, malformed ones become U+FFFD.

Every text goes through a `Stream`, PART characters at a time. What is held is cut before the last space or newline that begins
a piece whatever follows; the pieces before the cut are closed, so their ids are emitted, and a table of bounded size may answer
for their words (`Closed`). What is left, a word at most, waits for the next part; a word that is longer than the buffer is
streamed by the lookahead. Digests and decoding take the ids as they come: beside the text itself, memory does not grow with it.

Inputs: null counts as the empty text (no ids). Special tokens of the file that stand in a text become their ids, as the
tokenizers library does it. Repeated rows are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, documents

#: Entries of the tables of words and of pieces that a worker remembers; a full table starts anew.
TABLE, PIECES = 500_000, 100_000
#: Characters of a text that are fed at once, and of an open piece beyond which it is streamed.
PART, PIECE = 1 << 14, 1024
#: The split that byte_bpe_50k.json's byte-level pre-tokenizer makes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN = regex.compile(SPLIT)
NEWLINES = re.compile(r"\n+")
#: Marks that are a piece of their own after letters.
MARKS = frozenset(".,;:!?")
#: Runs that a split piece may consist of, by the piece's last character.
RUNS = {"L": regex.compile(r"\p{L}+"), "N": regex.compile(r"\p{N}+"), "S": regex.compile(r"\s+"), "O": regex.compile(r"[^\s\p{L}\p{N}]+")}


@lru_cache(maxsize=1)
def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def as_expected(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE as this module does it: its split, no normaliser, no prefix, plain merges, special tokens as they stand."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    merges = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    return plain and merges and not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))


class Merges:
    """A byte-level BPE file of the tokenizers library: ids by byte, merges by pair, bytes by id, special tokens. Other files are an error."""

    def __init__(self, content: str):
        spec, chars = json.loads(content), byte_of_char()
        if not as_expected(spec):
            raise ValueError("not a byte-level BPE tokenizer with the plain split")
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.widest = max(map(len, self.specials), default=1)
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in token)
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.single = [0] * 256
        for c, b in chars.items():
            self.single[b] = vocab[c]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes after a token's end that can change it.

        A token is changed from the right by a merge of its own last part (a token of its right spine) with what
        follows, if that merge comes before the one that uses the part; what follows must itself have formed, which again
        depends on merges of still earlier rank. The longest such chain bounds the lookahead."""
        made: dict[int, tuple[int, int]] = {}  # token -> (rank of its merge, right part)
        reach: dict[int, tuple[list[int], list[int]]] = {}  # left token -> ranks, running maxima of the reach

        def depends(token: int, used_at: float) -> int:
            most = 0
            while True:
                if token in reach:
                    ranks, best = reach[token]
                    at = bisect_left(ranks, used_at)
                    most = max(most, best[at - 1] if at else 0)
                if token not in made:
                    return most
                used_at, token = made[token]

        for (a, b), (rank, new) in self.ranks.items():
            far = len(self.bytes[b]) + depends(b, rank)
            ranks, best = reach.setdefault(a, ([], []))
            ranks.append(rank)
            best.append(max(far, best[-1] if best else 0))
            made.setdefault(new, (rank, b))
        return max((depends(t, float("inf")) for t in range(len(self.bytes))), default=0)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one split piece: the merge of the lowest rank first, leftmost first among equals."""
        ids, ranks = [self.single[b] for b in raw], self.ranks
        if len(ids) > 48:
            return self._merge_long(ids)
        pairs = [ranks.get(p) for p in zip(ids, ids[1:])]
        while True:
            found = min((p for p in pairs if p), default=None)
            if found is None:
                return ids
            i = pairs.index(found)
            ids[i : i + 2] = [found[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get((ids[i - 1], ids[i]))
            if i < len(pairs):
                pairs[i] = ranks.get((ids[i], ids[i + 1]))

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(p[0], i, p[1], ids[i], ids[i + 1]) for i in range(n - 1) if (p := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := ranks.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (p[0], x, p[1], ids[x], ids[y]))
        return [x for x in ids if x >= 0]


class Run:
    """One split piece of any length, in parts: ids whose end lies the lookahead before the end of what came are stable."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""

    def push(self, raw: bytes) -> list[int]:
        self.held += raw
        if len(self.held) < 2 * self.merges.lookahead + PIECE:
            return []
        out, at = [], 0
        for i in self.merges.merge(self.held):
            end = at + len(self.merges.bytes[i])
            if end > len(self.held) - self.merges.lookahead:
                break
            out.append(i)
            at = end
        self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), b""
        return out


class Closed:
    """Ids of closed text: what begins and ends where split pieces do, whatever stands around it. Remembers words.

    A word is what stands after a single space and before the next, or a run of newlines with what follows it; the split begins
    a piece at either, unless white space stands around it. Text with other white space at a word's edge is split as a whole."""

    def __init__(self, merges: Merges):
        self.merges, self.code = merges, "H" if len(merges.bytes) <= 1 << 16 else "I"
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    def split(self, text: str) -> list[int]:
        """Ids by the split's pieces."""
        ids: list[int] = []
        for piece in PATTERN.findall(text):
            got = self.pieces.get(piece)
            if got is None:
                if len(self.pieces) >= PIECES:
                    self.pieces.clear()
                got = self.merges.merge(piece.encode())
                if len(piece) <= PIECE:
                    self.pieces[piece] = got
            ids += got
        return ids

    def word(self, word: str) -> bytes:
        """Ids of a word that stands after a space or begins with newlines; enters it. Latin letters are one piece in any version of Unicode, and a mark after them another."""
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            ids = self.merges.merge(b" " + word.encode())
        elif word[-1] in MARKS and word[:-1].isalpha() and (word.isascii() or max(word) < "\u0250"):
            body = self.words.get(word[:-1])
            got = self.words[word] = (self.word(word[:-1]) if body is None else body) + array(self.code, self.split(word[-1])).tobytes()
            return got
        else:
            ids = self.split(word if word[0] == "\n" else " " + word)
        got = self.words[word] = array(self.code, ids).tobytes()
        return got

    def ids(self, text: str) -> list[int]:
        row = (NEWLINES.sub(" \\g<0>", text) if "\n\n" in text else text.replace("\n", " \n")).split(" ")
        head, words = row[0], row[1:]
        found = list(map(self.words.get, words))
        if None in found:
            new = {w for w, got in zip(words, found) if got is None}
            if not all(map(self.alone, new)):
                return self.split(text)
            if len(self.words) + 2 * len(new) > TABLE:
                self.words.clear()
                new = set(words)
            for w in new:
                self.word(w)
            found = map(self.words.__getitem__, words)
        if head and head[-1].isspace():
            return self.split(text)
        return self.split(head) + array(self.code, b"".join(found)).tolist()

    @staticmethod
    def alone(word: str) -> bool:
        """Whether a word's pieces are the same in any text."""
        return word.isalnum() and len(word) <= PIECE or 0 < len(word) <= PIECE and (word[0] == "\n" or not word[0].isspace()) and (not word[-1].isspace() or not word.strip("\n"))


class Stream:
    """Ids of a text given in parts. `closed`: a table to share between streams."""

    def __init__(self, merges: Merges, closed: Closed | None = None):
        self.merges, self.held = merges, ""
        self.closed = closed or Closed(merges)
        self.run: Run | None = None
        self.kind = ""

    def feed(self, part: str) -> list[int]:
        """Ids that no continuation can change any more."""
        out: list[int] = []
        self.held += part
        specials = self.merges.specials
        while specials and (found := [(at, -len(x), x) for x in specials if (at := self.held.find(x)) >= 0]):
            at, _, token = min(found)
            rest, self.held = self.held[at + len(token) :], self.held[:at]
            out += self._advance(True)
            out.append(specials[token])
            self.held = rest
        return out + self._advance(False)

    def finish(self) -> list[int]:
        return self._advance(True)

    def _limit(self) -> int:
        """Where a special token may have begun at the end of what is held."""
        for k in range(min(len(self.held), self.merges.widest - 1), 0, -1):
            tail = self.held[-k:]
            if any(len(s) > k and s.startswith(tail) for s in self.merges.specials):
                return len(self.held) - k
        return len(self.held)

    def _cut(self, limit: int) -> int:
        """The last place before `limit` where a piece begins whatever follows: a space between two words, or a newline after one. 0: none."""
        text, end = self.held, limit
        while (at := max(text.rfind(" ", 0, end), text.rfind("\n", 0, end))) > 0:
            if not text[at - 1].isspace() and (text[at] == "\n" or at + 1 < limit and not text[at + 1].isspace()):
                return at
            end = at
        return 0

    def _advance(self, last: bool) -> list[int]:
        out: list[int] = []
        limit = len(self.held) if last else self._limit()
        if self.run is not None:
            text = self.held
            m = RUNS[self.kind].match(text)
            end = min(m.end() if m else 0, limit)
            closed = last or end < limit
            if self.kind == "S" and end and end < len(text) or self.kind == "S" and not last:
                end = max(end - 1, 0)  # the last space goes with what follows
            out += self.run.push(text[:end].encode())
            self.held, limit = text[end:], limit - end
            if not closed:
                return out
            out += self.run.finish()
            self.run = None
        if last:
            out += self.closed.ids(self.held)
            self.held = ""
            return out
        cut = self._cut(limit)
        if cut:
            out += self.closed.ids(self.held[:cut])
            self.held, limit = self.held[cut:], limit - cut
        if limit <= PIECE:
            return out
        text, at = self.held, 0  # no cut in so long a text: by pieces
        while at < len(text):
            end = PATTERN.match(text, at).end()
            after = RUNS["S"].match(text, at).end() if text[at].isspace() and RUNS["S"].match(text, at) else end
            if max(end, after) >= limit or (text[at] == "'" and at + 3 > limit):
                if limit - at > PIECE:
                    out += self._open(text, at, limit)
                    return out
                break
            out += self.merges.merge(text[at:end].encode())
            at = end
        self.held = text[at:]
        return out

    def _open(self, text: str, at: int, limit: int) -> list[int]:
        """Begin to stream the piece at `at`, which reaches the end of what is known."""
        lead = 1 if text[at] == " " and at + 1 < limit and not text[at + 1].isspace() else 0
        self.kind = next(k for k, r in RUNS.items() if r.match(text, at + lead))
        self.run = Run(self.merges)
        end = min(RUNS[self.kind].match(text, at + lead).end(), limit)
        end -= self.kind == "S"
        self.held = text[end:]
        return self.run.push(text[at:end].encode())


class Decoder:
    """Text of ids given in parts."""

    def __init__(self, merges: Merges):
        self.merges, self.state = merges, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.merges.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


class Coder:
    """The transducer and the decoder of one tokenizer file, with the tables that its streams share."""

    def __init__(self, content: str):
        self.merges = Merges(content)
        self.closed = Closed(self.merges)
        self.decimals = [str(i) for i in range(len(self.merges.bytes))]

    def parts(self, text: str, size: int = PART) -> Iterator[list[int]]:
        """A text's ids, as they become stable."""
        stream = Stream(self.merges, self.closed)
        for at in range(0, len(text), size):
            yield stream.feed(text[at : at + size])
        yield stream.finish()

    def encode(self, text: str) -> np.ndarray:
        return np.array([i for ids in self.parts(text) for i in ids], "<u2" if self.closed.code == "H" else "<u4")

    def digest(self, text: str, kept: list[int] | None = None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of them in decimals joined by commas, SHA-256 of the text that they decode to. kept: gets the ids."""
        decoder, n, one, two = Decoder(self.merges), 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.parts(text):
            if ids:
                one.update(("," * bool(n) + ",".join(map(self.decimals.__getitem__, ids))).encode())
                two.update(decoder.feed(ids).encode())
                n += len(ids)
                if kept is not None:
                    kept += ids
        two.update(decoder.finish().encode())
        return n, one.hexdigest(), two.hexdigest()


@lru_cache(maxsize=2)
def coder(content: str) -> Coder:
    return Coder(content)


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """A tokenizer file's content, read on the driver and broadcast (a few MB: as large as the file)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, vocab: Broadcast, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array]) of every row of `docs` (doc_id, text)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocab.value)
        for batch in it:
            rows: list[tuple] = []
            for text in batch.column(1):
                kept: list[int] | None = [] if ids else None
                rows.append((*code.digest(text.as_py() or "", kept), np.array(kept, "<i4") if ids else None))
            n, a, b, c = zip(*rows) if rows else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(c, pa.list_(pa.int32()))] if ids else columns, [*names, "ids"] if ids else names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batches, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded."""
    return encoded(documents(spark, sf_dir), vocabulary(spark))
