"""Token ids from the tokenizers library, whole texts at a time, with a bounded table of what words gave.

The table holds for tokenizer files whose split `bpe` knows; texts go to the library as a whole with any other. Words are cut, told
apart, looked up and put together as Arrow columns: no word that is known is a Python object.
"""

from __future__ import annotations

import codecs
import json
import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, models, pre_tokenizers

from quarry.llm.bpe import Closed, as_expected, byte_of_char

#: Words encoded as one text.
TOGETHER = 2000
#: Entries of the table of words that a worker remembers; a full table starts anew.
TABLE = 800_000
#: Characters of a word beyond which its text is encoded as a whole.
PIECE = 1024
#: Bytes of texts whose words are looked up together, beside a text of any size; each look-up reads the whole table.
AT_ONCE = 4 << 20
#: Latin letters, each a letter in any version of Unicode, and ASCII marks but the apostrophe, with which a piece may begin after letters.
LATIN, SIGNS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-&(-/:-@\\[-`{-~"
#: Letters and then marks, which are two pieces, perhaps after a newline, which is one of its own.
SIMPLE = rf"\A\n?[{LATIN}]+[{SIGNS}]*\z"
#: Marks by byte, and a byte that no text has, which stands for a newline where newlines part pieces.
SIGN_BYTES, NEWLINE = np.array([33 <= b < 127 and b != 39 and not chr(b).isalnum() for b in range(256)]), 0xFF


def gathered(it: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches, small ones together as far as AT_ONCE bytes of a column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in chain(it, [None]):
        size += batch.column(column).nbytes if batch is not None else 0
        if held and (batch is None or size > AT_ONCE):
            yield held[0] if len(held) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*(y.columns for y in held))], schema=held[0].schema)
            held, size = [], batch.column(column).nbytes if batch is not None else 0
        if batch is not None:
            held.append(batch)


def as_binary(data: bytes, ends: np.ndarray) -> pa.Array:
    """The parts of some bytes that end there."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])


class Words:
    """Whole texts by their words, with a bounded table of what words gave.

    A word is what stands between single spaces and before runs of newlines; a run of newlines goes with the word after it.
    The split begins a piece at a space before anything but white space, and at a newline after anything but white space, so
    words are encoded on their own: `resolve` gives the ids' bytes of words, `simple` those of words as SIMPLE has them, behind a
    space or not. Texts with other white space at a word's edge, with special tokens or with a very long word go to `whole`."""

    def __init__(self, resolve: Callable[[list[str]], list[bytes]], simple: Callable[[pa.Array, bool], pa.Array], whole: Callable[[str], bytes], specials: list[str]):
        self.resolve, self.simple, self.whole, self.specials = resolve, simple, whole, specials
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def encode(self, texts: pa.Array) -> pa.Array:
        """Each text's ids (null: none), some texts at a time."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends, out, lo = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), [], 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
            out.append(self._encode_some(texts.slice(lo, hi - lo)))
            lo = hi
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    def _encode_some(self, texts: pa.Array) -> pa.Array:
        """The distinct words of the texts are looked up once, and what is missing is resolved at once."""
        rows = pc.replace_substring(texts, "\n", " \n")
        runs = pc.match_substring(texts, "\n\n")
        if pc.any(runs).as_py():
            rows = pc.if_else(runs, pc.replace_substring_regex(texts, r"\n+", r" \0"), rows)
        rows = pc.split_pattern(rows, " ")
        at, words = rows.offsets.to_numpy(), rows.flatten()
        at, starts = at - at[0], np.zeros(len(words), bool)
        starts[at[:-1]] = True  # a first word stands after no space: looked up apart
        later, first = (words.filter(pa.array(x)).dictionary_encode() for x in (~starts, starts))
        ids, odd = self._look_up(later.dictionary)
        head_ids, odd_heads = self._heads(first.dictionary)
        place = np.empty(len(words), np.int32)
        place[~starts], place[starts] = later.indices.to_numpy(), len(ids) + first.indices.to_numpy()
        got = pa.concat_arrays([ids, head_ids]).take(pa.array(place))
        ends = np.frombuffer(got.buffers()[1], np.int32)[got.offset + at[1:]]
        out = as_binary(got.buffers()[2] or b"", ends)
        odd = np.append(odd, odd_heads)
        whole = np.add.reduceat(odd[place].astype(np.int32), at[:-1]) > 0 if odd.any() else np.zeros(len(texts), bool)
        for token in self.specials:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(whole)
        if not len(at):
            return out
        place = np.arange(len(texts))
        place[at] = len(texts) + np.arange(len(at))
        return pa.concat_arrays([out, pa.array([self.whole(x) for x in texts.take(pa.array(at)).to_pylist()], pa.binary())]).take(pa.array(place))

    def _look_up(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of different words that stand after a space or newline, and which of them can't be encoded on their own (ids: none). What is new is entered."""
        found = pc.index_in(words, value_set=self.known)
        new = found.is_null().to_numpy(zero_copy_only=False)
        missing = words.filter(pa.array(new))
        new_ids, new_odd = self._resolved(missing, Closed.alone, " ")
        place = pc.fill_null(found, 0).to_numpy().copy()
        place[new] = len(self.known) + np.arange(len(missing))
        odd = np.zeros(len(words), bool)
        odd[new] = new_odd
        ids = pa.concat_arrays([self.ids, new_ids]).take(pa.array(place))
        full = len(self.known) + len(missing) > TABLE
        keep, of, gave = (pa.array(~odd), words, ids) if full else (pa.array(~new_odd), missing, new_ids)
        entered = [of.filter(keep)], [gave.filter(keep)]
        self.known, self.ids = (pa.concat_arrays(x if full else [y, *x]) for x, y in zip(entered, (self.known, self.ids)))
        return ids, odd

    def _heads(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The like of texts' first words; an empty one is odd, as its text begins with a space or newline or is empty."""
        return self._resolved(words, lambda x: x and len(x) <= PIECE and not x[0].isspace() and not x[-1].isspace(), "")

    def _resolved(self, words: pa.Array, alone: Callable[[str], bool], lead: str) -> tuple[pa.Array, np.ndarray]:
        simple = pc.and_(pc.match_substring_regex(words, SIMPLE), pc.less_equal(pc.binary_length(words), PIECE)).to_numpy(zero_copy_only=False)
        if not lead:
            simple &= ~pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        others = words.filter(pa.array(~simple)).to_pylist()
        plain = [x for x in others if alone(x)]
        got = dict(zip(plain, self.resolve([" ", *[x if x[0] == "\n" else lead + x for x in plain]])[1:]))
        odd, place = np.zeros(len(words), bool), np.empty(len(words), np.int32)
        odd[~simple] = [x not in got for x in others]
        place[simple], place[~simple] = np.arange(simple.sum()), simple.sum() + np.arange(len(others))
        ids = pa.concat_arrays([self.simple(words.filter(pa.array(simple)), bool(lead)), pa.array([got.get(x, b"") for x in others], pa.binary())])
        return ids.take(pa.array(place)), odd


class Library:
    """The library's encoder of one tokenizer file; ids as an array. Words between single spaces go to it as a batch."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallelism
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.size = size
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.lengths = self.byte_lengths()
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.as_expected = as_expected(json.loads(content))
        if not self.as_expected:
            return
        # the same model for pieces that are known already: bytes in the byte-level alphabet, a newline between pieces
        model = json.loads(content)["model"]
        self.letters = Tokenizer(models.BPE(vocab=model["vocab"], merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]))
        self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        chars = {b: c for c, b in byte_of_char().items()}
        self.alphabet = "".join({10: "\n", NEWLINE: chars[10]}.get(b, chars[b]) for b in range(256))
        self.words = Words(self._words, self._simple, self._whole, specials)

    def _words(self, words: list[str]) -> list[bytes]:
        """The first word and those that begin with a space or newline are encoded as one text; where each ends follows from its ids' bytes."""
        out: list[bytes] = [b""] * len(words)
        joined = [k for k in range(len(words)) if (not k or words[k][0] in " \n") and not words[k].isspace()]
        done = set(joined)
        single = [k for k in range(len(words)) if k not in done]
        code = "H" if self.dtype == "<u2" else "I"
        if single:
            for k, x in zip(single, self.tokenizer.encode_batch_fast([words[k] for k in single], add_special_tokens=False)):
                out[k] = array(code, x.ids).tobytes()
        for lo in range(0, len(joined), TOGETHER):
            some = [words[k] for k in joined[lo : lo + TOGETHER]]
            ids = self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids
            for k, x in zip(joined[lo : lo + TOGETHER], self._cut(array(code, ids), np.cumsum([len(w.encode()) for w in some]))):
                out[k] = x
        return out

    def _simple(self, words: pa.Array, space: bool) -> pa.Array:
        """Words as SIMPLE has them. Their pieces are plain, so the model gets them without the search for pieces."""
        out = [self._simple_some(words.slice(lo, TOGETHER), space) for lo in range(0, len(words), TOGETHER)]
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    def _simple_some(self, words: pa.Array, space: bool) -> pa.Array:
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy()
        ends -= ends[0]
        begin, sign = ends[:-1], SIGN_BYTES[raw]
        line = raw[begin] == 10
        raw[begin[line]] = NEWLINE
        at = begin[1:], begin[~line] if space else [], begin[line] + 1, np.flatnonzero(sign[1:] & ~sign[:-1]) + 1
        raw = np.insert(raw, np.concatenate(at).astype(np.int64), np.repeat(np.array([10, 32, 10, 10], np.uint8), [len(x) for x in at]))
        ids = array("H" if self.dtype == "<u2" else "I", self.letters.encode_batch_fast([codecs.charmap_decode(raw.tobytes(), "strict", self.alphabet)[0]], add_special_tokens=False)[0].ids)
        cuts = self._cuts(ids, ends[1:] + (np.cumsum(~line) if space else 0))
        return as_binary(ids.tobytes(), cuts)

    def _cut(self, ids: array, ends: np.ndarray) -> list[bytes]:
        """The ids' bytes of each word; ends: where the words end in the bytes that the ids stand for."""
        cuts, data = self._cuts(ids, ends).tolist(), ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def _cuts(self, ids: array, ends: np.ndarray) -> np.ndarray:
        return ids.itemsize * (np.searchsorted(np.cumsum(self.lengths[np.frombuffer(ids, self.dtype)]), ends) + 1)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Each text's ids as bytes; null: none."""
        return self.words.encode(texts) if self.as_expected else pa.array([self._whole(x or "") for x in texts.to_pylist()], pa.binary())

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_all(pa.array([text], pa.string()))[0].as_py(), self.dtype)

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for."""
        chars, out = byte_of_char(), np.zeros(self.size, np.int64)
        added = self.tokenizer.get_added_tokens_decoder()
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = len(token.encode()) if i in added or any(c not in chars for c in token) else len(token)
        return out


@lru_cache(maxsize=2)
def library(content: str) -> Library:
    return Library(content)
