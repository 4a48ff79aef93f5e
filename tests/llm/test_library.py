"""Tokenizer files of another kind than the one that words are remembered for."""

import json

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe, library


def content():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


TEXTS = ["a word, another\n\nline  two", "", "prefix", " x", "the the the.", "don't 12 é"]


def other(**changes):
    spec = json.loads(content())
    spec["pre_tokenizer"] |= changes
    return json.dumps(spec)


def test_other_splits_go_to_the_library_as_a_whole():
    for changed in (other(add_prefix_space=True), other(use_regex=False)):
        lib, tokenizer = library.Library(changed), Tokenizer.from_str(changed)
        assert not lib.as_expected
        assert [lib.encode(t).tolist() for t in TEXTS] == [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
        with pytest.raises(ValueError):
            bpe.Merges(changed)


def test_the_known_split_is_told():
    assert bpe.as_expected(json.loads(content())) and library.Library(content()).as_expected
    spec = json.loads(content())
    spec["added_tokens"][0]["lstrip"] = True
    assert not bpe.as_expected(spec)
    spec = json.loads(content())
    spec["normalizer"] = {"type": "NFC"}
    assert not bpe.as_expected(spec)


WORDS = ["the", "Thé,", "rain", "ƛx", "ab.###", "ab$$$", "a_", "LE\nnext", "x\ny!!", "end.\nThe"]


def test_latin_words_are_no_python_objects():
    lib, tokenizer = library.Library(content()), Tokenizer.from_str(content())
    asked, real = [], lib.words.resolve
    lib.words.resolve = lambda words: asked.extend(words) or real(words)
    texts = [" ".join(WORDS[k:] + WORDS[:k]) for k in range(len(WORDS))] + [None, ""]
    for _ in range(2):
        got = lib.encode_all(pa.array(texts, pa.string()))
        assert [memoryview(x).cast("H").tolist() for x in got.to_pylist()] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert set(asked) == {" "} and len(lib.words.known) == len(lib.words.ids) > 0


@pytest.mark.parametrize("table, at_once", [(5, 1), (5, 60), (12, 1 << 20)])
def test_a_full_table_starts_anew(monkeypatch, table, at_once):
    monkeypatch.setattr(library, "TABLE", table)
    monkeypatch.setattr(library, "AT_ONCE", at_once)
    lib, tokenizer = library.Library(content()), Tokenizer.from_str(content())
    texts = [*TEXTS, " ".join(WORDS), "a  b", None, "日本 x' 'x a' 12,", "<|endoftext|> a", "the\n\n\nA \n b", *[f"w{i} x{'y' * i} the" for i in range(30)], "long " + "x" * 2000]
    for some in (texts, texts[::-1], texts[3:20]):
        got = lib.encode_all(pa.array(some, pa.string()).slice(1))
        assert [memoryview(x).cast("H").tolist() for x in got.to_pylist()] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in some[1:]]
        assert len(lib.words.known) == len(set(lib.words.known.to_pylist())) == len(lib.words.ids)


def test_small_batches_are_gathered(monkeypatch):
    monkeypatch.setattr(library, "AT_ONCE", 100)
    batches = [pa.record_batch([pa.array([i]), pa.array(["x" * n])], ["id", "text"]) for i, n in enumerate((1, 1, 500, 20, 20, 20, 20, 1))]
    got = list(library.gathered(iter(batches), 1))
    assert pa.Table.from_batches(got) == pa.Table.from_batches(batches) and 3 <= len(got) < 8 and list(library.gathered(iter([]), 1)) == []
