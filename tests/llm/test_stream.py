"""Every text goes through the streaming transducer, in parts, with a bounded buffer."""

import random

from quarry.llm import bpe


def vocabulary():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_all_texts_go_through_the_stream(spark, monkeypatch):
    code, fed, held = bpe.Coder(vocabulary()), [], []
    feed = bpe.Stream.feed

    def counted(self, part):
        out = feed(self, part)
        fed.append(part)
        held.append(len(self.held) + (len(self.run.held) if self.run else 0))
        return out

    monkeypatch.setattr(bpe.Stream, "feed", counted)
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "word", "other", "it's", "1,5", "\n", "né"], k=rng.randrange(1, 30_000))) for _ in range(20)]
    texts += ["x" * 100_000, " " * 50_000, "ab " * 40_000, "\n \n" * 20_000]
    for text in texts:
        before = len(fed)
        code.digest(text)
        assert "".join(fed[before:]) == text and all(len(p) <= bpe.PART for p in fed[before:])
    assert max(held) <= 2 * code.merges.lookahead + 4 * bpe.PIECE


def test_ids_do_not_depend_on_the_parts():
    code, rng = bpe.Coder(vocabulary()), random.Random(3)
    for _ in range(60):
        text = "".join(rng.choices(["a", "the ", " ", "\n", "'s", "'", "!", "日本", "\t", "<|endoftext|>", "<|", "12", "é ", " end", "q" * 40], k=400))
        whole = [i for ids in code.parts(text, len(text)) for i in ids]
        for size in (1, 2, 7, 100):
            assert [i for ids in code.parts(text, size) for i in ids] == whole


def test_tables_start_anew_when_they_are_full(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE", 50)
    monkeypatch.setattr(bpe, "PIECES", 20)
    small, large = bpe.Coder(vocabulary()), bpe.Coder(vocabulary())
    monkeypatch.setattr(bpe, "PART", 1 << 14)
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(900)}x" for _ in range(3000))
    got = small.encode(text).tolist()
    assert len(small.closed.pieces) <= 20
    monkeypatch.undo()
    assert got == large.encode(text).tolist()
