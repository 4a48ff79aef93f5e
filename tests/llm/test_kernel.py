"""The string kernel against brute force, and sentences."""

import random
from itertools import combinations

import numpy as np

from quarry.llm import toxicity


def slow_kernel(a, b):
    """Gap-weighted three-letter subsequences within SPAN letters, of words with a start and an end mark."""

    def vector(word):
        w, out = f"^{word}$", {}
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                key = w[i] + w[j] + w[k]
                out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i - 2)
        return out

    x, y = vector(a), vector(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_kernel_matches_brute_force():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcd", k=rng.randrange(2, 12))) for _ in range(60)] + ["idiot", "idxiot", "idiiot", "a"]
    marks = sorted(set(words[:12]) | {"idiot"})
    row_of, land = toxicity._landmarks(marks)
    got = toxicity.kernels(words, row_of, land, 2.0)
    want = np.array([[np.exp(2.0 * (slow_kernel(w, m) - 1)) for m in marks] for w in words])
    assert np.abs(got - want).max() < 1e-5


def test_inserted_letters_weaken_the_kernel_only_a_little():
    row_of, land = toxicity._landmarks(["worthless"])
    near, far = toxicity.kernels(["worthxless", "wonderful"], row_of, land, 1.0)[:, 0]
    assert near > 0.75 > 0.5 > far


def test_long_words_take_their_nearest_part():
    row_of, land = toxicity._landmarks(["worthless"])
    one = toxicity.kernels(["q" * 40 + "worthless" + "q" * 40], row_of, land, 1.0)[0, 0]
    assert one > toxicity.kernels(["q" * 89], row_of, land, 1.0)[0, 0]


def test_sentences():
    assert toxicity.sentences("One two. Three,\nfour! \"Five?\" g r i b z 12 -") == [["one", "two"], ["three"], ["four"], ["five"], ["g", "r", "i", "b", "z"], ["gribz"]]
    assert toxicity.sentences("") == [] and toxicity.sentences(" . \n!") == []


def test_a_sentence_takes_part_as_its_best_word():
    sample = toxicity.Sample([[["bad", "calm"], ["calm", "dull"]], [["calm", "dull"], ["dull", "easy"]]], np.array([True, False]))
    value = np.array([{"bad": 3.0, "calm": 1.0, "dull": 2.0, "easy": 2.0}[w] for w in sample.vocab])
    best, top = sample.best(value)
    assert [sample.vocab[k] for k in best] == ["bad", "dull", "dull", "dull"] and top.tolist() == [3.0, 2.0, 2.0, 2.0] and sample.n_pos == 2
