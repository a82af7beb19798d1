import itertools
import random

import numpy as np
import pytest

from quarry.llm import golay
from quarry.llm.text import word_string


def test_the_code_is_perfect_and_lists_are_complete():
    rnd = np.random.default_rng(1)
    index = golay.codewords(np.arange(1 << 12))
    words = rnd.integers(0, 1 << 23, 300)
    generator = [int(golay._remainder(1 << (i + 11))) | 1 << (i + 11) for i in range(12)]
    code = np.zeros(4096, dtype=np.int64)
    for i, g in enumerate(generator):
        code[(np.arange(4096) >> i & 1) == 1] ^= g
    assert min(int(c).bit_count() for c in code[1:]) == 7
    for w, found in zip(words, golay.codewords(words), strict=True):
        near = {int(c) >> 11 for c in code if int(c ^ w).bit_count() <= 4}
        assert near == {int(x) for x in found if x >= 0}
    assert index.shape == (4096, 6)


def test_words_at_distance_two_share_a_codeword():
    rnd = np.random.default_rng(2)
    w = rnd.integers(0, 1 << 23, 200)
    for a, b in itertools.combinations(range(0, 23, 3), 2):
        x, y = golay.codewords(w), golay.codewords(w ^ (1 << a) ^ (1 << b))
        assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(x, y, strict=True))


def similarity(a, b):
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def fixture(seed, n):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("абвгдежзиклмнопрст") for _ in range(rnd.randrange(4, 11))) for _ in range(300)]
    texts = []
    for _ in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(12, 30))]
        texts.append(" ".join(words))
        for _ in range(rnd.randrange(3)):
            w = list(words)
            for _ in range(rnd.randrange(1, 4)):
                k = rnd.randrange(len(w))
                kind = rnd.randrange(4)
                if kind == 0:
                    w[k] = rnd.choice(vocab)
                elif kind == 1:
                    w.insert(k, rnd.choice(vocab))
                elif kind == 2:
                    w = w[k:] + w[:k]
                else:
                    w[k] = w[k][::-1]
            texts.append("  ".join(w).capitalize() + ".")
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_brute_force(spark, seed):
    texts = fixture(seed, 80) + [None, "", "...", "ab", "ab", "x" * 5000, "x" * 5000 + " y"]
    texts += texts[:10]
    df = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "uid long, grp long, text string")
    links, members = golay.near_duplicates(df, 0.7)
    got = {(r.id_a, r.id_b) for r in golay.expand(links, members).collect()}
    ws = [word_string(t) if t else "" for t in texts]
    want = {(a, b) for a in range(len(ws)) for b in range(a + 1, len(ws)) if a % 2 == b % 2 and ws[a] and ws[b] and ws[a] != ws[b] and similarity(ws[a], ws[b]) >= 0.7}
    assert len(want) > 20
    assert got <= want and len(got) >= 0.97 * len(want)
    assert members.count() == sum(bool(w) for w in ws)


def test_a_common_phrase_makes_no_hot_key():
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("абвгдежзиклмнопрст") for _ in range(rnd.randrange(4, 11))) for _ in range(2000)]
    phrase = "при соблюдении установленных требований безопасности"
    texts = [" ".join(rnd.choice(vocab) for _ in range(25)) + (" " + phrase if i % 10 == 0 else "") for i in range(6000)]
    rows, keys, _ = golay.keys_and_sketch(texts, golay.fingerprints(texts)[0])
    assert np.bincount(np.unique(keys, return_inverse=True)[1]).max() <= 6  # of 600 rows with the phrase


def test_texts_alike_by_chance_are_not_written(spark, monkeypatch):
    """Candidates by chance grow with the square of the texts, so the join itself must leave next to none."""
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("абвгдежзиклмнопрст") for _ in range(rnd.randrange(4, 11))) for _ in range(110)]
    texts = [" ".join(rnd.choices(vocab, k=30)) for _ in range(4000)]
    written, plain = [], golay.materialize

    def counted(df, label):
        out = plain(df, label)
        if label == "candidates":
            written.append(out.count())
        return out

    monkeypatch.setattr(golay, "materialize", counted)
    golay.near_duplicates(spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "uid long, grp long, text string"), 0.7)
    assert written and sum(written) < 1000, written  # a sketch of 64 bits left 8,401


def test_nothing_in_nothing_out(spark):
    links, members = golay.near_duplicates(spark.createDataFrame([], "uid long, grp long, text string"))
    assert links.count() == 0 and members.count() == 0
