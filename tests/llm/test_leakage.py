import random

import numpy as np
import pytest

from quarry.llm import leakage
from quarry.llm.text import words


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.randrange(5, 40))) for i in range(15)]
    docs = []
    for i in range(60):
        text = say(rnd.randrange(0, 80))
        for _, item in rnd.sample(items, 2):
            w = item.split()
            k = rnd.randrange(len(w))
            piece = w[k : k + rnd.randrange(8, 20)]
            text += ", " + " - ".join(piece).upper() + "; " + say(3)
        docs.append((i, text))
    return docs + [(100, None), (101, ""), (102, items[0][1] * 500), (102, items[0][1] * 500)], items + [(50, None), (51, ""), (52, items[1][1])]


@pytest.mark.parametrize(("seed", "n"), [(1, 12), (2, 12), (3, 5)])
def test_against_brute_force(spark, seed, n):
    docs, items = corpus(seed)
    grams = lambda t: {tuple(w[k : k + n]) for w in [words(t, False)] for k in range(len(w) - n + 1)} if t else set()
    want = {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}
    got = leakage.find_leaks(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item_id long, text string"), n)
    assert want and {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)


def test_edited_passages(spark):
    item = "each team owns budgeting regional publications by means of streaming courses and reports"
    docs = [(1, "so " + item + " then"), (2, item.replace("regional", "regionel")), (3, item.replace("regional", "region").replace("courses", "horses")), (4, "nothing of it")]
    got = leakage.find_leaks(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"), 12, edits=2)
    assert sorted((r.doc_id, r.edits) for r in got.collect()) == [(1, 0), (2, 1)]  # all windows of 12 words of the third hold three edits


def edits_within(piece, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(piece, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edited_passages_against_brute_force(spark, edits):
    rnd = random.Random(edits)
    docs, items = corpus(5)
    docs, items = [x for x in docs if x[1] and x[0] < 100][:25], [x for x in items if x[1]][:8]
    blur = lambda t: "".join(rnd.choice(["", ch + "q", "z"]) if rnd.random() < 0.012 else ch for ch in t)
    docs = [(i, blur(t) if i % 2 else t) for i, t in docs]
    want = {}
    for d, t in docs:
        for i, s in items:
            w = words(s, False)
            near = min((edits_within(f" {' '.join(w[k : k + 12])} ", f" {' '.join(words(t, False))} ") for k in range(len(w) - 11)), default=99)
            if near <= edits:
                want[d, i] = near
    got = leakage.find_leaks(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 12, edits)
    assert {(r.doc_id, r.item_id): r.edits for r in got.collect()} == want and 0 < max(want.values()) <= edits


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leakage.find_leaks(docs, items).count() == 0
    assert leakage.find_leaks(docs, spark.createDataFrame([(1, "a " * 30)], items.schema)).count() == 0


def test_hashes_and_distance():
    c = leakage._codes("abcabcabcabcabc")
    for q in (2, 3, 5, 7, 8):
        h = leakage._qgram_hashes(c, q)
        assert len(h) == 15 - q + 1 and len(np.unique(h)) == 3 and h[0] == h[3]
    got = leakage.banded_distances([leakage._codes("abcdef")] * 4, list(map(leakage._codes, ["xxabcdefyy", "xxabxdefyy", "xxabdefyy", "uvwxyz"])), [2, 2, 2, 0], 2, 2)
    assert got.tolist() == [0, 1, 1, 3] and leakage.banded_distances([], [], [], 1, 2).tolist() == []
