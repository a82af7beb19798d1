import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import ledger
from quarry.llm.text import canonical_key, canonical_parts, word_string, word_string_column

TEXTS = ["Анализ  Данных; C++ и C#", "анализ данных|c++ И c#", "c++ и c#; Анализ, данных!", "ﬁle ２ ёж­ик", "file 2 ежик", "", None, " — ; | ", "a" * 50_000 + " b", "№ 5", "x​y", "Ёлка_дом", "é é", "½ ⅷ"]


def test_word_strings():
    assert word_string("Ёж­ик, C++_x #1") == "ежик c++ x #1" and word_string("C++", plus=False) == "c"
    assert canonical_parts("b; a|; ,") == "a;b" == canonical_parts("A ;B") and canonical_parts("a a") != canonical_parts("a;a")


def test_columns_equal_functions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string").repartition(3)
    got = df.select("id", "t", canonical_key(F.col("t")).alias("c"), word_string_column(F.col("t")).alias("w")).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.c, r.w) == ((None, None) if r.t is None else (canonical_parts(r.t), word_string(r.t)))


def brute(records):
    groups = {}
    for key, t in records:
        if t is not None and (c := canonical_parts(t)):
            groups.setdefault(c, []).append(key)
    return groups


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ledger_in_batches_equals_brute_force(spark, kind):
    rnd = random.Random(5)
    base = [t for t in TEXTS if t != ""] + ["one; two"]
    shaped = [(i if kind == "long" else f"k{i % 150:03}", t if t is None else rnd.choice([t, t.upper(), f" {t} ", t.replace(" ", "\t")])) for i, t in ((i, base[i % 150 % len(base)] if rnd.random() < 0.7 else "one;  TWO") for i in range(200))]
    df = spark.createDataFrame([(k, t, i % 3) for i, (k, t) in enumerate(shaped)], f"id {kind}, t string, b int")
    at = F.expr("timestamp_ntz'2025-01-01 00:00:00' - make_dt_interval(0, 0, b)")
    rows, led = ledger.fold([ledger.keyed(df, "t.f", F.col("t"), F.col("id"), F.col("b"), at)], 3)
    want, last = brute(shaped), {}
    for i, (k, t) in enumerate(shaped):
        if t is not None and (c := canonical_parts(t)):
            last.setdefault(c, []).append(-(i % 3))
    lines = led.lines().collect()
    assert sorted((r.kept, r.n) for r in lines) == sorted((min(v), len(v)) for v in want.values())
    assert sorted(r.since.minute for r in lines) == sorted(min(v) % 60 for v in last.values())
    assert sorted((r.kept, r.key) for r in ledger.copies(rows, led.lines()).collect()) == sorted({(min(v), k) for v in want.values() for k in v if k != min(v)})


def test_ledger_of_nothing(spark):
    df = spark.createDataFrame([], "id long, t string, loaded_at timestamp")
    rows, led = ledger.fold([ledger.keyed(df, "t.f", F.col("t"), F.col("id"), ledger.halves(df))])
    assert led.lines().count() == 0 and ledger.copies(rows, led.lines()).count() == 0


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*.parquet")}


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    def batch(texts):
        df = spark.createDataFrame([(i, t) for i, t in texts], "id long, t string")
        return ledger.keyed(df, "t.f", F.col("t"), F.col("id"), F.lit(0))

    led = ledger.Ledger(spark, str(tmp_path / "book"))
    assert led.lines() is None
    assert led.add("monday", batch([(i + 10, f"text {i}") for i in range(400)]))
    before, at = files(tmp_path / "book"), led.manifest()["at"]
    assert len(at) == ledger.LEAST_BUCKETS
    again = ledger.Ledger(spark, str(tmp_path / "book"))  # another run finds the same ledger
    assert again.add("tuesday", batch([(3, "TEXT  7"), (900, "text 7!")]))
    after, now = files(tmp_path / "book"), again.manifest()["at"]
    assert all(after[k] == v for k, v in before.items())  # no file is touched, one bucket has a newer one
    moved = [b for b in at if at[b] != now[b]]
    assert len(moved) == 1 and {k.split("/")[1] for k in set(after) - set(before)} == {f"bucket={moved[0]}"}
    assert not again.add("tuesday", batch([(3, "TEXT  7")]))  # a batch counts once
    lines = again.lines().collect()
    assert len(lines) == 400 and [(r.n, r.kept) for r in lines if r.n > 1] == [(3, 3)]
    assert again.add("empty", batch([]).limit(0)) and again.lines().count() == 400
