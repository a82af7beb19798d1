import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.llm import language, mixing, queries

TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 5), ("gone", 0.1, 3), (None, 0.1, 1)]


def docs(n, seed=1):
    rnd = random.Random(seed)
    return [(i, "aaaaabbc"[rnd.randrange(8)], rnd.choice(["ru", "en", None]), rnd.choice(["x", "y", None]), rnd.randrange(1, 900)) for i in range(n)]


def test_raking_meets_sources_and_caps():
    cells = pd.DataFrame([(s, lang, t, n) for s, lang, t, n in [("a", "ru", "x", 1000), ("a", "en", "x", 3000), ("b", "ru", "y", 500), ("b", "en", "x", 700), ("c", "ru", "x", 90), ("z", "ru", "x", 999)]], columns=["source", "lang", "topic", "tokens"])
    goal = {s: (share, cap) for s, share, cap in TARGETS if s}
    out = mixing.rake(cells, goal)
    used = (out.weight * out.tokens).groupby(out.source).sum()
    assert used["z"] == 0 and all(out.weight <= out.source.map(lambda s: goal.get(s, (0, 0))[1]) + 1e-9)
    assert used["a"] / used.sum() == pytest.approx(0.5, abs=1e-3) and used["c"] == pytest.approx(450, rel=1e-6)


def test_mixture(spark):
    d = spark.createDataFrame(docs(4000) + [(9001, None, "ru", "x", 5), (9002, "a", "ru", "x", 0), (9003, "z", "ru", "x", 7)], "id long, source string, lang string, topic string, tokens long")
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeat int")
    m = mixing.mix(d, t)
    rows = m.collect()
    cap = {s: c for s, _, c in TARGETS}
    assert rows and all(1 <= r.repeats <= cap[r.source] and r.tokens > 0 for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(d.repartition(7), t).collect()))
    got = {r.source: r.actual_share for r in mixing.shares(d, m, t).collect() if r.source}
    assert got["a"] == pytest.approx(0.5, abs=0.01) and got["b"] == pytest.approx(0.3, abs=0.01) and got["c"] == pytest.approx(0.2, abs=0.01) and got["gone"] == 0
    assert mixing.mix(d.limit(0), t).count() == 0 and mixing.mix(d, t.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="no tokenizer files")
def test_token_counts_are_exact(spark):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(mixing.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "Привет, мир!  it's 12 °C\n\n", None, "слово " * 5000, "a" * 3000, "​🙂 é"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.token_counter()("t")).collect()]
    assert got == [None if t is None else len(enc.encode_ordinary(t)) for t in texts]


def test_automaton_finds_exactly_substrings():
    rnd = random.Random(4)
    text = "".join(rnd.choice("abc") for _ in range(60))
    a = language.Automaton(text)
    for _ in range(200):
        s = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 12)))
        n, rest = 0, s
        while rest:
            k = max((k for k in range(1, len(rest) + 1) if rest[:k] in text), default=1)
            n, rest = n + 1, rest[k:]
        assert a.phrases(s) == n


def test_parsing_goes_on_across_words():
    a = language.Automaton(" the quick brown fox ")
    assert a.parse(" the quick brown ")[0] == 1 and a.parse(" brown the ")[0] == 2
    one, state = a.parse(" the ")
    assert (one + a.parse("quick ", state)[0]) == 1 and a.parse("zz", state) == (2, 0)
    i = language.Identifier({"en": ["the quick brown fox", "a lazy dog"], "de": ["der schnelle braune fuchs", "ein fauler hund"]})
    i._build()
    assert i.phrases(["the", "quick", "brown"])[0] == 1 and i.phrases(["quick", "the"])[0] == 2
    assert i.language("quick brown") == ("en", pytest.approx(0.8, abs=0.15))


def test_long_documents_teach_too(spark):
    rows = [(i, "мы описываем учебные графики " * 5000, "ru") for i in range(3)] + [(10 + i, "each team owns reports", "en") for i in range(3)]
    i = language.train(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert i.language("учебные графики")[0] == "ru" and sum(map(len, i.texts["ru"])) < 200


def test_paragraphs():
    assert language.paragraphs("\n \na\r\nb\r\n\t\r\n\n c \n \n\n") == ["a\nb", "c"] and language.paragraphs(" \n\n") == []


@pytest.fixture(scope="module")
def identifier(spark):
    words = {"ru": "мы описываем учебные графики и проводим аудит рисков команды", "en": "each team owns planning of regional reports and audits", "uk": "команда веде узгодження хмарних звітів та перевірку ризиків", "de": "das team verantwortet planung saisonaler berichte und der risiken", "es": "el equipo realiza la revisión de informes mensuales y riesgos"}
    rows = [(i * 10 + k, text, lang) for i in range(12) for k, (lang, text) in enumerate(words.items())] + [(900, words["es"], "en"), (901, None, "ru"), (902, "x", None)]
    return language.train(spark.createDataFrame(rows, "id long, text string, lang string"))


def test_languages_of_paragraphs(spark, identifier):
    text = "Each team owns audits.\n\nМы проводим аудит.\n\nProvodim audit riskov komandy\n\nDas Team und der Planung\n\n12 / 5\n\nКоманда веде перевірку\n\nLa revisión de informes"
    df = spark.createDataFrame([(1, text, "ru"), (2, None, "ru"), (3, "", "en"), (4, "Zzqx Qqzz", "en"), (4, "Zzqx Qqzz", None)], "id long, text string, lang string")
    segs = language.segments(df, identifier)
    got = [(r.seg_no, r.lang) for r in segs.where("id = 1").orderBy("seg_no").collect()]
    assert got == [(1, "en"), (2, "ru"), (3, "ru"), (4, "de"), (6, "uk"), (7, "es")]
    unknown = segs.where("id = 4").orderBy(F.col("label").desc_nulls_last()).collect()  # every paragraph with letters has a row
    assert [(r.label, r.confidence) for r in unknown] == [("en", 0.0), (None, 0.0)] and unknown[0].lang == "en" and unknown[1].lang in language.LANGUAGES
    assert {r.id: r.lang for r in language.documents(segs).collect()}[1] in language.LANGUAGES
    assert all(0 <= r.confidence <= 1 for r in segs.collect())


def test_without_labels(spark):
    none = language.train(spark.createDataFrame([], "id long, text string, lang string"))
    assert none.language("some words") == ("ru", 0.0) and none.language("words", "en") == ("en", 0.0) and none.language("12 / 5") == (None, 0.0)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not there")
    d = spark.read.parquet(path).select(F.col("doc_id").alias("id"), "text", "lang")
    held = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    docs_ = language.documents(language.segments(d.where(held & F.col("lang").isin(language.LANGUAGES)), language.train(d.where(~held)))).collect()
    assert sum(r.lang == r.label for r in docs_) >= 0.85 * len(docs_)


@pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="no tokenizer files")
def test_every_profile_is_a_topic_of_its_own(spark, tmp_path):
    rows = [(i, f"s{i % 2}", "ru", f"profile-{i % 230}", "слово " * (1 + i % 5)) for i in range(920)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, profile_slug string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("s0", 0.5, 1), ("s1", 0.5, 1)], "source string, target_share double, max_repeat int").write.parquet(str(tmp_path / "mix_target.parquet"))
    got = queries.p7_mixture(spark, str(tmp_path))
    assert {r.topic for r in got.select("topic").distinct().collect()} > {f"profile-{k}" for k in range(200)}
