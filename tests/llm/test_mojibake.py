import pytest
from pyspark.sql import functions as F

from quarry.llm import mojibake

GOOD = ["Моделирование сезонных графиков", "Описание рекламных лекций", "Аудит открытых отчётов", "Компетенция «Контроль рисков» — Кюдар", "budgeting of client tables", "Übungen и практикум", "№ 3–5 аудит…", "СЭД, РСУ", "сОКРАЩЕНИЕ РИСКОВ", "??? ± 5 %"]


@pytest.fixture(scope="module")
def models(spark):
    words = "моделирование сезонных графиков описание рекламных лекций аудит открытых отчётов компетенция контроль рисков сокращение и в с на практикум".split()
    ru = [(i, " ".join(words[i % 7 :] + words[: i % 7]) + " Моделирование Описание Аудит Компетенция Контроль", "ru") for i in range(30)]
    en = [(100 + i, "budgeting of client tables and regular reports with planning of risks", "en") for i in range(30)]
    return mojibake.train(spark.createDataFrame(ru + en + [(500, None, "ru"), (501, "x", None)], "id long, text string, lang string"))


@pytest.mark.parametrize(("true", "misread"), [("utf-8", "cp1251"), ("utf-8", "cp1252"), ("utf-8", "cp866"), ("utf-8", "koi8-r"), ("cp1251", "cp1252"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp866")])
def test_round_trip(models, true, misread):
    table = {b: ch for ch, b in reversed(mojibake._TABLES[misread].items())}
    for good in GOOD[:3]:
        bad = "".join(table[b] for b in good.encode(true))
        assert models.repair(bad)[0] == good
        first = good.split(" ")[0]
        part = "".join(table[b] for b in first.encode(true)) + good[len(first) :]
        assert models.repair(part)[0] == good


def test_twice_and_partly_lost(models):
    twice = "Аудит открытых отчётов".encode().decode("cp1251", "replace").encode().decode("cp1251", "replace")
    assert models.repair(twice)[1] is not None
    assert models.repair("Аудит от���тых отчётов") == ("Аудит от���тых отчётов", "lost")


@pytest.mark.parametrize("text", GOOD + ["", "abc", "Аудти открыых отчтов", "é", " "])
def test_intended_text_stays(models, text):
    assert models.repair(text) == (text, None)


def test_column(spark, models):
    rows = [("Ïðàêòèêóì è ðèñêè",), (None,), ("",), ("Аудит",), ("Аудит " * 20_000,)]
    got = spark.createDataFrame(rows, "t string").select(mojibake.repair_column(models)("t").alias("r")).collect()
    assert [r.r.chain for r in got][1:] == [None] * 4 and got[1].r.text is None and got[4].r.text == rows[4][0]


def test_words_are_counted_in_all_documents(spark):
    """Words that ten of 2,000 documents hold are known, each of them; a sample of 400 documents missed many."""
    rare = [a + b + c for a in ("пре", "над", "кор", "ман", "зал", "тук") for b in ("ло", "ви", "ша", "ре", "гу", "мы") for c in ("нок", "тка", "вый", "рон", "сть", "лик")][:200]
    docs = spark.createDataFrame([(i, f"описание {rare[i % 200]} лекций", "ru") for i in range(2000)] + [(5000, "twice once twice", "en")], "id long, text string, lang string")
    found = mojibake.train(docs)
    assert set(rare) | {"описание", "лекций"} == found.known
    order = found.dictionaries["ru"].decode("utf-32-le").split()
    assert set(order[-4:]) == {"Описание", "описание", "Лекций", "лекций"} and list(found.dictionaries) == ["ru"]


def test_without_training_text(spark):
    empty = mojibake.train(spark.createDataFrame([], "id long, text string, lang string"))
    assert empty.repair("Ïðàêòèêóì")[0] in ("Ïðàêòèêóì", "Практикум") and empty.repair("Аудит")[1] is None
    assert spark.createDataFrame([], "t string").select(mojibake.repair_column(empty)("t")).count() == 0
    assert F is not None
