import pyarrow as pa
import pytest

from quarry.llm import canonical, queries

NAMES = [(1, "Моделирование сезонных графиков"), (2, "Описание рекламных лекций"), (3, "Контроль рисков"), (3, "Risks controlling"), (4, "Описание рисков"), (5, "Аудит отчётов"), (6, "Аудит отчётов "), (7, None), (8, "—")]
CASES = {
    "моделирование СЕЗОННЫХ графиков": 1, "Сезонных графиков: моделирование": 1, "Моделироание сезонынх графков": 1, "Модел. сез. граф.": 1, "Modelirovanie sezonnykh grafikov": 1, "vjltkbhjdfybt ctpjyys[ uhfabrjd": 1,
    "Описание pекламных лeкций (junior)": 2, "2. Описание рекламных лекций на практике": 2, "risks controling": 3, "SK-0003": 3, "sk 0003 контроль": 3, "Контр��ь рисков": 3, "Умение — контроль рисков": 3,
    "Моделирование сезонн��": 1, "Описание �": 0, "Контроль графиков": 0, "Контроль сезонных рисков": 0, "Полив пчелиных ульев": 0, "Аудит отчётов": 0, "": 0, "—": 0, "SK-9999": 0, "Контроль": 0,
}


def test_values_reach_their_entries(spark):
    values = spark.createDataFrame([(v, 1) for v in CASES] * 2 + [(None, 2), ("слово " * 3000, 3)], "value string, entry_id int")
    names = spark.createDataFrame(NAMES, "entry_id long, name string")
    codes = spark.createDataFrame([(3, "SK-0003"), (4, None)], "entry_id long, code string")
    got = {r.value: r.entry_id for r in canonical.map_values(values, names, codes).collect()}
    assert {v: got.get(v, 0) for v in CASES} == CASES and set(got) <= set(CASES)


def test_empty_sides(spark):
    values, names = spark.createDataFrame([("a b",)], "value string"), spark.createDataFrame(NAMES, "entry_id long, name string")
    assert canonical.map_values(values.limit(0), names).count() == 0
    assert canonical.map_values(values, names.limit(0)).count() == 0


def test_models_know_the_words_of_all_documents(spark, tmp_path):
    """The models that read garbled values count every document; a sample of 400 missed many of these words."""
    rare = [a + b + c for a in ("пре", "над", "кор", "ман", "зал", "тук") for b in ("ло", "ви", "ша", "ре", "гу", "мы") for c in ("нок", "тка", "вый", "рон", "сть", "лик")][:200]
    tables = {
        "documents": ([(i, f"описание {rare[i % 200]} лекций", "ru") for i in range(2000)], "doc_id long, text string, lang string"),
        "skill_suggestion": ([(1, "аудит", None)], "id long, suggested_name string, group_name string"),
        "source_block": ([(1, None)], "id long, raw_title string"),
    }
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert queries.p2_models(spark, str(tmp_path)).known == set(rare) | {"описание", "лекций"}


@pytest.mark.parametrize("most", [20_000, 0])
def test_rows_are_ranked_one_by_one(monkeypatch, most):
    """Values and entries are read once a task; each row has its own score, however the rows are cut into batches."""
    monkeypatch.setattr(canonical, "_MEMO", most)
    near = lambda w, s: [{"word": w, "sim": s, "df": 1}]
    read = {("a b", 0): [("a", near("aa", 1.0)), ("b", near("bb", 0.9))], ("a b", 1): [("a", near("cc", 1.0))], ("c\ufffd", 0): [("c\ufffd", near("cc", 0.85))]}
    entries = {7: ["aa", "bb"], 8: ["cc"], 9: ["cc", "dd"]}
    rows = [(v, k, no) for v, k in read for no in entries] * 2
    want, columns = [], {c: [] for c in ("value", "reading", "entry_id", "entry_no", "read", "words", "dfs")}
    for v, k, no in rows:
        value = canonical.meaning([(t, 0, {n["word"]: n["sim"] for n in x}) for t, x in read[v, k]])
        want.append(canonical.score(value, dict.fromkeys(entries[no], canonical.math.log(1 + 3)), 0.1, v.endswith("\ufffd")))
        cells = (v, k, no, no, [{"pos": i, "piece": 0, "token": t, "near": x} for i, (t, x) in enumerate(read[v, k])][::-1], entries[no], [1] * len(entries[no]))
        for c, x in zip(columns.values(), cells, strict=True):
            c.append(x)
    batch = pa.RecordBatch.from_pydict(columns)
    for cut in (1, 4, 18):
        got = [x for b in canonical._ranked(0.1, 3)(batch.slice(i, cut) for i in range(0, 18, cut)) for x in b.column("score").to_pylist()]
        assert got == want and 0 < sum(x > 0 for x in got) < 18


def test_repairs_are_complete():
    vocabulary = ["график", "графика", "лекций", "ток", "трафик", "отчет"]
    r = canonical.Repairer(vocabulary)
    for token in ("графк", "гарфик", "лекцй", "тик", "трфик", "отчт", "грфаик"):
        want = {v for v in vocabulary if canonical.distance(token, v, 2) <= min(canonical.allowed(token), canonical.allowed(v))}
        assert set(r.near(token)) == want
    assert r.near("график") == {"график": 1.0} and r.near("6925") == {}


def test_distance():
    assert [canonical.distance(a, b, 3) for a, b in (("ab", "ba"), ("abc", "abc"), ("kitten", "sitting"), ("", "ab"), ("abcd", ""))] == [1, 0, 3, 2, 4]
