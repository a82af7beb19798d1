import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import graph, mutate, similarity
from quarry.operators.references import orphan_references, reference_faults
from quarry.operators.skew import hot_keys, unique_join
from quarry.sources import files
from quarry.storage import materialize, shared_dir
from quarry.streaming import rollup


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_materialize_reads_back_what_it_wrote(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    out = materialize(df, "t")
    assert rows(out) == rows(df) and out.schema == df.schema
    assert shared_dir(spark) in out.inputFiles()[0]
    assert materialize(df.limit(0), "t").count() == 0


def test_unique_join_keeps_rows_of_a_hot_key(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(k, k) for k in range(2, 40)] + [(None, 0)], "k int, v int")
    right = spark.createDataFrame([(1, "x"), (5, "y"), (99, "z")], "k int, w string")
    assert rows(hot_keys(left, ["k"], 4)) == [(1,)]
    for slots in (1024, 4):
        assert rows(unique_join(left, right, ["k"], slots), "k", "v", "w") == rows(left.join(right, "k"), "k", "v", "w")
        assert rows(unique_join(left, right, ["k"], slots, "left"), "k", "v", "w") == rows(left.join(right, "k", "left"), "k", "v", "w")
    assert unique_join(left.limit(0), right, ["k"]).count() == 0 and unique_join(left, right.limit(0), ["k"]).count() == 0


def test_orphans_by_null_mask(spark):
    refs = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, 7), (4, None, None), (5, "b", 1), (6, "z", None), (5, "b", 1)], "id int, x string, y int")
    targets = spark.createDataFrame([("a", 1, 0), ("b", 2, 0), ("b", 2, 0)], "x string, y int, id int")
    found = lambda match: [r[0] for r in rows(orphan_references(refs, ["x", "y"], targets, ["x", "y"], match), "id")]
    assert found("simple") == [5, 5]
    assert found("partial") == [3, 5, 5, 6]
    assert found("full") == [2, 3, 5, 5, 6]
    assert [r[0] for r in rows(orphan_references(refs, ["x", "y"], targets.limit(0), ["x", "y"]), "id")] == [1, 5, 5]
    assert orphan_references(refs.limit(0), ["x"], targets, ["x"]).count() == 0
    with pytest.raises(ValueError):
        orphan_references(refs, ["x"], targets, ["x"], "none")


def test_fault_reasons(spark):
    refs = spark.createDataFrame([(1, 10, 5), (2, 11, 5), (3, 12, 5), (4, 13, 5), (5, None, 5), (6, 12, 9), (7, 12, None)], "id int, k int, loaded_at int")
    targets = spark.createDataFrame([(11, 1, 9), (12, 0, 7), (13, 0, 5), (13, 0, 5)], "id int, gone int, loaded_at int")
    got = reference_faults(refs, ["k"], targets, ["id"], deleted=F.col("gone") == 1)
    assert rows(got, "id", "reason") == [(1, "missing"), (2, "deleted"), (3, "late")]
    assert reference_faults(refs, ["k"], targets.limit(0), ["id"]).count() == 6


def reach(edges):
    found = set(edges)
    while True:
        more = {(a, d) for a, b in found for c, d in edges if b == c} - found
        if not more:
            return found
        found |= more


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    dag = {(a, b) for a, b in ((rnd.randrange(12), rnd.randrange(12)) for _ in range(25)) if a < b}
    e = spark.createDataFrame(sorted(dag), "src long, dst long")
    full = reach(dag)
    assert set(rows(graph.closure(e))) == full
    assert set(rows(graph.transitive_reduction(e))) == {(a, b) for a, b in dag if not any((a, m) in dag and (m, b) in full for m in range(12))}
    level = {}
    for n in range(12):
        level[n] = max((level[a] + 1 for a, b in dag if b == n), default=0)
    nodes = spark.range(12)
    assert dict(rows(graph.levels(nodes, e))) == level
    assert graph.break_cycles(e.withColumn("conf", F.lit(0.5))).count() == 0


def test_cycles_lose_their_weakest_edge(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 1, 0.3), (3, 4, 0.1), (5, 6, 0.5), (6, 5, 0.4), (7, 7, 1.0)], "src long, dst long, conf double")
    gone = graph.break_cycles(e)
    assert rows(gone) == [(3, 1, 0.3), (6, 5, 0.4), (7, 7, 1.0)]
    assert graph.core(e.join(gone, ["src", "dst", "conf"], "left_anti")).count() == 0
    assert graph.closure(e.limit(0)).count() == 0 and graph.levels(spark.range(2), e.limit(0)).count() == 2
    assert rows(graph.violations(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"), spark.createDataFrame([(1, 5), (2, 3)], "id long, pos int"))) == [(1, 2, 5, 3)]


def test_jaccard_pairs_are_complete(spark):
    rnd = random.Random(3)
    sets = {i: {f"w{rnd.randrange(9)}" for _ in range(rnd.randrange(0, 6))} for i in range(40)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tokens array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert set(rows(similarity.jaccard_pairs(df, 0.5), "a", "b")) == want


def test_greedy_absorption_follows_the_order(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (3, 5), (4, 5), (5, 6)], "a long, b long")
    assert rows(similarity.greedy_absorb(pairs)) == [(2, 1), (4, 1), (5, 3)]
    assert similarity.greedy_absorb(pairs.limit(0)).count() == 0


def test_candidates_are_absorbed_by_all_rules_in_order(spark):
    data = [
        (1, 1, "Анализ рисков проекта", None, "G"),
        (2, 1, "анализ  рисков (проекта) проекта", "ядро", "H"),  # equal name; the anchor takes over the area
        (3, 1, "Анализ рисков проекта", "опция", "G"),  # so another area is another skill
        (4, 1, "Анализ рисоков проекта", "ядро", None),  # ratio
        (5, 1, "Анализ рисков крупного проекта", "ядро", None),  # subset
        (6, 1, "Моделирование сезонных графиков", None, "G"),
        (7, 1, "Моделирование сезонных графиков", None, "K"),  # another group without areas
        (8, 2, "Анализ рисков проекта", "ядро", "G"),  # another brief
        (9, None, "для задач", "ядро", None),
        (10, None, None, "ядро", None),
        (11, None, "Для задач", "", None),
    ]
    df = spark.createDataFrame(data, "id long, run long, name string, area string, grp string")
    assert rows(similarity.absorb_candidates(df)) == [(11, 9), (2, 1), (4, 1), (5, 1)]
    assert similarity.absorb_candidates(df.limit(0)).count() == 0


def test_ratios(spark):
    df = spark.createDataFrame([("b a", "a b"), ("abc", "abd"), ("", ""), (None, "a")], "x string, y string")
    assert [r[0] for r in df.select(similarity.token_sort_ratio("x", "y")).collect()] == [100.0, pytest.approx(200 * 2 / 6), 100.0, None]
    assert df.select(similarity.sequence_ratio("x", "y")).collect()[1][0] == pytest.approx(2 / 3)


def test_cascade(spark):
    v = spark.createDataFrame([("sql basics",), ("data sql",), ("sql basicz",), ("nothing",), ("",)], "key string")
    e = spark.createDataFrame([(1, "sql basics"), (2, "python")], "entry_id long, key string")
    a = spark.createDataFrame([(2, "data sql")], "entry_id long, key string")
    assert rows(similarity.resolve_cascade(v, e, a, 85.0), "key", "resolution", "entry_id") == [("", "new", None), ("data sql", "alias", 2), ("nothing", "new", None), ("sql basics", "matched", 1), ("sql basicz", "fuzzy", 1)]


@pytest.mark.parametrize("least", [90.0, 70.0, 30.0])
def test_cascade_meets_every_pair_of_the_ratio(spark, least):
    rnd = random.Random(7)
    words = ["контроль", "графиков", "внедрение", "гипотез", "очищение", "шаблонов", "sql", "и", "ци"]
    names = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5))) for _ in range(40)} | {"a", "ab", "abc"})
    keys = {"конртоль граафиков", "внедрение\u00a0гипотез", "«очищение шаблонов»", "sql-контроль", "ba", "abd", "\u00a0"}
    for n in names:
        k = list(rnd.choice([" ", "\u00a0", "-", "  "]).join(rnd.sample(n.split(), len(n.split()))))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(k))
            k[at : at + rnd.randrange(2)] = rnd.choice("абв")
        keys.add("".join(k))
    keys = sorted(keys - set(names))
    got = similarity.resolve_cascade(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(list(enumerate(names)), "entry_id long, key string"), spark.createDataFrame([], "entry_id long, key string"), least)
    want = []
    for k in keys:
        s, i = min((-similarity.sorted_ratio(k, n), i) for i, n in enumerate(names))
        want.append((k, "fuzzy", i, -s) if -s >= least else (k, "new", None, None))
    assert rows(got, "key", "resolution", "entry_id", "score") == sorted(want, key=repr)


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", None, "x"), (2, "b", 5, "y"), (None, "n", 0, "z")], "k int, p string, q int, r string")
    new = spark.createDataFrame([(1, "A", 7), (3, "C", 8), (None, "N", 1)], "k int, p string, q int")
    got = mutate.upsert(old, new, ["k"], {"p": "keep_old", "q": "coalesce_old"})
    assert rows(got) == rows(spark.createDataFrame([(1, "a", 7, "x"), (2, "b", 5, "y"), (None, "n", 0, "z"), (3, "C", 8, None), (None, "N", 1, None)], old.schema))
    with pytest.raises(ValueError):
        mutate.upsert(old, new, ["k"], {"p": "never"})
    assert mutate.insert_ignore(old.select("k", "p"), new.select("k", "p"), ["k"]).count() == 5


def test_soft_delete_and_merge(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id int, is_active int")
    gone, child = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1,)], "id int")
    assert rows(mutate.soft_delete(df, gone, "id", children=child)) == [(1, 0), (3, 1)]
    ind = spark.createDataFrame([(1, 10, "t", 1), (2, 11, "t", 1), (3, 11, None, 1), (4, 10, None, 1)], "id int, skill_id int, text string, is_active int")
    m = spark.createDataFrame([(11, 10)], "old int, new int")
    assert rows(mutate.merge_rekey(ind, m, "skill_id", ["skill_id", "text"])) == [(1, 10, "t", 1), (2, 10, "t", 0), (3, 10, None, 1), (4, 10, None, 0)]
    assert rows(mutate.changed(spark.createDataFrame([("A",), ("b",), (None,)], "x string"), "x", F.lower("x"))) == [("A", "a")]


def test_normalizers(spark):
    cases = spark.createDataFrame([("  Ёж  (SQL) X ",), ("ＡＢ—В",), ("CI CD / M V P",), (None,), ("CI / CD–X",)], "x string")
    x = F.col("x")
    got = cases.select(X.key_plain(x), X.key_catalog(x), X.key_title(x), X.key_dedup(x), X.search_norm(x), X.key_admin(x), X.key_lookup(x)).collect()
    assert tuple(got[0]) == ("ёж (sql) x", "ёж sql x", "еж sql x", "еж x", "еж (sql) x", "еж sql x", "ежsqlx")
    assert got[1][2] == "ab в" and got[2][3] == "ci/cd / mvp" and got[3][0] == "" and got[3][1] is None and got[4][3] == "ci/cd-x"


def test_labels_and_parsers(spark):
    one = spark.createDataFrame([("Анализ данных и (черновик", "a>b; c>d;e", "15 час в неделю, 5-6 мес", "2025-01-01T00:00:00+00:00", "??? ??")], "a string, b string, c string, d string, e string")
    r = one.select(X.strip_dangling(F.col("a")), X.pair_list(F.col("b")), X.workload(F.col("c")), X.timestamp_any(F.col("d")).cast("long"), X.looks_corrupted(F.col("e")), X.limit_words(F.lit("один два три"), 9), X.weights_percent(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), X.reason_codes(F.lit("a, b;a;")), X.number(F.lit(" 1,5 ")), X.slug(F.lit("— —")), X.clean_profile_name(F.lit("Data_core v2.xlsx"))).first()
    assert r[0] == "Анализ данных" and [tuple(p) for p in r[1]] == [("a", "b"), ("c", "d")] and tuple(r[2]) == (6.0, 15.0, 391.0)
    t = spark.createDataFrame([("Цель: Анализ учебных данных.\nанализ учебных данных; коротко\nПишите на email скорее всем; Расчёт (по плану",)], "t string")
    got = t.select(X.sentences(F.col("t")), X.strip_dangling(F.lit("Анализ рисков и для, ко")), X.strip_dangling(F.lit("Настройка (в том числе")), X.strip_dangling(F.lit("Вид спорта"))).first()
    assert got[0] == ["Анализ учебных данных", "Расчёт (по плану"] and tuple(got)[1:] == ("Анализ рисков", "Настройка", "Вид спорта")
    assert r[3] == 1735689600 and r[4] and r[5] == "один два…" and r[6] == "a: 33%, b: 33%, c: 34%" and r[7] == ["a", "b"] and r[8] == 1.5 and r[9] == "item" and r[10] == "Data core"


def workbook(grid):
    cells = "".join("<row r='%d'>%s</row>" % (i, "".join(f"<c r='{chr(64 + j)}{i}' t='inlineStr'><is><t>{v}</t></is></c>" for j, v in enumerate(row, 1) if v)) for i, row in enumerate(grid, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main' xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'><sheets><sheet name='S' r:id='r1'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships><Relationship Id='r1' Target='worksheets/s.xml'/></Relationships>")
        z.writestr("xl/worksheets/s.xml", f"<worksheet xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_document_sources(spark, tmp_path):
    grid = [["Title"], ["№", "Skills", "x", "x"], ["", "", "", "База"], ["1", "SQL", "знает", "+"], ["2", "", "", "-"], ["3", "", "умеет", "2"]]
    (tmp_path / "a.xlsx").write_bytes(workbook(grid))
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "b.csv").write_text("h;k;l\nx;1;2\n")
    (tmp_path / "e.csv").write_text("a,x;b;\n\n" + "k;1;2\n" * 3 + '"q;r";;z\n')
    (tmp_path / "c.txt").write_bytes("Привет".encode("cp1251"))
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:p><w:r><w:t>Раз</w:t></w:r></w:p><w:p><w:r><w:t>два</w:t></w:r></w:p></w:document>")
    (tmp_path / "d.docx").write_bytes(docx.getvalue())
    books = files.files(spark, str(tmp_path), "*.xlsx")
    cells = files.xlsx_cells(books)
    assert rows(cells.where("fault is not null"), "workbook", "fault") == [("bad.xlsx", "BadZipFile")]
    got = rows(files.block_rows(cells), "row_no", "skill", "inherited_skill", "dimension", "inherited_dimension")
    assert got == [(4, "SQL", False, "знает", False), (5, "SQL", True, "знает", True), (6, "SQL", True, "умеет", False)]
    texts = dict(rows(files.brief_texts(files.files(spark, str(tmp_path)))))
    assert texts["b.csv"] == "h: k | l\n\nx: 1 | 2" and texts["e.csv"] == "a,x: b\n\n" + "k: 1 | 2\n\n" * 3 + "q;r: z" and texts["c.txt"] == "Привет" and texts["d.docx"] == "Раз\nдва" and texts["a.xlsx"] is None


def test_html_and_log_and_report(spark, tmp_path):
    html = "<h1>p</h1><h2>G&amp;1&mdash;&#8470;</h2><h3>a <b>b</b></h3><ul><li>x</li><li> y&nbsp;z </li></ul><h3>c</h3><h2>G2</h2><h3>d</h3><li>w</li>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    assert rows(files.html_hierarchy(pages), "group_name", "item_name", "leaves") == [("G&1—№", "a b", ["x", "y z"]), ("G&1—№", "c", []), ("G2", "d", ["w"])]
    (tmp_path / "u.jsonl").write_text('{"stage": "a", "n": 1}\nbroken\n{"stage": "b", "n": 2}\n')
    assert rows(files.usage_log(spark, str(tmp_path / "u.jsonl"), "stage string, n int")) == [("a", 1), ("b", 2)]
    data = files.csv_bytes(spark.createDataFrame([("x", None)], "a string, b int"), [("a", "A"), ("b", "B")], "Plan")
    assert data == b"\xef\xbb\xbfPlan,\r\nA,B\r\nx,\r\n"


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    batch = spark.sql("select timestamp'2025-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id * 7 as int),0) ts, concat('t', id % 2) event_type, cast(id as double) value, id event_id from range(40)")
    batch.write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = rollup.windowed_usage(stream).writeStream.outputMode("complete").format("memory").queryName("usage").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("usage")) == rows(rollup.windowed_usage(batch))
    d = rollup.distinct_events(spark.readStream.schema(batch.schema).parquet(src)).writeStream.format("memory").queryName("once").start()
    d.processAllAvailable()
    d.stop()
    assert spark.table("once").count() == 40
