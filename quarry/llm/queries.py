"""Registered queries on training data, problems 1 to 3 and 5 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import canonical, golay, language, leakage, ledger, mixing, mojibake
from quarry.operators.skew import balanced, unique_join
from quarry.storage import materialize, table

# -- 1: near-duplicates -------------------------------------------------------------------------

_P1_TABLES = ["indicator", "skill_suggestion"]


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Links and members with uid = 2 * id + number of the table."""
    ind = table(spark, d, "indicator").select((F.col("id") * 2).alias("uid"), F.lit(0).cast("long").alias("grp"), "text")
    sug = table(spark, d, "skill_suggestion").where("entity_type is distinct from 'skill'").select((F.col("id") * 2 + 1).alias("uid"), F.lit(1).cast("long").alias("grp"), F.col("suggested_name").alias("text"))
    return golay.near_duplicates(ind.unionByName(sug), 0.7)


def _p1_table(uid: str):
    return F.element_at(F.array(*map(F.lit, _P1_TABLES)), (F.pmod(uid, F.lit(2)) + 1).cast("int"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = golay.expand(*_p1(spark, d))
    half = lambda c: F.shiftright(c, 1)
    return pairs.select(_p1_table("id_a").alias("table_name"), half("id_a").alias("id_a"), half("id_b").alias("id_b"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between representatives of exact copies, with their similarity; no link is multiplied by copies."""
    links = _p1(spark, d)[0]
    return links.select(_p1_table("a").alias("table_name"), F.shiftright("a", 1).alias("id_a"), F.shiftright("b", 1).alias("id_b"), F.round("similarity", 6).alias("similarity"))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    """Every row with words and the representative of its exact copies, the smallest id."""
    return _p1(spark, d)[1].select(_p1_table("uid").alias("table_name"), F.shiftright("uid", 1).alias("id"), F.shiftright("rep", 1).alias("representative"))


# -- 2: garbled text -----------------------------------------------------------------------------


def p2_models(spark: SparkSession, d: str) -> mojibake.Models:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    sugg, block = table(spark, d, "skill_suggestion"), table(spark, d, "source_block")
    values = sugg.select(F.col("suggested_name").alias("text")).unionAll(sugg.select("group_name")).unionAll(block.select("raw_title"))
    return mojibake.train(docs, values)


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Affected values with their restored text and the chain of misreadings undone. Each distinct value is looked at once."""
    sugg, block = table(spark, d, "skill_suggestion"), table(spark, d, "source_block")
    field = lambda df, t, f: df.where(F.col(f).isNotNull()).select(F.lit(t).alias("table_name"), F.col("id").alias("row_id"), F.lit(f).alias("field_name"), F.col(f).alias("raw"))
    rows = field(sugg, "skill_suggestion", "suggested_name").unionAll(field(sugg, "skill_suggestion", "group_name")).unionAll(field(block, "source_block", "raw_title"))
    repair = mojibake.repair_column(p2_models(spark, d))
    affected = balanced(rows.select("raw").distinct(), "raw").withColumn("r", repair("raw")).where("r.chain is not null")
    affected = materialize(affected.select("raw", F.col("r.text").alias("restored"), F.col("r.chain").alias("chain")), "affected")
    return unique_join(rows, affected, ["raw"]).select("table_name", "row_id", "field_name", "raw", "restored", "chain").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_repaired(spark, d).select("table_name", "row_id", "field_name").distinct()


# -- 3: duplicates hidden by formatting ----------------------------------------------------------


def _p3(spark: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame]]:
    """Keyed rows and ledger lines of the numbered and of the named records, delivered in two batches each."""
    ind, cache = table(spark, d, "indicator"), table(spark, d, "evidence_query_cache")
    at, loaded = ledger.halves(ind), F.col("loaded_at")
    numbered = [ledger.keyed(ind, f"indicator.{c}", F.col(c), F.col("id"), at, loaded) for c in ("text", "normalized_text")]
    named = [ledger.keyed(cache, "evidence_query_cache.normalized_query", F.col("normalized_query"), F.col("cache_key"), ledger.halves(cache), loaded)]
    return [(rows, book.lines()) for rows, book in map(ledger.fold, (numbered, named))]


def _p3_scope():
    return F.substring_index("scope", ".", 1).alias("table_name"), F.substring_index("scope", ".", -1).alias("field_name")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    both = [ledger.copies(*x).select(*_p3_scope(), F.col("kept").cast("string").alias("kept_key"), F.col("key").cast("string").alias("copy_key")) for x in _p3(spark, d)]
    return both[0].unionByName(both[1])


def p3_ledger(spark: SparkSession, d: str) -> DataFrame:
    """One record per distinct content, with the number of its records and when the first was loaded."""
    both = [x[1].select(*_p3_scope(), F.col("kept").cast("string").alias("kept_key"), F.col("n").alias("records"), F.col("since").alias("first_loaded")) for x in _p3(spark, d)]
    return both[0].unionByName(both[1])


# -- 5: free-entered values to the canonical list ------------------------------------------------


def _p5(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, row_id, value, skill_id) of the rows without a skill; 0 where the value names none."""
    sugg = table(spark, d, "skill_suggestion").where("entity_type = 'skill' and canonical_skill_id is null").select(F.lit("skill_suggestion").alias("table_name"), F.col("id").alias("row_id"), F.col("suggested_name").alias("value"))
    typed = table(spark, d, "typed_competency_skill").where("skill_id is null").select(F.lit("typed_competency_skill").alias("table_name"), F.col("id").alias("row_id"), F.col("source_skill_name").alias("value"))
    rows = sugg.unionByName(typed)
    skill, alias = table(spark, d, "skill"), table(spark, d, "skill_alias")
    names = skill.select(F.col("id").alias("entry_id"), F.col("canonical_name").alias("name")).unionByName(alias.select(F.col("skill_id").alias("entry_id"), F.col("alias").alias("name")))
    found = canonical.map_values(rows, names, skill.select(F.col("id").alias("entry_id"), "code"), p2_models(spark, d))
    return unique_join(rows, materialize(found, "mapped"), ["value"], how="left").select("table_name", "row_id", "value", F.coalesce("entry_id", F.lit(0).cast("long")).alias("skill_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).select("table_name", "row_id", "skill_id").distinct()


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that name no skill, with the rows that hold them."""
    return _p5(spark, d).where("skill_id = 0").groupBy("table_name", "value").agg(F.countDistinct("row_id").alias("records"))


# -- 6: evaluation texts in the corpus -----------------------------------------------------------


def _p6(spark: SparkSession, d: str, edits: int = 0) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return leakage.find_leaks(docs, table(spark, d, "eval_item").select("item_id", "text"), words=12, edits=edits)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).select("doc_id", "item_id")


def p6_edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items that share a passage but for two characters at most, with the edits it takes."""
    return _p6(spark, d, edits=2)


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return _p6(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


# -- 7: mixing sources ---------------------------------------------------------------------------


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized documents, their mixture and the targets; topic is the profile."""
    docs = table(spark, d, "documents").where("text is not null")
    sized = materialize(docs.select(F.col("doc_id").alias("id"), "source", "lang", F.col("profile_slug").alias("topic"), mixing.token_counter()("text").alias("tokens")), "sized")
    targets = table(spark, d, "mix_target")
    return sized, mixing.mix(sized, targets), targets


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)[1]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_p7(spark, d))


# -- 8: languages --------------------------------------------------------------------------------


def _p8(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return language.segments(docs, language.train(docs))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d).where("lang is distinct from label").select(F.col("id").alias("doc_id"), "seg_no", "lang").distinct()


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d).select(F.col("id").alias("doc_id"), "seg_no", "lang", "confidence")


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.documents(_p8(spark, d)).withColumnRenamed("id", "doc_id")


QUERIES = {"p1_found": p1_found, "p1_links": p1_links, "p1_members": p1_members, "p2_found": p2_found, "p2_repaired": p2_repaired, "p3_found": p3_found, "p3_ledger": p3_ledger, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p6_found": p6_found, "p6_items": p6_items, "p6_edited": p6_edited, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_segments": p8_segments, "p8_documents": p8_documents}

# -- SQL -----------------------------------------------------------------------------------------

_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def _sql_words(x: str, also: str = "") -> str:
    """Words of a text. DuckDB has NFC only: of the compatibility forms, wide letters, the number sign and the ellipsis are mapped, blanks part words anyway."""
    compatible = f"replace(replace(translate({x}, '{_WIDE}', '{_NARROW.replace(chr(39), chr(39) * 2)}'), '№', 'No'), '…', '...')"
    shown = f"regexp_replace(nfc_normalize({compatible}), '\\p{{Cf}}', '', 'g')"
    return f"regexp_extract_all(replace(lower({shown}), 'ё', 'е'), '[\\p{{L}}\\p{{N}}{also}]+')"


_SQL_P1 = f"""
WITH t AS (SELECT 'indicator' AS table_name, id, array_to_string({_sql_words('text', '+#')}, ' ') AS ws FROM indicator WHERE text IS NOT NULL
  UNION ALL SELECT 'skill_suggestion', id, array_to_string({_sql_words('suggested_name', '+#')}, ' ') FROM skill_suggestion WHERE entity_type IS DISTINCT FROM 'skill' AND suggested_name IS NOT NULL),
 u AS (SELECT *, dense_rank() OVER (ORDER BY table_name, ws) AS rep FROM t WHERE ws <> ''),
 g AS (SELECT DISTINCT rep, table_name, unnest(list_distinct(list_transform(range(1, length(ws) - 1), lambda i: substr(ws, i, 3)))) AS gram FROM u WHERE length(ws) >= 3),
 n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
 f AS (SELECT table_name, gram, count(*) AS df FROM g GROUP BY table_name, gram),
 o AS (SELECT g.*, row_number() OVER (PARTITION BY rep ORDER BY df, gram) AS place FROM g JOIN f USING (table_name, gram)),
 p AS (SELECT o.*, n.n FROM o JOIN n USING (rep) WHERE place <= n - ceil(0.7 * n - 1e-9) + 1),
 c AS (SELECT DISTINCT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.table_name = b.table_name AND a.gram = b.gram AND a.rep < b.rep WHERE least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) - 1e-9),
 k AS (SELECT a, b, na, nb, count(*) AS met FROM c JOIN g x ON x.rep = a JOIN g y ON y.rep = b AND y.gram = x.gram GROUP BY ALL),
 s AS (SELECT a, b, met / (na + nb - met) AS similarity FROM k WHERE met / (na + nb - met) >= 0.7)"""


def _sql_p3(table_name: str, field: str, key: str) -> str:
    canon = f"array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array({field}, '[;|]'), lambda p: array_to_string({_sql_words('p', '+#')}, ' ')), lambda p: p <> '')), ';')"
    return f"SELECT '{table_name}' AS table_name, '{field}' AS field_name, {key} AS key, {canon} AS canon, loaded_at FROM {table_name} WHERE {field} IS NOT NULL AND {key} IS NOT NULL"


def _sql_p3_all(columns: str, rest: str) -> str:
    kinds = ([("indicator", "text", "id"), ("indicator", "normalized_text", "id")], [("evidence_query_cache", "normalized_query", "cache_key")])
    return " UNION ALL ".join(f"SELECT {columns} FROM (SELECT * FROM (" + " UNION ALL ".join(_sql_p3(*k) for k in some) + f") WHERE canon <> '') {rest}" for some in kinds)


_SQL_P6 = f"""
WITH i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS win FROM (SELECT item_id, {_sql_words('text')} AS w FROM eval_item WHERE text IS NOT NULL)),
 d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS win FROM (SELECT doc_id, {_sql_words('text')} AS w FROM documents WHERE text IS NOT NULL)),
 l AS (SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (win))"""

#: Where SQL can't express an operator, its tests hold it against brute force, a round trip or held-out rows instead.
SQL: dict[str, str] = {
    "p1_found": _SQL_P1 + " SELECT x.table_name, least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM s JOIN u x ON x.rep = s.a JOIN u y ON y.rep = s.b",
    "p1_links": _SQL_P1 + ", m AS (SELECT rep, any_value(table_name) AS table_name, min(id) AS id FROM u GROUP BY rep) SELECT x.table_name, least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b, round(similarity, 6) AS similarity FROM s JOIN m x ON x.rep = s.a JOIN m y ON y.rep = s.b",
    "p1_members": _SQL_P1.split(" g AS (")[0].rstrip().rstrip(",") + " SELECT table_name, id, min(id) OVER (PARTITION BY rep) AS representative FROM u",
    "p3_found": _sql_p3_all("DISTINCT table_name, field_name, kept_key::VARCHAR AS kept_key, key::VARCHAR AS copy_key", "").replace("(SELECT * FROM (", "(SELECT *, min(key) OVER (PARTITION BY table_name, field_name, canon) AS kept_key FROM (").replace("canon <> '') ", "canon <> '') WHERE key <> kept_key"),
    "p3_ledger": _sql_p3_all("table_name, field_name, min(key)::VARCHAR AS kept_key, count(*) AS records, min(loaded_at) AS first_loaded", "GROUP BY table_name, field_name, canon"),
    "p6_found": _SQL_P6 + " SELECT doc_id, item_id FROM l",
    "p6_items": _SQL_P6 + " SELECT item_id, count(*) AS documents FROM l GROUP BY item_id",
}
