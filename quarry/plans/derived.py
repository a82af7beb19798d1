"""Queries on text functions, similarity, graphs, mutations and rollups, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import graph, mutate, similarity
from quarry.storage import table
from quarry.streaming import rollup

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- text functions ------------------------------------------------------------------------------

_WS = r"[\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NAMES = "(SELECT id, canonical_name AS x FROM skill UNION ALL SELECT id, alias FROM skill_alias)"


def _sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


_FOLD = "replace(replace(lower(x), 'ß', 'ss'), 'ё', 'е')"
_DEDUP = reduce(lambda t, pair: f"replace({t}, '{pair[0]}', '{pair[1]}')", X.DEDUP_REPLACED, _FOLD)


@query(f"""
SELECT id, x, lower({_sql_collapse('x')}) AS plain, regexp_replace(regexp_replace(trim(lower(x)), '[^0-9a-zа-яё+ ]', ' ', 'g'), '\\s+', ' ', 'g') AS catalog, trim(regexp_replace({_FOLD}, '[^0-9a-zа-я+]+', ' ', 'g')) AS title,
 {_sql_collapse(_FOLD)} AS search, {_sql_collapse("regexp_replace(" + _FOLD + ", '[^\\p{L}\\p{N}+ ]', ' ', 'g')")} AS admin, regexp_replace({_FOLD}, '[\\s\\-_"''`().,/]+', '', 'g') AS lookup,
 {_sql_collapse("regexp_replace(" + _FOLD + ", '[^0-9a-zа-я+ ]', ' ', 'g')")} AS scope, {_sql_collapse("regexp_replace(regexp_replace(replace(" + _FOLD + ", '&', ' and '), '[\\s_/]+', ' ', 'g'), '[^0-9a-zа-я+. -]', '', 'g')")} AS dictionary, {_sql_collapse(_FOLD)} AS query,
 {_sql_collapse("regexp_replace(regexp_replace(" + _DEDUP + ", '\\([^)]*\\)', ' ', 'g'), '[^0-9a-zа-я+/ -]+', ' ', 'g')")} AS dedup
FROM {_NAMES}""")
def normalizer_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of each normalizer for all names of the catalog."""
    n = table(spark, d, "skill").select("id", F.col("canonical_name").alias("x")).unionAll(table(spark, d, "skill_alias").select("id", "alias"))
    x = F.col("x")
    keys = {"plain": X.key_plain, "catalog": X.key_catalog, "title": X.key_title, "search": X.search_norm, "admin": X.key_admin, "lookup": X.key_lookup, "scope": X.key_scope, "dictionary": X.key_dictionary, "query": X.key_query, "dedup": X.key_dedup}
    return n.select("id", "x", *[f(x).alias(k) for k, f in keys.items()])


@query("""
SELECT id, coalesce(nullif(regexp_replace(regexp_replace(lower(canonical_name), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS slug, sha256(canonical_name) AS fingerprint, substr(sha1(code), 1, 10) AS short_code FROM skill""")
def slugs_and_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "skill").select("id", X.slug(F.col("canonical_name")).alias("slug"), F.sha2("canonical_name", 256).alias("fingerprint"), F.substring(F.sha1("code"), 1, 10).alias("short_code"))


@query("""
SELECT id, list_aggregate(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower(canonical_name), 'ё', 'е'), '[^0-9a-zа-я+]+', ' ', 'g')), ' '), lambda w: length(w) >= 3))), 'string_agg', ' ') AS tokens FROM skill""")
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "skill").select("id", F.array_join(X.token_set(F.col("canonical_name")), " ").alias("tokens"))


_FAMILIES = [("check", ["аудит", "контроль", "мониторинг"]), ("build", ["построение", "проектирование", "развёртывание"]), ("describe", ["описание", "документирование"])]


@query("""
SELECT id, CASE WHEN contains(t, 'аудит') OR contains(t, 'контроль') OR contains(t, 'мониторинг') THEN 'check' WHEN contains(t, 'построение') OR contains(t, 'проектирование') OR contains(t, 'развёртывание') THEN 'build'
  WHEN contains(t, 'описание') OR contains(t, 'документирование') THEN 'describe' ELSE 'other' END AS family,
 concat_ws(',', CASE WHEN contains(t, 'аудит') OR contains(t, 'контроль') OR contains(t, 'мониторинг') THEN 'check' END, CASE WHEN contains(t, 'построение') OR contains(t, 'проектирование') OR contains(t, 'развёртывание') THEN 'build' END,
  CASE WHEN contains(t, 'описание') OR contains(t, 'документирование') THEN 'describe' END) AS tags FROM (SELECT id, lower(text) AS t FROM indicator WHERE text IS NOT NULL)""")
def keyword_family(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    return table(spark, d, "indicator").where("text is not null").select("id", X.classify(t, _FAMILIES, "other").alias("family"), F.array_join(X.tags(t, _FAMILIES), ",").alias("tags"))


@query(r"""
SELECT DISTINCT id, CASE WHEN contains(source_ref, '::') THEN split_part(source_ref, '::', 1) END AS workbook, CASE WHEN contains(source_ref, '::') THEN split_part(source_ref, '::', 2) END AS sheet,
 TRY_CAST(nullif(regexp_extract(source_ref, '::row-(\d+)$', 1), '') AS INTEGER) AS row_no, TRY_CAST(nullif(regexp_extract(source_ref, '^brief:(\d+)$', 1), '') AS BIGINT) AS brief FROM review_queue""")
def source_refs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "review_queue").select("id", X.parse_source_ref(F.col("source_ref")).alias("p"), F.regexp_extract("source_ref", r"^brief:(\d+)$", 1).try_cast("bigint").alias("brief")).distinct()
    return r.select("id", "p.workbook", "p.sheet", "p.row_no", "brief")


@query("""
SELECT cache_key, count(*) AS deliveries, bool_and(sha256(normalized_query) = cache_key)::INT AS key_fits,
 max(CASE WHEN contains(created_at, 'T') THEN CAST(CAST(created_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) ELSE CAST(created_at AS TIMESTAMP) END) AS last_created FROM evidence_query_cache GROUP BY cache_key""")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries by key, whether the key is its query's hash, and the last time in either encoding."""
    c = table(spark, d, "evidence_query_cache")
    fits = F.min((F.sha2("normalized_query", 256) == F.col("cache_key")).cast("int"))
    return c.groupBy("cache_key").agg(F.count("*").alias("deliveries"), fits.alias("key_fits"), F.max(X.timestamp_any(F.col("created_at"))).cast("timestamp_ntz").alias("last_created"))


@query("""
WITH t AS (SELECT cache_key, query, CASE WHEN contains(updated_at, 'T') THEN CAST(CAST(updated_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) ELSE CAST(updated_at AS TIMESTAMP) END AS u FROM evidence_query_cache)
SELECT count(*) AS entries, count(*) FILTER (WHERE u >= (SELECT max(u) FROM t) - INTERVAL 30 DAY) AS fresh, count(*) FILTER (WHERE u < (SELECT max(u) FROM t) - INTERVAL 30 DAY) AS stale FROM t""")
def cache_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Entries within 30 days of the newest one."""
    c = table(spark, d, "evidence_query_cache").select(X.timestamp_any(F.col("updated_at")).alias("u"))
    edge = c.agg((F.max("u") - F.expr("INTERVAL 30 DAYS")).alias("edge"))
    return c.crossJoin(F.broadcast(edge)).agg(F.count("*").alias("entries"), F.count_if(F.col("u") >= F.col("edge")).alias("fresh"), F.count_if(F.col("u") < F.col("edge")).alias("stale"))


@query(r"""
SELECT id, TRY_CAST(replace(nullif(regexp_extract(lower(raw_text), '(?:\d+(?:[.,]\d+)?\s*[-–—]\s*)?(\d+(?:[.,]\d+)?)\s*(?:мес|month)', 1), ''), ',', '.') AS DOUBLE) AS months FROM profile_brief""")
def brief_workload(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "profile_brief").select("id", X.workload(F.col("raw_text"))["months"].alias("months"))


_LABEL = "(?i)^(" + "|".join(X.SECTION_LABELS) + r")\s*[:-]\s*"


@query(rf"""
WITH p AS (SELECT id, list_transform(regexp_split_to_array(raw_text, '[\n.;•]+'), lambda s: trim(regexp_replace(regexp_replace(regexp_replace(s, '{_LABEL}', ''), '^[ \t:-]+|[ \t:-]+$', '', 'g'), '\s+', ' ', 'g'))) AS parts FROM profile_brief WHERE raw_text IS NOT NULL),
 k AS (SELECT id, list_filter(parts, lambda s: length(s) BETWEEN 12 AND 180 AND NOT regexp_matches(lower(s), '(^|[^\p{{L}}\p{{N}}_])({"|".join(X.CONTACT_WORDS)})($|[^\p{{L}}\p{{N}}_])')) AS kept FROM p),
 f AS (SELECT id, kept, list_transform(kept, lambda s: replace(lower(s), 'ё', 'е')) AS folded FROM k),
 u AS (SELECT id, list_filter(kept, lambda s, i: list_position(folded, replace(lower(s), 'ё', 'е')) = i)[1:12] AS s FROM f)
SELECT id, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM u""")
def brief_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Usable sentences of each brief in order."""
    return table(spark, d, "profile_brief").select("id", F.posexplode(X.sentences(F.col("raw_text"))).alias("pos", "sentence"))


@query()
def brief_labels(spark: SparkSession, d: str) -> DataFrame:
    """Usable sentences shortened to labels at a word, without a dangling tail."""
    return brief_sentences(spark, d).select("id", "pos", X.compact(F.col("sentence"), 8, 60).alias("label"))


@query("""
SELECT brief_id, array_to_string(list_slice(names, 1, 3), ', ') || CASE WHEN len(names) > 3 THEN ' и ещё ' || (len(names) - 3) ELSE '' END AS summary,
 array_to_string(list_transform(names, lambda x, i: x || ': ' || CASE WHEN i = len(names) THEN 100 - (100 // len(names)) * (len(names) - 1) ELSE 100 // len(names) END || '%'), ', ') AS weights
FROM (SELECT brief_id, list_sort(list(DISTINCT suggested_name)) AS names FROM skill_suggestion WHERE brief_id IS NOT NULL AND suggested_name IS NOT NULL AND decision = 'accepted' GROUP BY brief_id)""")
def joined_lists(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "skill_suggestion").where("brief_id is not null and decision = 'accepted'")
    n = s.groupBy("brief_id").agg(F.array_sort(F.collect_set("suggested_name")).alias("names"))
    return n.where("size(names) > 0").select("brief_id", X.join_limited(F.col("names"), 3).alias("summary"), X.weights_percent(F.col("names")).alias("weights"))


@query(r"""
SELECT DISTINCT id, coalesce(list_aggregate(list_transform(string_split(raw_scale_signature, '|'), lambda v: CASE WHEN v = '+' THEN 'plus' WHEN v = '-' THEN 'minus' WHEN regexp_matches(v, '^-?\d+([.,]\d+)?$') THEN 'number' ELSE 'text' END), 'string_agg', ','), '') AS kinds,
 len(string_split(raw_scale_signature, '|')) AS level_count, substr(sha1(raw_scale_signature), 1, 10) AS scale_code FROM source_block WHERE raw_scale_signature IS NOT NULL""")
def scale_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Level cells of each block's scale by kind, and the scale's code."""
    b = table(spark, d, "source_block").where("raw_scale_signature is not null")
    cells = F.split("raw_scale_signature", r"\|")
    return b.select("id", F.array_join(F.transform(cells, lambda v: X.value_kind(v)), ",").alias("kinds"), F.size(cells).cast("long").alias("level_count"), F.substring(F.sha1("raw_scale_signature"), 1, 10).alias("scale_code")).distinct()


@query("""
SELECT p_partkey, (SELECT b FROM (VALUES (8), (12), (16), (20), (24)) t(b) ORDER BY abs(b - p_size), b LIMIT 1)::INT AS hours FROM part""")
def snapped_hours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.snap(F.col("p_size"), [8, 12, 16, 20, 24]).alias("hours"))


@query("""
SELECT id, count(*) AS parts FROM (SELECT id, unnest(regexp_split_to_array(regexp_replace(suggested_name, '\\s+и\\s+', ', ', 'g'), '\\s*,\\s*')) AS part FROM skill_suggestion WHERE atomicity = 'composite' AND suggested_name IS NOT NULL) WHERE part <> '' GROUP BY id""")
def atomize_split(spark: SparkSession, d: str) -> DataFrame:
    """Composite names split at commas and conjunctions."""
    s = table(spark, d, "skill_suggestion").where("atomicity = 'composite' and suggested_name is not null")
    parts = F.filter(F.split(F.regexp_replace("suggested_name", r"\s+и\s+", ", "), r"\s*,\s*"), lambda p: p != "")
    return s.select("id", F.size(parts).cast("long").alias("parts")).where("parts > 0")


# -- similarity ----------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT id, list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower(canonical_name), 'ё', 'е'), '[^0-9a-zа-я+]+', ' ', 'g')), ' '), lambda w: length(w) >= 3)) AS k FROM skill),
 p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.k, b.k)) AS n, len(a.k) + len(b.k) AS m FROM t a JOIN t b ON a.id < b.id)
SELECT a, b, round(n / (m - n), 6) AS similarity FROM p WHERE n / (m - n) >= 0.5""")
def token_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "skill").select("id", X.token_set(F.col("canonical_name")).alias("tokens"))
    return similarity.jaccard_pairs(s, 0.5).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""
WITH t AS (SELECT id, lower(suggested_name) AS k FROM skill_suggestion WHERE suggested_name IS NOT NULL AND entity_type = 'skill'), e AS (SELECT min(id) AS id, lower(canonical_name) AS k FROM skill GROUP BY 2), a AS (SELECT max(skill_id) AS id, lower(alias) AS k FROM skill_alias GROUP BY 2)
SELECT CASE WHEN e.id IS NOT NULL THEN 'matched' WHEN a.id IS NOT NULL THEN 'alias' ELSE 'open' END AS resolution, count(DISTINCT t.k) AS names, sum(coalesce(e.id, a.id, 0))::BIGINT AS checksum FROM (SELECT DISTINCT k FROM t) t LEFT JOIN e ON e.k = t.k LEFT JOIN a ON a.k = t.k GROUP BY 1""")
def cascade_exact_alias(spark: SparkSession, d: str) -> DataFrame:
    """The exact and alias stages of the resolution, by kind."""
    r = _resolved(spark, d).withColumn("entry_id", F.when(F.col("resolution").isin("matched", "alias"), F.col("entry_id")))
    kind = F.when(F.col("resolution").isin("matched", "alias"), F.col("resolution")).otherwise("open")
    return r.groupBy(kind.alias("resolution")).agg(F.count("*").alias("names"), F.sum(F.coalesce("entry_id", F.lit(0).cast("long"))).alias("checksum"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "skill_suggestion").where("suggested_name is not null and entity_type = 'skill'").select(F.lower("suggested_name").alias("key"))
    e = table(spark, d, "skill").select(F.col("id").alias("entry_id"), F.lower("canonical_name").alias("key"))
    a = table(spark, d, "skill_alias").select(F.col("skill_id").alias("entry_id"), F.lower("alias").alias("key"))
    return similarity.resolve_cascade(v, e, a, 90.0)


@query()
def cascade_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct suggested name with its resolution: exact, alias, fuzzy or new."""
    return _resolved(spark, d)


@query()
def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Atomic skill suggestions absorbed by the first kept one of their brief that is like them."""
    s = table(spark, d, "skill_suggestion").where("entity_type = 'skill' and atomicity = 'atomic'")
    return similarity.absorb_candidates(s.select("id", F.col("brief_id").alias("run"), F.col("suggested_name").alias("name"), F.col("coverage_area").alias("area"), F.col("group_name").alias("grp")))


@query("""
WITH t AS (SELECT id, coverage_area, list_distinct(string_split(lower(suggested_name), ' ')) AS k, list_distinct(string_split(lower(group_name), ' ')) AS g FROM skill_suggestion WHERE suggested_name IS NOT NULL AND group_name IS NOT NULL)
SELECT id, round(len(list_intersect(k, g)) / least(len(k), len(g)), 6) AS overlap FROM t WHERE len(list_intersect(k, g)) / least(len(k), len(g)) >= 0.34""")
def overlap_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "skill_suggestion").where("suggested_name is not null and group_name is not null")
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    o = similarity.overlap(words("suggested_name"), words("group_name"))
    return s.select("id", o.alias("o")).where("o >= 0.34").select("id", F.round("o", 6).alias("overlap"))


# -- graphs --------------------------------------------------------------------------------------

_EDGES = "(SELECT a.k AS src, b.k AS dst FROM (SELECT row_number() OVER (ORDER BY id) AS k FROM skill) a JOIN (SELECT row_number() OVER (ORDER BY id) AS k FROM skill) b ON b.k IN (2 * a.k, 3 * a.k, 6 * a.k))"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges k -> 2k, 3k, 6k between the numbered skills; k -> 6k is redundant."""
    n = table(spark, d, "skill").agg(F.count("*").alias("n"))
    k = n.select("n", F.explode(F.expr("sequence(1L, n)")).alias("src"))
    return k.select("src", "n", F.explode(F.array(*[F.col("src") * m for m in (2, 3, 6)])).alias("dst")).where("dst <= n").select("src", "dst")


@query(f"WITH RECURSIVE e AS {_EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r")
def graph_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_edges(spark, d))


@query(f"WITH RECURSIVE e AS {_EDGES}, r AS (SELECT row_number() OVER (ORDER BY id) AS id, 0 AS level FROM skill UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id) SELECT id, max(level)::INT AS level FROM r GROUP BY id")
def graph_levels(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "skill").agg(F.count("*").alias("n")).select(F.explode(F.expr("sequence(1L, n)")).alias("id"))
    return graph.levels(n, _edges(spark, d))


@query(f"WITH e AS {_EDGES} SELECT src, dst FROM e WHERE dst <> 6 * src")
def transitive_reduction(spark: SparkSession, d: str) -> DataFrame:
    return graph.transitive_reduction(_edges(spark, d))


@query(f"WITH e AS {_EDGES} SELECT id, count(*) AS degree, count(*) FILTER (WHERE conf >= 0.8) AS reliable FROM (SELECT src AS id, (dst % 10) / 10.0 AS conf FROM e UNION ALL SELECT dst, (dst % 10) / 10.0 FROM e) GROUP BY id")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d).withColumn("conf", F.pmod("dst", F.lit(10)) / 10.0))


@query(f"WITH e AS {_EDGES}, p AS (SELECT row_number() OVER (ORDER BY id) AS id, (row_number() OVER (ORDER BY id) * 37) % 101 AS pos FROM skill) SELECT e.src, e.dst, a.pos AS src_pos, b.pos AS dst_pos FROM e JOIN p a ON a.id = e.src JOIN p b ON b.id = e.dst WHERE a.pos > b.pos")
def edge_violations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "skill").agg(F.count("*").alias("n")).select(F.explode(F.expr("sequence(1L, n)")).alias("id"))
    return graph.violations(_edges(spark, d), n.withColumn("pos", F.pmod(F.col("id") * 37, F.lit(101))))


@query(f"WITH e AS {_EDGES} SELECT 2 * src AS src, src AS dst, 0.01::DOUBLE AS conf FROM (SELECT DISTINCT src FROM e WHERE dst = 2 * src)")
def cycle_breaking(spark: SparkSession, d: str) -> DataFrame:
    """Weak back edges 2k -> k are what is taken away."""
    e = _edges(spark, d)
    back = e.where("dst = 2 * src").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.01).alias("conf"))
    return graph.break_cycles(e.withColumn("conf", F.lit(0.5)).unionByName(back))


@query("""
WITH RECURSIVE r AS (SELECT id, id AS root, 0 AS depth FROM skill_suggestion WHERE parent_suggestion_id IS NULL OR parent_suggestion_id NOT IN (SELECT id FROM skill_suggestion)
 UNION ALL SELECT s.id, r.root, r.depth + 1 FROM skill_suggestion s JOIN r ON s.parent_suggestion_id = r.id) SELECT depth::INT AS level, count(*) AS suggestions FROM r GROUP BY depth""")
def suggestion_depths(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "skill_suggestion")
    nodes = s.select("id")
    edges = s.where("parent_suggestion_id is not null").select(F.col("parent_suggestion_id").alias("src"), F.col("id").alias("dst"))
    edges = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return graph.levels(nodes, edges).groupBy("level").agg(F.count("*").alias("suggestions"))


# -- mutations -----------------------------------------------------------------------------------


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, d, "skill").select("id", F.col("canonical_name").alias("name"), "code", "group_id")
    new = table(spark, d, "typed_competency_skill").where("skill_id is not null").groupBy(F.col("skill_id").alias("id")).agg(F.min("source_skill_name").alias("name"), F.max("typed_competency_id").alias("group_id"))
    return old, new


_MERGED = "FROM skill s FULL OUTER JOIN (SELECT skill_id AS id, min(source_skill_name) AS name, max(typed_competency_id) AS group_id FROM typed_competency_skill WHERE skill_id IS NOT NULL GROUP BY 1) n ON n.id = s.id"


@query(f"SELECT coalesce(s.id, n.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.canonical_name ELSE n.name END AS name, s.code, CASE WHEN n.id IS NOT NULL THEN n.group_id ELSE s.group_id END AS group_id {_MERGED}")
def upsert_keep_old(spark: SparkSession, d: str) -> DataFrame:
    return mutate.upsert(*_sides(spark, d), ["id"], {"name": "keep_old", "group_id": "take_new"})


@query(f"SELECT coalesce(s.id, n.id) AS id, coalesce(n.name, s.canonical_name) AS name, s.code, coalesce(s.group_id, n.group_id) AS group_id {_MERGED}")
def upsert_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return mutate.upsert(*_sides(spark, d), ["id"], {"name": "coalesce_new", "group_id": "coalesce_old"})


@query("""
WITH m AS (SELECT group_id, min(id) AS keep FROM skill WHERE group_id IS NOT NULL GROUP BY 1), r AS (SELECT i.id, coalesce(m.keep, i.skill_id) AS skill_id, i.indicator_type, i.normalized_text, i.is_active FROM indicator i LEFT JOIN skill s ON s.id = i.skill_id LEFT JOIN m ON m.group_id = s.group_id)
SELECT id, skill_id, indicator_type, CASE WHEN id = min(id) OVER (PARTITION BY skill_id, indicator_type, normalized_text) THEN is_active ELSE 0 END AS is_active FROM r""")
def merge_rekey(spark: SparkSession, d: str) -> DataFrame:
    """Each group's skills merged into its first one; indicators then alike are archived."""
    s = table(spark, d, "skill").select("id", "group_id")
    keep = s.where("group_id is not null").groupBy("group_id").agg(F.min("id").alias("new"))
    mapping = s.join(keep, "group_id").select(F.col("id").alias("old"), "new")
    i = table(spark, d, "indicator").select("id", "skill_id", "indicator_type", "normalized_text", "is_active")
    return mutate.merge_rekey(i, mapping, "skill_id", ["skill_id", "indicator_type", "normalized_text"]).drop("normalized_text")


@query("""
SELECT s.id, s.canonical_name, CASE WHEN s.status = 'deprecated' THEN 0 ELSE s.is_active END AS is_active FROM skill s WHERE s.status <> 'deprecated' OR EXISTS (SELECT 1 FROM indicator i WHERE i.skill_id = s.id)""")
def soft_delete_conditional(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "skill")
    return mutate.soft_delete(s.select("id", "canonical_name", "is_active"), s.where("status = 'deprecated'").select("id"), "id", children=table(spark, d, "indicator").select(F.col("skill_id").alias("id")))


@query("""
SELECT skill_id, normalized_alias FROM skill_alias UNION SELECT skill_id, lower(source_skill_name) FROM typed_competency_skill t WHERE skill_id IS NOT NULL AND source_skill_name IS NOT NULL""")
def insert_ignore_aliases(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "skill_alias").select("skill_id", "normalized_alias")
    new = table(spark, d, "typed_competency_skill").where("skill_id is not null and source_skill_name is not null").select("skill_id", F.lower("source_skill_name").alias("normalized_alias"))
    return mutate.insert_ignore(a, new, ["skill_id", "normalized_alias"])


@query("SELECT DISTINCT id, entity_type, lower(trim(entity_type)) AS new_value FROM review_queue WHERE lower(trim(entity_type)) IS DISTINCT FROM entity_type")
def rewrite_changed(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "review_queue").select("id", "entity_type").distinct()
    return mutate.changed(r, "entity_type", F.lower(F.trim("entity_type")))


@query("""
SELECT 'unique skill_id,indicator_type,normalized_text' AS rule, skill_id || '|' || indicator_type || '|' || normalized_text AS value, count(*) AS records FROM indicator WHERE normalized_text IS NOT NULL AND skill_id IS NOT NULL AND indicator_type IS NOT NULL GROUP BY skill_id, indicator_type, normalized_text HAVING count(*) > 1
UNION ALL SELECT 'domain indicator_type', indicator_type, count(*) FROM indicator WHERE indicator_type NOT IN ('knowledge', 'ability', 'proficiency') GROUP BY indicator_type
UNION ALL SELECT 'not null complexity_band', NULL, count(*) FROM indicator WHERE complexity_band IS NULL HAVING count(*) > 0""")
def constraint_faults(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "indicator").select("skill_id", "indicator_type", "normalized_text", "complexity_band")
    return mutate.constraint_faults(i, [["skill_id", "indicator_type", "normalized_text"]], {"indicator_type": ["knowledge", "ability", "proficiency"]}, ["complexity_band"])


@query("SELECT id, skill_id, alias, source, NULL::BIGINT AS group_id FROM skill_alias WHERE source IS DISTINCT FROM 'live_snapshot' UNION ALL SELECT id, skill_id, source_skill_name, 'live_snapshot', NULL FROM typed_competency_skill WHERE source = 'live_snapshot' AND skill_id IS NOT NULL")
def replace_slice(spark: SparkSession, d: str) -> DataFrame:
    """One source's slice of the aliases replaced by its newest delivery, aligned to the target's columns."""
    a = table(spark, d, "skill_alias").select("id", "skill_id", "alias", "source").withColumn("group_id", F.lit(None).cast("bigint"))
    new = table(spark, d, "typed_competency_skill").where("source = 'live_snapshot' and skill_id is not null").select("id", "skill_id", F.col("source_skill_name").alias("alias"), "source")
    return mutate.replace_slice(a, F.col("source") == "live_snapshot", mutate.align(new, a))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS calls, round(sum(value)::DECIMAL(30,6)::DOUBLE, 2) AS value FROM events GROUP BY 1, 2")
def windowed_usage(spark: SparkSession, d: str) -> DataFrame:
    """Hourly usage; the same function serves a stream."""
    w = rollup.windowed_usage(table(spark, d, "events").select("ts", "event_type", "value"))
    return w.withColumn("value", F.round("value", 2)).withColumn("start", F.col("start").cast("timestamp_ntz"))
