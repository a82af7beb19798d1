"""Read queries on the catalog: filters, searches, joins, aggregates, ordered computations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as X
from quarry.storage import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def matching(df: DataFrame, **conditions: str | None) -> DataFrame:
    """Rows meeting every given condition; None or ``all`` is no condition. Catalyst pushes the rest into the scan."""
    wanted = [F.col(c) == v for c, v in conditions.items() if v not in (None, "all")]
    return df.where(reduce(Column.__and__, wanted)) if wanted else df


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order, by a partial sort of each key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


# -- joins and distinct counts -------------------------------------------------------------------


@query("""
SELECT s.id AS skill_id, s.canonical_name, count(DISTINCT i.id) AS indicators, count(DISTINCT i.source_profile_name) AS profiles
FROM skill s JOIN indicator i ON i.skill_id = s.id GROUP BY s.id, s.canonical_name""")
def skill_usage(spark: SparkSession, d: str) -> DataFrame:
    """Indicators, whose id is unique, are counted per skill before the join."""
    i = table(spark, d, "indicator").groupBy("skill_id").agg(F.count("*").alias("indicators"), F.count_distinct("source_profile_name").alias("profiles"))
    return table(spark, d, "skill").select(F.col("id").alias("skill_id"), "canonical_name").join(i, "skill_id")


@query("SELECT * FROM (" + SQL["skill_usage"] + ") ORDER BY profiles DESC, indicators DESC, canonical_name, skill_id LIMIT 15")
def top_shared_skills(spark: SparkSession, d: str) -> DataFrame:
    return skill_usage(spark, d).orderBy(F.desc("profiles"), F.desc("indicators"), "canonical_name", "skill_id").limit(15)


@query("""
SELECT id, reason_code, severity, created_at FROM review_queue WHERE status = 'open' AND reason_code = 'title_dirty'
ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, created_at DESC, id LIMIT 500""")
def review_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = matching(table(spark, d, "review_queue"), status="open", severity="all", reason_code="title_dirty", entity_type=None)
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return rows.orderBy(rank, F.desc("created_at"), "id").limit(500).select("id", "reason_code", "severity", "created_at")


@query("SELECT status, reason_code, count(*) AS reviews FROM review_queue GROUP BY status, reason_code")
def review_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "review_queue").groupBy("status", "reason_code").agg(F.count("*").alias("reviews"))


@query("""
SELECT DISTINCT 'severity' AS field, severity AS value FROM review_queue UNION SELECT DISTINCT 'status', status FROM review_queue
UNION SELECT DISTINCT 'entity_type', lower(trim(entity_type)) FROM review_queue""")
def review_options(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "review_queue")
    one = lambda name, c: r.select(F.lit(name).alias("field"), c.alias("value")).distinct()
    return one("severity", F.col("severity")).union(one("status", F.col("status"))).union(one("entity_type", F.lower(F.trim("entity_type"))))


@query("""
SELECT s.group_id, count(DISTINCT CASE WHEN s.is_active = 1 THEN s.id END) AS active_skills, count(DISTINCT s.id) AS skills,
       count(DISTINCT CASE WHEN i.is_active = 1 THEN i.id END) AS active_indicators, count(DISTINCT i.id) AS indicators
FROM skill s LEFT JOIN indicator i ON i.skill_id = s.id GROUP BY s.group_id""")
def group_overview(spark: SparkSession, d: str) -> DataFrame:
    """Children are counted per skill before the join, so nothing fans out."""
    i = table(spark, d, "indicator").groupBy("skill_id").agg(F.count_if(F.col("is_active") == 1).alias("a"), F.count("*").alias("n"))
    s = table(spark, d, "skill").select("id", "group_id", "is_active")
    zero = F.lit(0).cast("long")
    return (
        s.join(i, s["id"] == i["skill_id"], "left")
        .groupBy("group_id")
        .agg(F.count_if(F.col("is_active") == 1).alias("active_skills"), F.count("*").alias("skills"), F.coalesce(F.sum("a"), zero).alias("active_indicators"), F.coalesce(F.sum("n"), zero).alias("indicators"))
    )


@query("""
SELECT typed_competency_id, count(DISTINCT CASE WHEN resolution_status = 'matched' THEN skill_id END) AS matched, count(DISTINCT CASE WHEN resolution_status = 'alias' THEN skill_id END) AS alias,
       count(DISTINCT CASE WHEN resolution_status = 'fuzzy' THEN skill_id END) AS fuzzy, count(DISTINCT CASE WHEN resolution_status = 'manual' THEN skill_id END) AS manual, count(*) AS items
FROM typed_competency_skill GROUP BY typed_competency_id""")
def role_pivot_distinct(spark: SparkSession, d: str) -> DataFrame:
    role = lambda r: F.count_distinct(F.when(F.col("resolution_status") == r, F.col("skill_id"))).alias(r)
    return table(spark, d, "typed_competency_skill").groupBy("typed_competency_id").agg(role("matched"), role("alias"), role("fuzzy"), role("manual"), F.count("*").alias("items"))


@query("""
SELECT source_profile_name AS profile, count(DISTINCT skill_id) AS skills, count(*) AS indicators, sum(CASE WHEN is_active = 0 THEN 1 ELSE 0 END)::BIGINT AS archived
FROM indicator WHERE source_profile_name IS NOT NULL AND source_profile_name <> 'Профиль Vigux' GROUP BY 1""")
def profile_counts(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "indicator").where("source_profile_name is not null and source_profile_name <> 'Профиль Vigux'")
    return i.groupBy(F.col("source_profile_name").alias("profile")).agg(F.count_distinct("skill_id").alias("skills"), F.count("*").alias("indicators"), F.count_if(F.col("is_active") == 0).alias("archived"))


# -- searches ------------------------------------------------------------------------------------

_NEEDLE = "аудит"


@query("""
SELECT s.id, s.canonical_name FROM skill s WHERE contains(lower(s.canonical_name), 'аудит')
   OR EXISTS (SELECT 1 FROM skill_alias a WHERE a.skill_id = s.id AND contains(lower(a.alias), 'аудит'))
   OR EXISTS (SELECT 1 FROM indicator i WHERE i.skill_id = s.id AND contains(lower(i.text), 'аудит'))""")
def scope_search_any(spark: SparkSession, d: str) -> DataFrame:
    """Skills found by their own name or by a child's text: each branch a set of ids, one semi join."""
    has = lambda t, c, k: table(spark, d, t).where(F.lower(c).contains(_NEEDLE)).select(F.col(k).alias("id"))
    ids = has("skill", "canonical_name", "id").union(has("skill_alias", "alias", "skill_id")).union(has("indicator", "text", "skill_id")).distinct()
    return table(spark, d, "skill").select("id", "canonical_name").join(ids, "id", "left_semi")


@query("""
SELECT s.id, s.canonical_name FROM skill s WHERE s.id <> 1 AND s.is_active = 1 AND (contains(replace(lower(s.canonical_name), 'ё', 'е'), 'отчет') OR contains(lower(s.code), 'отчет')
   OR EXISTS (SELECT 1 FROM skill_alias a WHERE a.skill_id = s.id AND contains(replace(lower(a.alias), 'ё', 'е'), 'report'))) ORDER BY s.canonical_name, s.id LIMIT 15""")
def alias_search_topk(spark: SparkSession, d: str) -> DataFrame:
    alias = table(spark, d, "skill_alias").where(X.search_norm(F.col("alias")).contains("report")).select(F.col("skill_id").alias("id")).distinct().withColumn("by_alias", F.lit(True))
    s = table(spark, d, "skill").where("id <> 1 and is_active = 1").join(alias, "id", "left")
    own = X.search_norm(F.col("canonical_name")).contains("отчет") | X.search_norm(F.col("code")).contains("отчет")
    return s.where(own | F.col("by_alias").isNotNull()).orderBy("canonical_name", "id").limit(15).select("id", "canonical_name")


@query("""
SELECT i.id, i.skill_id, s.canonical_name FROM indicator i JOIN skill s ON s.id = i.skill_id
WHERE i.is_active = 0 AND (contains(replace(lower(i.text), 'ё', 'е'), 'расчет') OR contains(replace(lower(s.canonical_name), 'ё', 'е'), 'расчет'))""")
def archived_search(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "indicator").where("is_active = 0").select("id", "skill_id", "text")
    s = table(spark, d, "skill").select(F.col("id").alias("skill_id"), "canonical_name")
    hit = X.search_norm(F.col("text")).contains("расчет") | X.search_norm(F.col("canonical_name")).contains("расчет")
    return i.join(s, "skill_id").where(hit).select("id", "skill_id", "canonical_name")


@query("""
SELECT s.group_id, s.id, s.canonical_name FROM skill s JOIN (SELECT group_id FROM skill WHERE group_id IS NOT NULL GROUP BY group_id HAVING max(CASE WHEN contains(lower(canonical_name), 'аудит') THEN 1 ELSE 0 END) = 1) g USING (group_id)""")
def hierarchy_filter(spark: SparkSession, d: str) -> DataFrame:
    """A group with a hit keeps all of its skills."""
    s = table(spark, d, "skill").where("group_id is not null").select("group_id", "id", "canonical_name")
    hit = s.where(F.lower("canonical_name").contains(_NEEDLE)).select("group_id").distinct()
    return s.join(hit, "group_id", "left_semi")


@query("""
SELECT model, sum(CASE WHEN json_valid(response_json) THEN 1 ELSE 0 END)::BIGINT AS valid, sum(CASE WHEN NOT json_valid(response_json) THEN 1 ELSE 0 END)::BIGINT AS broken,
       sum(CASE WHEN NOT (json_valid(response_json) AND coalesce(json_extract_string(CASE WHEN json_valid(response_json) THEN response_json END, '$[0].source_type'), '') = 'framework') THEN 1 ELSE 0 END)::BIGINT AS not_framework
FROM evidence_query_cache WHERE response_json IS NOT NULL GROUP BY model""")
def json_guarded_filter(spark: SparkSession, d: str) -> DataFrame:
    ok = F.try_parse_json("response_json").isNotNull()
    kind = F.when(ok, F.get_json_object("response_json", "$[0].source_type"))
    rows = table(spark, d, "evidence_query_cache").where("response_json is not null")
    return rows.groupBy("model").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("broken"), F.count_if(~F.coalesce(kind == "framework", F.lit(False))).alias("not_framework"))


# -- latest rows, anti and semi joins ------------------------------------------------------------


@query("""
SELECT b.id AS brief_id, b.role, l.id AS suggestion_id, l.decision FROM profile_brief b LEFT JOIN
 (SELECT * FROM (SELECT id, brief_id, decision, row_number() OVER (PARTITION BY brief_id ORDER BY loaded_at DESC, id DESC) AS rn FROM skill_suggestion WHERE brief_id IS NOT NULL) WHERE rn = 1) l ON l.brief_id = b.id""")
def latest_child_per_parent(spark: SparkSession, d: str) -> DataFrame:
    """Argmax by aggregation, combined map-side, instead of a sort of every parent's children."""
    s = table(spark, d, "skill_suggestion").where("brief_id is not null")
    last = s.groupBy("brief_id").agg(F.max_by(F.struct("id", "decision"), F.struct("loaded_at", "id")).alias("l"))
    return table(spark, d, "profile_brief").select(F.col("id").alias("brief_id"), "role").join(last, "brief_id", "left").select("brief_id", "role", F.col("l.id").alias("suggestion_id"), F.col("l.decision").alias("decision"))


@query("SELECT b.id, b.role FROM profile_brief b WHERE NOT EXISTS (SELECT 1 FROM skill_suggestion s WHERE s.brief_id = b.id AND s.decision = 'accepted')")
def anti_empty_parents(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "skill_suggestion").where("decision = 'accepted'").select(F.col("brief_id").alias("id"))
    return table(spark, d, "profile_brief").select("id", "role").join(s, "id", "left_anti")


@query("SELECT b.id, b.role FROM profile_brief b WHERE b.id IN (SELECT brief_id FROM skill_suggestion WHERE decision = 'accepted' AND atomicity = 'atomic' AND entity_type = 'skill')")
def semi_parents(spark: SparkSession, d: str) -> DataFrame:
    s = matching(table(spark, d, "skill_suggestion"), decision="accepted", atomicity="atomic", entity_type="skill").select(F.col("brief_id").alias("id"))
    return table(spark, d, "profile_brief").select("id", "role").join(s, "id", "left_semi")


@query("""
SELECT r.r_name AS region, string_agg(n.n_name || '(' || coalesce(s.suppliers, 0) || ')', ', ' ORDER BY n.n_name) AS nations, sum(coalesce(s.suppliers, 0))::BIGINT AS suppliers
FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) s ON s.s_nationkey = n.n_nationkey GROUP BY 1""")
def nested_tree(spark: SparkSession, d: str) -> DataFrame:
    """Region, nation, supplier assembled bottom-up into one row a region."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    n = table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").withColumn("suppliers", F.coalesce("suppliers", F.lit(0).cast("long")))
    nested = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_name", "suppliers"))).alias("c"), F.sum("suppliers").alias("suppliers"))
    r = table(spark, d, "region").join(nested, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return r.select(F.col("r_name").alias("region"), F.array_join(F.transform("c", lambda x: F.concat(x["n_name"], F.lit("("), x["suppliers"].cast("string"), F.lit(")"))), ", ").alias("nations"), "suppliers")


@query("""
SELECT s.id, s.canonical_name, count(q.id) AS open_reviews FROM skill s LEFT JOIN (SELECT DISTINCT id, entity_id, entity_type, status FROM review_queue) q
  ON lower(trim(q.entity_type)) = 'skill' AND q.entity_id = s.id AND q.status = 'open' WHERE s.status = 'candidate' OR q.id IS NOT NULL GROUP BY s.id, s.canonical_name""")
def multi_condition_left_join(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "review_queue").where((F.lower(F.trim("entity_type")) == "skill") & (F.col("status") == "open")).select(F.col("id").alias("review_id"), F.col("entity_id").alias("id")).distinct()
    n = q.groupBy("id").agg(F.count("*").alias("open_reviews"))
    s = table(spark, d, "skill").join(n, "id", "left").where("status = 'candidate' or open_reviews is not null")
    return s.select("id", "canonical_name", F.coalesce("open_reviews", F.lit(0).cast("long")).alias("open_reviews"))


_SIDES = """
WITH l AS (SELECT lower(suggested_name) AS k, count(*) AS n FROM skill_suggestion WHERE suggested_name IS NOT NULL GROUP BY 1), r AS (SELECT lower(source_skill_name) AS k, count(*) AS n FROM typed_competency_skill WHERE source_skill_name IS NOT NULL GROUP BY 1)
"""


@query(_SIDES + "SELECT coalesce(l.k, r.k) AS name, CASE WHEN r.k IS NULL THEN 'left' WHEN l.k IS NULL THEN 'right' ELSE 'both' END AS side, coalesce(l.n, 0) AS left_rows, coalesce(r.n, 0) AS right_rows FROM l FULL OUTER JOIN r ON l.k = r.k")
def full_outer_diff(spark: SparkSession, d: str) -> DataFrame:
    side = lambda t, c, n: table(spark, d, t).where(F.col(c).isNotNull()).groupBy(F.lower(c).alias("name")).agg(F.count("*").alias(n))
    j = side("skill_suggestion", "suggested_name", "left_rows").join(side("typed_competency_skill", "source_skill_name", "right_rows"), "name", "full_outer")
    where = F.when(F.col("right_rows").isNull(), "left").when(F.col("left_rows").isNull(), "right").otherwise("both")
    return j.select("name", where.alias("side"), F.coalesce("left_rows", F.lit(0).cast("long")).alias("left_rows"), F.coalesce("right_rows", F.lit(0).cast("long")).alias("right_rows"))


@query("""
WITH a AS (SELECT id, lower(suggested_name) AS k, row_number() OVER (PARTITION BY lower(suggested_name) ORDER BY id) AS n FROM skill_suggestion WHERE suggested_name IS NOT NULL),
     b AS (SELECT id, lower(source_skill_name) AS k, row_number() OVER (PARTITION BY lower(source_skill_name) ORDER BY id) AS n FROM typed_competency_skill WHERE source_skill_name IS NOT NULL)
SELECT a.id AS suggestion_id, b.id AS typed_id FROM a JOIN b ON a.k = b.k AND a.n = b.n""")
def positional_match(spark: SparkSession, d: str) -> DataFrame:
    """The n-th row of a key on one side meets the n-th on the other."""
    nth = lambda t, c, out: table(spark, d, t).where(F.col(c).isNotNull()).select(F.col("id").alias(out), F.lower(c).alias("k")).withColumn("n", F.row_number().over(W.partitionBy("k").orderBy(out)))
    return nth("skill_suggestion", "suggested_name", "suggestion_id").join(nth("typed_competency_skill", "source_skill_name", "typed_id"), ["k", "n"]).select("suggestion_id", "typed_id")


@query("""
WITH t AS (SELECT id, regexp_extract(text, '«([^»]*)»', 1) AS name FROM indicator WHERE text IS NOT NULL), p AS (SELECT DISTINCT skill_id, regexp_extract(alias, '^([^-]+)-', 1) AS name FROM skill_alias)
SELECT t.id, t.name, min(p.skill_id) AS skill_id FROM t JOIN p ON lower(p.name) = lower(t.name) WHERE t.name <> '' GROUP BY t.id, t.name HAVING count(*) = 1""")
def unique_match_join(spark: SparkSession, d: str) -> DataFrame:
    """A name quoted in a text meets an alias stem only where there is exactly one; ambiguous names go before the join."""
    t = table(spark, d, "indicator").select("id", F.regexp_extract("text", "«([^»]*)»", 1).alias("name")).where("name <> ''")
    p = table(spark, d, "skill_alias").select("skill_id", F.lower(F.regexp_extract("alias", "^([^-]+)-", 1)).alias("k")).distinct()
    single = p.groupBy("k").agg(F.count("*").alias("n"), F.min("skill_id").alias("skill_id")).where("n = 1")
    return t.withColumn("k", F.lower("name")).join(single, "k").select("id", "name", "skill_id")


@query("""
SELECT tool, count(DISTINCT id) AS suggestions FROM (SELECT id, unnest(json_extract_string(tools, '$[*]')) AS tool FROM skill_suggestion WHERE tools IS NOT NULL AND json_valid(tools)) GROUP BY tool""")
def tool_usage(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "skill_suggestion").select("id", F.explode(F.from_json("tools", "array<string>")).alias("tool"))
    return t.groupBy("tool").agg(F.count_distinct("id").alias("suggestions"))


# -- aggregates ----------------------------------------------------------------------------------


@query("""
SELECT skill_id, arg_min(complexity_band, (complexity_sort_order, id)) AS min_band, arg_max(complexity_band, (complexity_sort_order, id)) AS max_band,
       CASE WHEN count(DISTINCT source_scale_title) > 1 THEN 'mixed' ELSE min(source_scale_title) END AS scale
FROM indicator WHERE complexity_sort_order IS NOT NULL GROUP BY skill_id""")
def argminmax_band(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "indicator").where("complexity_sort_order is not null")
    o = F.struct("complexity_sort_order", "id")
    scale = F.when(F.min("source_scale_title") != F.max("source_scale_title"), "mixed").otherwise(F.min("source_scale_title"))
    return i.groupBy("skill_id").agg(F.min_by("complexity_band", o).alias("min_band"), F.max_by("complexity_band", o).alias("max_band"), scale.alias("scale"))


@query("SELECT group_id, string_agg(DISTINCT skill_type, ',' ORDER BY skill_type) AS types FROM skill WHERE group_id IS NOT NULL GROUP BY group_id")
def string_agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "skill").where("group_id is not null")
    return s.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("skill_type")), ",").alias("types"))


@query("""
SELECT event_type AS stage, count(*) AS calls, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS tokens, round(sum(value)::DECIMAL(30,6)::DOUBLE, 2) AS latency, grouping(event_type)::INT AS is_total
FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def usage_rollup_with_total(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    r = e.rollup("stage").agg(F.count("*").alias("calls"), F.sum("k").alias("tokens"), F.round(F.sum("value"), 2).alias("latency"), F.grouping("stage").cast("int").alias("is_total"))
    return r.select("stage", "calls", "tokens", "latency", "is_total")


@query("""
WITH g AS (SELECT event_type, user_id % 10 AS model, count(*) AS calls, max(value) AS slowest FROM events GROUP BY 1, 2)
SELECT event_type AS stage, sum(calls)::BIGINT AS calls, max(slowest) AS slowest, string_agg(model::VARCHAR, ',' ORDER BY model) AS models FROM g GROUP BY 1""")
def stage_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("stage"), F.pmod("user_id", F.lit(10)).alias("model")).agg(F.count("*").alias("calls"), F.max("value").alias("slowest"))
    return g.groupBy("stage").agg(F.sum("calls").alias("calls"), F.max("slowest").alias("slowest"), F.array_join(F.transform(F.array_sort(F.collect_list("model")), lambda m: m.cast("string")), ",").alias("models"))


@query("""
SELECT coverage_area, count(*) AS candidates, count(*) FILTER (WHERE decision = 'accepted') AS accepted, count(*) FILTER (WHERE canonical_skill_id IS NOT NULL) AS matched,
       CASE WHEN count(*) FILTER (WHERE canonical_skill_id IS NOT NULL) > 0 THEN count(*) FILTER (WHERE decision = 'rejected' AND canonical_skill_id IS NOT NULL) * 1000 // count(*) FILTER (WHERE canonical_skill_id IS NOT NULL) ELSE 0 END AS false_permille
FROM skill_suggestion GROUP BY coverage_area""")
def guarded_rates(spark: SparkSession, d: str) -> DataFrame:
    has = F.col("canonical_skill_id").isNotNull()
    g = table(spark, d, "skill_suggestion").groupBy("coverage_area").agg(F.count("*").alias("candidates"), F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count_if(has).alias("matched"), F.count_if(has & (F.col("decision") == "rejected")).alias("_false"))
    return g.withColumn("false_permille", F.when(F.col("matched") > 0, F.expr("_false * 1000 div matched")).otherwise(F.lit(0).cast("long"))).drop("_false")


@query("""
SELECT * FROM (SELECT id, coverage_area, row_number() OVER (PARTITION BY coverage_area ORDER BY CASE decision WHEN 'accepted' THEN 0 WHEN 'needs_review' THEN 1 ELSE 2 END, CASE WHEN canonical_skill_id IS NULL THEN 1 ELSE 0 END, confidence DESC, length(suggested_name), id) AS place
 FROM skill_suggestion WHERE coverage_area IS NOT NULL) WHERE place <= 4""")
def topk_per_area(spark: SparkSession, d: str) -> DataFrame:
    """Spark's window group limit keeps each task's first four per area before the shuffle."""
    rank = [F.when(F.col("decision") == "accepted", 0).when(F.col("decision") == "needs_review", 1).otherwise(2), F.col("canonical_skill_id").isNull().cast("int"), F.desc("confidence"), F.length("suggested_name"), F.col("id")]
    s = table(spark, d, "skill_suggestion").where("coverage_area is not null")
    return s.withColumn("place", F.row_number().over(W.partitionBy("coverage_area").orderBy(*rank))).where("place <= 4").select("id", "coverage_area", "place")


@query("SELECT l_suppkey AS src, l_partkey AS dst, max(l_extendedprice) AS weight, count(*) AS repeats FROM lineitem GROUP BY 1, 2")
def dedup_best_edge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.max("l_extendedprice").alias("weight"), F.count("*").alias("repeats"))


@query("""
SELECT indicator_type, complexity_band, count(*) AS indicators, count(DISTINCT skill_id) AS skills FROM indicator GROUP BY ROLLUP (indicator_type, complexity_band)""")
def rollup_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indicator").rollup("indicator_type", "complexity_band").agg(F.count("*").alias("indicators"), F.count_distinct("skill_id").alias("skills"))


# -- ordered computations ------------------------------------------------------------------------


@query("""
SELECT id, source_profile_name, last_value(complexity_label IGNORE NULLS) OVER (PARTITION BY source_profile_name ORDER BY id ROWS UNBOUNDED PRECEDING) AS label, CASE WHEN complexity_label IS NULL THEN 1 ELSE 0 END AS inherited
FROM indicator WHERE source_profile_name IS NOT NULL""")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("source_profile_name").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    i = table(spark, d, "indicator").where("source_profile_name is not null")
    return i.select("id", "source_profile_name", F.last("complexity_label", True).over(w).alias("label"), F.col("complexity_label").isNull().cast("int").alias("inherited"))


_EFFORT = "SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS hours FROM orders"


@query(f"""
WITH h AS ({_EFFORT}) SELECT o_orderkey, hours, CAST(sum(hours) OVER w AS BIGINT) AS hours_so_far, CAST(sum(hours) OVER w * 1000 // nullif(sum(hours) OVER (PARTITION BY o_custkey), 0) AS BIGINT) AS done_permille,
 CASE WHEN hours >= 12 THEN 1 ELSE 0 END AS peer FROM h WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def running_effort(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_totalprice") / 1000).alias("hours"))
    run, whole = F.sum("hours").over(W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, 0)), F.sum("hours").over(W.partitionBy("o_custkey"))
    o = o.withColumn("hours_so_far", run).withColumn("_all", whole)
    return o.select("o_orderkey", "hours", "hours_so_far", F.expr("hours_so_far * 1000 div nullif(_all, 0)").alias("done_permille"), (F.col("hours") >= 12).cast("int").alias("peer"))


@query(f"""
WITH h AS (SELECT *, sum(hours) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back FROM ({_EFFORT})),
r AS (SELECT *, greatest(4, CAST(floor(hours * 1000.0 / nullif(total, 0) / 2 + 0.5) AS BIGINT) * 2) AS even FROM h)
SELECT o_orderkey, o_custkey, CAST(CASE WHEN back = 1 THEN 1000 - (sum(even) OVER (PARTITION BY o_custkey) - even) ELSE even END AS BIGINT) AS hours FROM r WHERE total > 0""")
def rescale_to_target(spark: SparkSession, d: str) -> DataFrame:
    """Hours scaled to 1000 a customer in even steps of at least 4; the last order takes the rest."""
    c = W.partitionBy("o_custkey")
    h = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_totalprice") / 1000).alias("hours"))
    h = h.withColumn("total", F.sum("hours").over(c)).where("total > 0").withColumn("back", F.row_number().over(c.orderBy(F.desc("o_orderkey"))))
    even = F.greatest(F.lit(4).cast("long"), F.floor(F.col("hours") * 1000.0 / F.col("total") / 2 + 0.5) * 2)
    r = h.withColumn("even", even).withColumn("sum", F.sum("even").over(c))
    return r.select("o_orderkey", "o_custkey", F.when(F.col("back") == 1, 1000 - (F.col("sum") - F.col("even"))).otherwise(F.col("even")).alias("hours"))


@query("""
SELECT id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY id) AS n, CAST((row_number() OVER (PARTITION BY group_id ORDER BY id) - 1) // 4 + 1 AS BIGINT) AS block,
 coalesce(max(id) OVER (PARTITION BY group_id), 0) + 10 * row_number() OVER (PARTITION BY group_id ORDER BY id) AS next_key FROM skill""")
def number_and_chunk(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("group_id").orderBy("id"))
    s = table(spark, d, "skill").select("id", "group_id", n.alias("n"), F.max("id").over(W.partitionBy("group_id")).alias("top"))
    return s.select("id", "group_id", F.col("n").cast("long").alias("n"), (F.floor((F.col("n") - 1) / 4) + 1).alias("block"), (F.coalesce("top", F.lit(0).cast("long")) + 10 * F.col("n")).alias("next_key"))


@query("SELECT skill_id, min((sort_order, id)).sort_order AS sort_order, arg_min(id, (sort_order, id)) AS id FROM (SELECT skill_id, sort_order, id FROM indicator) GROUP BY skill_id".replace("min((sort_order, id)).sort_order", "min(sort_order)"))
def first_position(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "indicator").groupBy("skill_id").agg(F.min(F.struct("sort_order", "id")).alias("f"))
    return i.select("skill_id", "f.sort_order", "f.id")


@query("""
SELECT id, r AS touch, least(40, block_no // 10 + CAST(2 * (r - 1) + (r - 1) * (r - 2) AS INTEGER)) AS project FROM (SELECT DISTINCT id, block_no FROM source_block), range(1, 4) t(r)""")
def expanding_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Three touches of each block at gaps of 2, 4, ... behind its position, none behind project 40."""
    b = table(spark, d, "source_block").select("id", "block_no").distinct().withColumn("touch", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))
    k = F.col("touch") - 1
    return b.select("id", "touch", F.least(F.lit(40), F.expr("int(block_no div 10)") + (2 * k + k * (k - 1)).cast("int")).alias("project"))
