"""Queries on intake data: triage, evidence, caches, promotion and ranked candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as X
from quarry.operators import similarity
from quarry.storage import materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT id, concat_ws(',', CASE WHEN confidence < 0.75 THEN 'low_confidence' END, CASE WHEN council_agreement < 0.67 THEN 'jury_split' END, CASE WHEN atomicity <> 'atomic' THEN 'not_atomic' END,
  CASE WHEN canonical_skill_id IS NULL THEN 'unmatched' END, CASE WHEN resolution = 'fuzzy' AND match_score < 98 THEN 'weak_match' END) AS reasons FROM skill_suggestion""")
def triage_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Ordered reason codes of each suggestion."""
    s = table(spark, d, "skill_suggestion")
    rules = [("low_confidence", F.col("confidence") < 0.75), ("jury_split", F.col("council_agreement") < 0.67), ("not_atomic", F.col("atomicity") != "atomic"), ("unmatched", F.col("canonical_skill_id").isNull()), ("weak_match", (F.col("resolution") == "fuzzy") & (F.col("match_score") < 98))]
    return s.select("id", F.concat_ws(",", *[F.when(c, r) for r, c in rules]).alias("reasons"))


#: The taxonomy's own order.
_ORDER = ["remember", "understand", "apply", "analyze", "evaluate", "create"]


@query("""
WITH i AS (SELECT id, unnest(json_extract_string(indicators_json, '$[*].bloom')) AS bloom FROM skill_suggestion WHERE json_valid(indicators_json))
SELECT id, max(bloom) AS bloom, max(list_position(['remember', 'understand', 'apply', 'analyze', 'evaluate', 'create'], bloom))::INT AS bloom_ordinal, count(*) AS indicators FROM i GROUP BY id""")
def indicator_levels(spark: SparkSession, d: str) -> DataFrame:
    """Highest level of each suggestion's indicators, as a label and as an ordinal, which differ."""
    i = F.from_json("indicators_json", "array<struct<text:string,bloom:string>>")
    s = table(spark, d, "skill_suggestion").select("id", F.transform(i, lambda x: x["bloom"]).alias("b")).where("size(b) > 0")
    rank = F.transform("b", lambda x: F.array_position(F.array(*map(F.lit, _ORDER)), x).cast("int"))
    return s.select("id", F.array_max("b").alias("bloom"), F.array_max(rank).alias("bloom_ordinal"), F.size("b").cast("long").alias("indicators"))


@query("""
WITH c AS (SELECT lower(u.claim) AS k, u.claim, u.source_type, loaded_at, cache_key FROM (SELECT loaded_at, cache_key, unnest(from_json(response_json, '[{"claim":"VARCHAR","source_type":"VARCHAR"}]')) AS u FROM evidence_query_cache WHERE json_valid(response_json)) WHERE u.claim IS NOT NULL)
SELECT k AS claim, arg_min(source_type, (loaded_at, cache_key, source_type)) AS source_type, count(*) AS mentions FROM c GROUP BY k""")
def distinct_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of all evidence without regard to case; the first mention's kind counts."""
    e = table(spark, d, "evidence_query_cache").where(F.try_parse_json("response_json").isNotNull())
    c = e.select("loaded_at", "cache_key", F.explode(F.from_json("response_json", "array<struct<claim:string,source_type:string>>")).alias("u")).where("u.claim is not null")
    return c.groupBy(F.lower("u.claim").alias("claim")).agg(F.min_by("u.source_type", F.struct("loaded_at", "cache_key", "u.source_type")).alias("source_type"), F.count("*").alias("mentions"))


@query("""
WITH b AS (SELECT id, 'программа курса ' || lower(domain) AS q FROM profile_brief WHERE domain IS NOT NULL), k AS (SELECT DISTINCT cache_key FROM evidence_query_cache UNION SELECT sha256('программа курса ' || lower(domain)) FROM profile_brief WHERE domain IS NOT NULL AND seniority = 'junior')
SELECT b.id, k.cache_key IS NOT NULL AS hit FROM b LEFT JOIN k ON k.cache_key = sha256(b.q)""")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Queries made for all briefs, looked up by hash among the cached ones and some stored before."""
    b = table(spark, d, "profile_brief").where("domain is not null").select("id", "seniority", F.sha2(F.concat(F.lit("программа курса "), F.lower("domain")), 256).alias("cache_key"))
    stored = table(spark, d, "evidence_query_cache").select("cache_key").union(b.where("seniority = 'junior'").select("cache_key")).distinct()
    return b.join(stored.withColumn("hit", F.lit(True)), "cache_key", "left").select("id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("""
SELECT skill_id, string_agg(alias, ' | ' ORDER BY CASE WHEN source = 'manual' THEN 0 ELSE 1 END, id) AS aliases FROM skill_alias GROUP BY skill_id""")
def nested_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of each skill, hand-made ones first."""
    a = table(spark, d, "skill_alias").groupBy("skill_id").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("source") == "manual", 0).otherwise(1).alias("r"), "id", "alias"))).alias("a"))
    return a.select("skill_id", F.array_join(F.transform("a", lambda x: x["alias"]), " | ").alias("aliases"))


@query("""
SELECT id, canonical_name FROM skill ORDER BY CASE WHEN contains(lower(canonical_name), 'контроль') THEN 0 ELSE 1 END, canonical_name, id LIMIT 1""")
def preferred_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "skill").orderBy(F.when(F.lower("canonical_name").contains("контроль"), 0).otherwise(1), "canonical_name", "id").limit(1).select("id", "canonical_name")


@query("""
WITH n AS (SELECT min(suggested_name) AS name, lower(suggested_name) AS k FROM skill_suggestion WHERE decision = 'accepted' AND atomicity = 'atomic' AND suggested_name IS NOT NULL AND canonical_skill_id IS NULL GROUP BY 2)
SELECT (SELECT max(id) FROM skill) + row_number() OVER (ORDER BY n.k) AS id, n.name FROM n WHERE NOT EXISTS (SELECT 1 FROM skill s WHERE lower(s.canonical_name) = n.k)""")
def promoted_skills(spark: SparkSession, d: str) -> DataFrame:
    """Accepted names that are new, with ids that follow the catalog's in the order of their keys.

    Numbers over the whole set are made without one task seeing all of it: rows are range-partitioned
    by key, counted by partition, and numbered within it.
    """
    s = table(spark, d, "skill_suggestion").where("decision = 'accepted' and atomicity = 'atomic' and suggested_name is not null and canonical_skill_id is null")
    new = s.groupBy(F.lower("suggested_name").alias("k")).agg(F.min("suggested_name").alias("name"))
    new = new.join(table(spark, d, "skill").select(F.lower("canonical_name").alias("k")), "k", "left_anti")
    return number_rows(new, ["k"]).crossJoin(F.broadcast(table(spark, d, "skill").agg(F.max("id").alias("top")))).select((F.col("top") + F.col("n")).alias("id"), "name")


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with n = 1, 2, ... in the given order, which must be unique; one count per partition goes through one task."""
    parts = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    ahead = parts.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", (F.sum("_c").over(W.orderBy("_p")) - F.col("_c")).alias("_before"))
    local = parts.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    return local.join(F.broadcast(ahead), "_p").withColumn("n", F.col("_before") + F.col("_n")).drop("_p", "_n", "_before")


@query("""
WITH t AS (SELECT id, list_distinct(string_split(lower(source_skill_name), ' ')) AS k FROM typed_competency_skill WHERE skill_id IS NULL AND source_skill_name IS NOT NULL), s AS (SELECT id, list_distinct(string_split(lower(canonical_name), ' ')) AS k FROM skill),
 p AS (SELECT t.id AS typed_id, s.id AS skill_id, len(list_intersect(t.k, s.k)) AS n, len(t.k) AS a, len(s.k) AS b FROM t, s WHERE len(list_intersect(t.k, s.k)) > 0),
 q AS (SELECT typed_id, skill_id, round(60.0 * n / (a + b - n) + 40.0 * n / least(a, b), 3) AS score FROM p)
SELECT * FROM (SELECT typed_id, skill_id, score, row_number() OVER (PARTITION BY typed_id ORDER BY score DESC, skill_id) AS place FROM q) WHERE place <= 5""")
def similar_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five skills nearest to each unresolved name among those that share a word with it."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    t = table(spark, d, "typed_competency_skill").where("skill_id is null and source_skill_name is not null").select(F.col("id").alias("typed_id"), words("source_skill_name").alias("tk"))
    s = table(spark, d, "skill").select(F.col("id").alias("skill_id"), words("canonical_name").alias("sk"))
    pairs = t.withColumn("w", F.explode("tk")).join(s.withColumn("w", F.explode("sk")), "w").drop("w").dropDuplicates(["typed_id", "skill_id"])
    score = F.round(60 * similarity.jaccard(F.col("tk"), F.col("sk")) + 40 * similarity.overlap(F.col("tk"), F.col("sk")), 3)
    place = F.row_number().over(W.partitionBy("typed_id").orderBy(F.desc("score"), "skill_id"))
    return pairs.select("typed_id", "skill_id", score.alias("score")).withColumn("place", place).where("place <= 5")


@query("""
WITH w AS (SELECT id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower(domain), 'ё', 'е'), '[^0-9a-zа-я+]+', ' ', 'g')), ' '), lambda x: length(x) >= 3))) AS w FROM profile_brief WHERE domain IS NOT NULL),
 m AS (SELECT DISTINCT brief_id AS id, unnest(list_filter(string_split(trim(regexp_replace(replace(lower(suggested_name), 'ё', 'е'), '[^0-9a-zа-я+]+', ' ', 'g')), ' '), lambda x: length(x) >= 3)) AS w FROM skill_suggestion WHERE brief_id IS NOT NULL AND suggested_name IS NOT NULL)
SELECT w.id, count(*) AS words, count(m.w) AS met, CASE WHEN count(m.w) = count(*) THEN 'covered' WHEN count(m.w) > 0 THEN 'partial' ELSE 'uncovered' END AS coverage FROM w LEFT JOIN m ON m.id = w.id AND m.w = w.w GROUP BY w.id""")
def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    """How far the words of a brief's domain occur in the names suggested for it."""
    w = table(spark, d, "profile_brief").where("domain is not null").select("id", F.explode(X.token_set(F.col("domain"))).alias("w"))
    m = table(spark, d, "skill_suggestion").where("brief_id is not null and suggested_name is not null").select(F.col("brief_id").alias("id"), F.explode(X.token_set(F.col("suggested_name"))).alias("w")).distinct()
    g = w.join(m.withColumn("hit", F.lit(1)), ["id", "w"], "left").groupBy("id").agg(F.count("*").alias("words"), F.count("hit").alias("met"))
    return g.withColumn("coverage", F.when(F.col("met") == F.col("words"), "covered").when(F.col("met") > 0, "partial").otherwise("uncovered"))


@query("""
WITH o AS (SELECT DISTINCT id, entity_id, reason_code, severity, status, loaded_at FROM review_queue WHERE status = 'open')
SELECT reason_code, count(*) AS open_reviews, count(*) FILTER (WHERE loaded_at < (SELECT max(loaded_at) FROM review_queue) - INTERVAL 90 DAY) AS stale, max(severity) AS severity FROM o GROUP BY reason_code""")
def stale_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Open reviews and those 90 days older than the newest row."""
    r = table(spark, d, "review_queue")
    o = r.where("status = 'open'").select("id", "entity_id", "reason_code", "severity", "loaded_at").distinct()
    edge = r.agg((F.max("loaded_at") - F.expr("INTERVAL 90 DAYS")).alias("edge"))
    return o.crossJoin(F.broadcast(edge)).groupBy("reason_code").agg(F.count("*").alias("open_reviews"), F.count_if(F.col("loaded_at") < F.col("edge")).alias("stale"), F.max("severity").alias("severity"))


@query("""
SELECT s.id, coalesce(o.status, 'none') AS override, CASE WHEN o.status = 'resolved' THEN 'accepted' WHEN o.status = 'ignored' THEN 'rejected' ELSE s.decision END AS decision FROM skill_suggestion s
LEFT JOIN (SELECT entity_id, arg_max(status, (loaded_at, id)) AS status FROM review_queue WHERE lower(trim(entity_type)) = 'competency' AND entity_id IS NOT NULL GROUP BY 1) o ON o.entity_id = s.id""")
def decision_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Decisions overridden by the latest review of the same number."""
    q = table(spark, d, "review_queue").where((F.lower(F.trim("entity_type")) == "competency") & F.col("entity_id").isNotNull())
    o = q.groupBy(F.col("entity_id").alias("id")).agg(F.max_by("status", F.struct("loaded_at", "id")).alias("o"))
    decision = F.when(F.col("o") == "resolved", "accepted").when(F.col("o") == "ignored", "rejected").otherwise(F.col("decision"))
    return table(spark, d, "skill_suggestion").join(o, "id", "left").select("id", F.coalesce("o", F.lit("none")).alias("override"), decision.alias("decision"))
