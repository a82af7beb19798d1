"""Mutations as transforms from a snapshot to the next one; write the result to a new folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("keep_old", "take_new", "coalesce_old", "coalesce_new")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], rules: dict[str, str], default: str = "take_new") -> DataFrame:
    """Target rows updated by source rows of the same key, and the other source rows added.

    A column's rule says which side counts where both have the key: ``keep_old``, ``take_new``, or
    the first that is not null in either order. Columns the source lacks keep their value, and are
    null in added rows. Keys with a null never meet, as in a UNIQUE constraint. The source must be
    unique by key.
    """
    for r in rules.values():
        if r not in RULES:
            raise ValueError(f"unknown rule: {r}")
    values = [c for c in target.columns if c not in keys]
    o = target.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[F.col(c).alias(f"o_{c}") for c in values], F.lit(True).alias("o_there"))
    n = source.select(*[F.col(k).alias(f"n_{k}") for k in keys], *[F.col(c).alias(f"n_{c}") for c in values if c in source.columns], F.lit(True).alias("n_there"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    j = o.join(n, cond, "full_outer")

    def value(c: str) -> Column:
        if c not in source.columns:
            return F.col(f"o_{c}")
        old, new, rule = F.col(f"o_{c}"), F.col(f"n_{c}"), rules.get(c, default)
        both = {"keep_old": old, "take_new": new, "coalesce_old": F.coalesce(old, new), "coalesce_new": F.coalesce(new, old)}[rule]
        return F.when(F.col("o_there") & F.col("n_there"), both).when(F.col("o_there"), old).otherwise(new)

    key = lambda k: F.when(F.col("o_there"), F.col(f"o_{k}")).otherwise(F.col(f"n_{k}")).alias(k)
    return j.select(*[key(c) if c in keys else value(c).alias(c) for c in target.columns])


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows and those source rows whose key is new, one per key; keys with a null are always new."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    fresh = source.where(~null_key).dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True).unionByName(source.where(null_key), allowMissingColumns=True)


def soft_delete(df: DataFrame, gone: DataFrame, key: str, flag: str = "is_active", children: DataFrame | None = None) -> DataFrame:
    """Rows named in ``gone`` (key): archived if they have children (key), else removed."""
    marked = df.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    if children is not None:
        marked = marked.join(children.select(key).distinct().withColumn("_child", F.lit(True)), key, "left")
    else:
        marked = marked.withColumn("_child", F.lit(True))
    kept = marked.where("_gone is null or _child is not null")
    return kept.withColumn(flag, F.when(F.col("_gone"), F.lit(0).cast(df.schema[flag].dataType)).otherwise(F.col(flag))).select(*df.columns)


def merge_rekey(df: DataFrame, mapping: DataFrame, key: str, unique: list[str], flag: str = "is_active", order: str = "id") -> DataFrame:
    """Rows re-pointed by ``mapping`` (old, new); of rows then alike in ``unique`` all but the first by ``order`` are archived."""
    m = mapping.select(F.col("old").alias(key), F.col("new").alias("_new"))
    moved = df.join(m, key, "left").withColumn(key, F.coalesce("_new", key)).drop("_new")
    first = moved.groupBy(*unique).agg(F.min(order).alias("_first"))
    cond = F.lit(True)
    for c in unique:
        cond = cond & F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}"))
    j = moved.alias("m").join(first.alias("f"), cond).select("m.*", "_first")
    return j.withColumn(flag, F.when(F.col(order) == F.col("_first"), F.col(flag)).otherwise(F.lit(0).cast(df.schema[flag].dataType))).select(*df.columns)


def replace_slice(target: DataFrame, slice_: Column, rows: DataFrame) -> DataFrame:
    """The target without the rows of a predicate, and the given rows in their place."""
    return target.where(~F.coalesce(slice_, F.lit(False))).unionByName(rows, allowMissingColumns=True)


def changed(df: DataFrame, column: str, new: Column) -> DataFrame:
    """Only the rows whose column a rewrite changes, with the old and the new value."""
    return df.withColumn("new_value", new).where(~F.col("new_value").eqNullSafe(F.col(column)))


def align(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of another table in its order and types; missing ones are null, further ones dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def constraint_faults(df: DataFrame, unique: list[list[str]] = (), domains: dict[str, list[str]] | None = None, not_null: list[str] = ()) -> DataFrame:
    """(rule, value, records) of broken UNIQUE, CHECK and NOT NULL rules; keys with a null break no UNIQUE."""
    out = df.sparkSession.createDataFrame([], "rule string, value string, records bigint")
    for cols in unique:
        whole = df
        for c in cols:
            whole = whole.where(F.col(c).isNotNull())
        out = out.union(whole.groupBy(*cols).agg(F.count("*").alias("records")).where("records > 1").select(F.lit("unique " + ",".join(cols)), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), "records"))
    for c, allowed in (domains or {}).items():
        out = out.union(df.where(F.col(c).isNotNull() & ~F.col(c).isin(allowed)).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("records")).select(F.lit(f"domain {c}"), "value", "records"))
    for c in not_null:
        out = out.union(df.where(F.col(c).isNull()).agg(F.count("*").alias("records")).where("records > 0").select(F.lit(f"not null {c}"), F.lit(None).cast("string"), "records"))
    return out
