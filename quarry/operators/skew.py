"""Joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in HOT_SLOTS, so there are fewer hot keys than HOT_SLOTS.
HOT_SLOTS = 1024


def hot_keys(left: DataFrame, on: list[str], slots: int = HOT_SLOTS) -> DataFrame:
    """Distinct keys holding more than 1/slots of the rows: by counting, fewer than ``slots`` rows."""
    counts = left.groupBy(*on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("_n") * slots > F.col("_total")).select(*on)


def unique_join(left: DataFrame, right: DataFrame, on: list[str], slots: int = HOT_SLOTS, how: str = "inner") -> DataFrame:
    """Inner or left join with a ``right`` unique on ``on``, whatever the distribution of ``left``.

    Rows of hot keys meet a broadcast of the matching right rows (fewer than ``slots`` of
    them); all other rows meet in a shuffle where no key exceeds 1/slots of the rows.
    Null keys match nothing and are not shuffled. Empty inputs give an empty result.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join: {how}")
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in on])
    some = left.where(whole)
    hot = hot_keys(some, on, slots).withColumn("_hot", F.lit(True))
    tagged = some.join(F.broadcast(hot), on, "left")
    hot_right = right.join(F.broadcast(hot.drop("_hot")), on, "left_semi")
    few = tagged.where("_hot").drop("_hot").join(F.broadcast(hot_right), on, how)
    out = few.unionByName(tagged.where("_hot is null").drop("_hot").join(right, on, how))
    return out if how == "inner" else out.unionByName(left.where(~whole), allowMissingColumns=True)


def balanced(df: DataFrame, *on: str, tasks_a_core: int = 3) -> DataFrame:
    """``df`` in a fixed number of parts by the hash of ``on``, for work that costs far more CPU than its bytes tell.

    Adaptive execution joins small parts by their bytes, but leaves a stated number of parts alone.
    """
    spark = df.sparkSession
    n = max(tasks_a_core * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *on)
