"""References to records that do not exist, were deleted or arrived later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mask(cols: list[str]) -> Column:
    """Bit i is set where column i is null."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(cols)])


def _by_mask(refs: DataFrame, cols: list[str], match: str) -> list[tuple[int, list[int]]]:
    """(mask, indexes of its non-null columns) of the masks that have to be looked up."""
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    k = len(cols)
    masks = range((1 << k) - 1) if match == "partial" else [0]
    return [(m, [i for i in range(k) if not m >> i & 1]) for m in masks]


def orphan_references(refs: DataFrame, ref_cols: list[str], targets: DataFrame, target_cols: list[str], match: str = "simple") -> DataFrame:
    """Rows of ``refs`` whose (composite) key is not in ``targets``, with their ``null_mask``.

    References are grouped by which key columns are null; each group is anti-joined on its
    non-null columns only. ``match`` follows the SQL standard: ``simple`` ignores any row with a
    null key column; ``partial`` requires the non-null columns to occur together in a target;
    ``full`` ignores rows with only nulls and reports rows with some. Rows whose key columns are
    all null are never orphans. Repeated rows stay repeated; an empty target makes every reference
    an orphan; extra and equally named columns of ``targets`` are not read.
    """
    masked = refs.withColumn("null_mask", _mask(ref_cols))
    found = []
    for mask, at in _by_mask(refs, ref_cols, match):
        keys = targets.select(*[F.col(target_cols[i]).alias(f"_key{i}") for i in at]).distinct()
        cond = reduce(lambda a, b: a & b, [F.col(ref_cols[i]) == F.col(f"_key{i}") for i in at])
        found.append(masked.where(F.col("null_mask") == mask).join(keys, cond, "left_anti"))
    if match == "full":
        every = (1 << len(ref_cols)) - 1
        found.append(masked.where((F.col("null_mask") > 0) & (F.col("null_mask") < every)))
    return reduce(DataFrame.unionByName, found)


def reference_faults(refs: DataFrame, ref_cols: list[str], targets: DataFrame, target_cols: list[str], *, loaded_at: str = "loaded_at", target_loaded_at: str = "loaded_at", deleted: Column | None = None, match: str = "simple") -> DataFrame:
    """``refs`` with a ``reason``: ``missing``, else ``deleted``, else ``late``; sound rows are left out.

    Targets are reduced to one row per key first: a key counts as deleted when all its rows are,
    and as loaded when its first row was. A null load time on either side is never late. Under
    ``partial`` semantics only ``missing`` is decided, as a partial key names no single target.
    """
    missing = orphan_references(refs, ref_cols, targets, target_cols, match).drop("null_mask").withColumn("reason", F.lit("missing"))
    if match == "partial":
        return missing
    names = [f"_key{i}" for i in range(len(target_cols))]
    one = (
        targets.select(*[F.col(c).alias(n) for c, n in zip(target_cols, names, strict=True)], (deleted if deleted is not None else F.lit(False)).alias("_gone"), F.col(target_loaded_at).alias("_there"))
        .groupBy(*names)
        .agg(F.min(F.coalesce("_gone", F.lit(False))).alias("_gone"), F.min("_there").alias("_there"))
    )
    late = F.col("_there") > F.col(loaded_at)
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(n) for c, n in zip(ref_cols, names, strict=True)])
    present = refs.join(one, cond).where(F.col("_gone") | late).withColumn("reason", F.when(F.col("_gone"), "deleted").otherwise("late")).drop(*names, "_gone", "_there")
    return missing.unionByName(present)
