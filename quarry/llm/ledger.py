"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

Each record's text becomes a canonical key (128 bits of hash of its sorted word strings). A ledger
is a folder that is kept between runs. It holds, per scope and key, how many records had it, the
smallest key of a record and when the first was loaded, in buckets by hash. A batch is
aggregated on its own, full-outer-joined against the buckets it touches, the counts are added, and
only those buckets are written anew, in a folder of the batch; a manifest says which folder holds
each bucket. The manifest is written last and names the batches that are in, so a batch that
failed half-way leaves the ledger as it was, and a batch that is given twice is counted once.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.text import canonical_key
from quarry.operators.skew import unique_join
from quarry.storage import materialize, scratch

#: A new ledger gets a bucket for so many lines of its first batch; the number is a power of two between the others.
LINES_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 16, 1 << 16
KEY = ["scope", "k1", "k2"]


def keyed(rows: DataFrame, scope: str, text: Column, key: Column, batch: Column, at: Column | None = None) -> DataFrame:
    """(scope, k1, k2, key, at, batch) of the rows whose text has words; a null text or key is no record."""
    c = rows.select(key.alias("key"), canonical_key(text).alias("canon"), (F.lit(None).cast("timestamp_ntz") if at is None else at.cast("timestamp_ntz")).alias("at"), batch.alias("batch")).where("canon != '' and key is not null")
    return c.select(F.lit(scope).alias("scope"), F.xxhash64("canon").alias("k1"), F.xxhash64(F.lit("k2"), "canon").alias("k2"), "key", "at", "batch")


def summarize(batch: DataFrame) -> DataFrame:
    """One line per canonical key of a batch: records, smallest key, earliest load; combined map-side, so hot keys cost one row a task."""
    return batch.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("key").alias("kept"), F.min("at").alias("since"))


def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Lines after a batch of lines: counts added, the smaller key and the earlier load retained."""
    new = batch.withColumnsRenamed({"n": "n_new", "kept": "kept_new", "since": "since_new"})
    both = old.join(new, ["bucket", *KEY], "full_outer")
    zero = F.lit(0).cast("long")
    return both.select(*KEY, (F.coalesce("n", zero) + F.coalesce("n_new", zero)).alias("n"), F.least("kept", "kept_new").alias("kept"), F.least("since", "since_new").alias("since"), "bucket")


class Ledger:
    """The ledger in a folder of the shared storage; an absent one is created by its first batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict:
        """{"batches": names, "buckets": number, "at": {bucket: folder}, "schema": JSON}; the newest one counts."""
        fs, p = self._fs("manifest")
        if not fs.exists(p):
            return {"batches": [], "buckets": 0, "at": {}, "schema": None}
        newest = max(str(f.getPath().getName()) for f in fs.listStatus(p) if str(f.getPath().getName()).startswith("m"))
        found = self._fs(f"manifest/{newest}")[0].open(self._fs(f"manifest/{newest}")[1])
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8"))
        finally:
            found.close()

    def _commit(self, manifest: dict) -> None:
        fs, p = self._fs(f"manifest/_new-{len(manifest['batches'])}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(p, self._fs(f"manifest/m{len(manifest['batches']):09}")[1]):
            raise RuntimeError("another run has added a batch meanwhile; nothing was changed")

    def lines(self, buckets: list[int] | None = None) -> DataFrame | None:
        """All lines, or those of some buckets; None before the first batch."""
        m = self.manifest()
        if m["schema"] is None:
            return None
        schema, by_folder = StructType.fromJson(m["schema"]), defaultdict(list)
        for b, v in m["at"].items():
            if buckets is None or int(b) in buckets:
                by_folder[v].append(int(b))
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{v}").where(F.col("bucket").isin(sorted(found))) for v, found in sorted(by_folder.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def add(self, name: str, keyed_rows: DataFrame) -> bool:
        """Add a batch of keyed rows; False if a batch of that name is in already. Only the buckets it touches are rewritten."""
        m = self.manifest()
        if name in m["batches"]:
            return False
        new = materialize(summarize(keyed_rows), "lines")
        sizes = new.groupBy(F.pmod("k1", F.lit(MOST_BUCKETS)).alias("b")).count().collect()  # MOST_BUCKETS numbers at most
        n = m["buckets"] or min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << math.ceil(math.log2(sum(r["count"] for r in sizes) / LINES_A_BUCKET + 1))))
        touched = sorted({r["b"] % n for r in sizes})
        new = new.withColumn("bucket", F.pmod("k1", F.lit(n)).cast("int"))
        folder = f"b{len(m['batches']):09}"
        if touched:
            old = self.lines(touched)
            out = new if old is None else merge(old, new)
            out.repartition("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        schema = m["schema"] or json.loads(new.select(*KEY, "n", "kept", "since", "bucket").schema.json())
        self._commit({"batches": [*m["batches"], name], "buckets": n, "at": {**m["at"], **dict.fromkeys(map(str, touched), folder)}, "schema": schema})
        return True


def copies(keyed_rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(scope, kept, key) for every key other than the kept one of its content, each once."""
    several = lines.where("n > 1").select(*KEY, "kept")
    return unique_join(keyed_rows.select(*KEY, "key"), several, KEY).where("key != kept").select("scope", "kept", "key").distinct()


def halves(rows: DataFrame, at: str = "loaded_at") -> Column:
    """Batch 0 or 1 by the middle of the load times, as an earlier and a later delivery."""
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    return F.when(F.col(at) > F.lit(lo + (hi - lo) / 2), 1).otherwise(0) if lo is not None else F.lit(0)


def fold(parts: list[DataFrame], batches: int = 2) -> tuple[DataFrame, Ledger]:
    """Written keyed rows of one key type, a folder per batch, and a new ledger of all of them."""
    rows = materialize(reduce(DataFrame.unionByName, parts), "keyed", ("batch",))
    ledger = Ledger(rows.sparkSession, scratch(rows.sparkSession, "ledger"))
    for b in range(batches):
        ledger.add(f"batch-{b}", rows.where(F.col("batch") == b))
    return rows, ledger
