"""Table access and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one Parquet table; filters and columns are pushed into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    The setting is read from the session and then from the context. Where it is unset, one machine
    gets a folder of its own, and a cluster a folder in its warehouse, which all executors reach.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _own:
            local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
            _own[app] = tempfile.mkdtemp(prefix="quarry-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quarry-{app}"
        found = _own[app]
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for ``release`` to delete."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


#: Spark's setting that deletes an execution's shuffle files as soon as its output is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage durably: a lost executor re-reads files, it recomputes nothing. The shuffle
    files of the writing itself are deleted when it is done, so disk holds one step at a time.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` that nothing will read again, such as an earlier round's; others are left alone."""
    for t in tables:
        path = getattr(t, "__dict__", {}).get("written_path")
        if path in _written:
            _written.remove(path)
            _delete(t.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Delete the tables ``materialize`` has written in this process; call it once their readers are done."""
    done = 0
    while _written:
        done += _delete(spark, _written.pop())
    return done
