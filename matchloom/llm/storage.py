"""Shared scratch space for intermediate tables.

Intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir``, which every executor sees.  Only where that setting is
missing and the master is local (tests) a temporary folder is used.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Input of one shuffle partition, where the session's number of partitions would give more.
PART_BYTES = 128 << 20
#: Sizes from here on are the optimiser's way to say that it does not know.
UNKNOWN_BYTES = 1 << 56

_fallback: str | None = None
_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, from the session's own setting."""
    global _fallback
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="matchloom-")
    return "file://" + _fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/matchloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._matchloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete intermediate tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_matchloom_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Ask the driver to drop unreferenced shuffle files now, not at its next garbage collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_parts(spark: SparkSession, source: DataFrame | None = None) -> int:
    """Partitions of a shuffle: the session's number, or more where the source's files are large."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if source is None:
        return n
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, size // PART_BYTES) if size < UNKNOWN_BYTES else n


def bucket_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers that ``repartition(n, column)`` deals to n different partitions."""
    from pyspark.sql import functions as F

    rows = spark.range(40 * n).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("part"))
    found = {r["part"]: r["key"] for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect()}
    return [found.get(p, p) for p in range(n)]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            pass
    if _fallback and os.path.isdir(_fallback):
        import shutil

        shutil.rmtree(_fallback, ignore_errors=True)
