"""Sinks: stage tables, match lists, models' settings."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def stage(df: DataFrame, path: str, resume: bool = True) -> DataFrame:
    """Writes a stage's table unless a whole one is there, and reads it.

    A table is whole once its committer has left ``_SUCCESS``; what a job that died has
    left is written over.
    """
    done = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not (resume and done.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(done)):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """The table written to the folder that ``spark.checkpoint.dir`` names and read back: its plan ends here.

    It is deleted when the driver ends.  Without that setting (tests) a folder of the
    machine does, if the master is local.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="matchloom-records-")
    path = f"{root.rstrip('/')}/matchloom-records/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        pass


def append_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("append").options(sep="\t", header=True, emptyValue="").csv(path)


def id_lists(s1: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """Every S1 id with its targets, ascending and comma-joined; empty where it has none."""
    listed = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("tgt")), ",").alias(column))
    return s1.select(F.col("entity_id").alias("s1")).join(listed, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def unseen_variants(pred: DataFrame, s1: DataFrame, trained: DataFrame, strict: float = 0.9) -> DataFrame:
    """Predictions of two variants for countries that training did not have: ``strict`` asks for more, ``empty`` drops all."""
    known = trained.select("country").distinct().withColumn("seen", F.lit(True))
    rows = pred.join(s1.select(F.col("entity_id").alias("s1"), "country"), "s1").join(F.broadcast(known), "country", "left")
    rows = rows.withColumn("variant", F.explode(F.array(F.lit("strict"), F.lit("empty"))))
    return rows.where(F.col("seen") | ((F.col("variant") == "strict") & (F.col("p") >= strict))).select("variant", "s1", "tgt", "p")


def settings(df: DataFrame, path: str, values: dict) -> None:
    """A one-row JSON data set beside a model."""
    df.sparkSession.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").write.mode("overwrite").text(path)


def validate(s1: DataFrame, targets: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rule, violations): every S1 once, known ids only, matches among candidates, one owner for a target."""
    ids = s1.select(F.col("entity_id").alias("s1"))
    known = targets.select(F.col("entity_id").alias("tgt"))
    checks = {
        "s1_repeated": ids.groupBy("s1").count().where("count > 1"),
        "s1_unknown": matches.join(ids, "s1", "left_anti"),
        "target_unknown": matches.join(known, "tgt", "left_anti"),
        "not_a_candidate": matches.join(candidates.select("s1", "tgt"), ["s1", "tgt"], "left_anti"),
        "two_owners": matches.groupBy("tgt").agg(F.count_distinct("s1").alias("n")).where("n > 1"),
    }
    out = None
    for rule, bad in checks.items():
        row = bad.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def validate_lists(s1: DataFrame, targets: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rule, violations) of written lists (source1_entity_id, ids): both list every S1 once, and what they list holds."""
    rows = lambda lists: lists.toDF("s1", "ids").select("s1", F.explode(F.filter(F.split(F.coalesce("ids", F.lit("")), ","), lambda x: x != "")).alias("tgt"))
    out = validate(s1, targets, rows(matches), rows(candidates))
    for name, lists in (("matches", matches), ("candidates", candidates)):
        listed = s1.select(F.col("entity_id").alias("s1")).unionByName(lists.toDF("s1", "ids").select("s1").withColumn("listed", F.lit(1)), allowMissingColumns=True)
        wrong = listed.groupBy("s1").agg(F.count("listed").alias("n"), F.count("*").alias("rows")).where("n <> 1 or rows <> 2")
        out = out.unionByName(wrong.agg(F.count("*").alias("violations")).select(F.lit(f"{name}_not_once").alias("rule"), "violations"))
    return out
