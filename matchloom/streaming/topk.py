"""Running top-k over a stream of scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.blocking import top_k


def running_top_k(scores: DataFrame, table: str, k: int, checkpoint: str):
    """A streaming query that keeps each S1's k best pairs in a Parquet data set.

    Every micro-batch merges its own k best with those kept so far and writes them
    as a new version ``table/v=<batch>``; ``latest`` reads the newest one.  State is at
    most k rows for each S1, and a batch that is run again writes the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        best = top_k(batch.select("s1", "tgt", "score"), k, descending_id=True).drop("rank")
        if number:
            best = best.unionByName(spark.read.parquet(f"{table}/v={number - 1}").select("s1", "tgt", "score"))
        again = best.groupBy("s1", "tgt").agg(F.max("score").alias("score"))
        top_k(again, k, descending_id=True).write.mode("overwrite").parquet(f"{table}/v={number}")

    return scores.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def latest(spark, table: str, batch: int) -> DataFrame:
    return spark.read.parquet(f"{table}/v={batch}")
