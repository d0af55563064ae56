"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept; its result is written as Parquet and read again.  All but the last return
the columns of ``documents``.

1. quality rules: documents that the repetition rules reject go;
2. line dedup: lines that a document with a smaller id has go, ``n_chars`` follows;
3. Jaccard join: of each group of near copies the document with the smallest id stays;
4. decontamination: documents with a benchmark passage go;
5. packing: one row for each piece of a training sequence.

Null texts are rejected by the first stage.  Rows with a null id pass stage 2
unchanged and stay in stage 3.  Of rows with the same id and text, stage 3
leaves the first by its other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from matchloom.llm import concat_cut, line_cuckoo, partenum, repetition, wu_manber
from matchloom.llm.storage import materialise

WINDOW = 4096
END_ID = 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = repetition.repetition_quality(docs.withColumns({"__ml_row": F.struct(*docs.columns)}).select("__ml_row", "text"))
    return judged.where("kept").select("__ml_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_cuckoo.drop_repeated_lines(docs)
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = partenum.similar_components(docs)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__ml_first")).distinct()
    named = (_once(docs) if _repeated_ids(docs) else docs).join(first.hint("shuffle_hash"), F.col("doc_id") == F.col("__ml_first"), "left_semi")
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def _once(docs: DataFrame) -> DataFrame:
    """Of the rows that share id and text, the first by its other columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("doc_id", F.xxhash64("text"), F.length("text")).orderBy(*(others or ["doc_id"]))
    return docs.withColumn("__ml_nth", F.row_number().over(order)).where("__ml_nth = 1").drop("__ml_nth")


def _repeated_ids(docs: DataFrame) -> bool:
    ids = docs.where("doc_id is not null").groupBy("doc_id").count()
    return not ids.where("count > 1").isEmpty()


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = wu_manber.find_contamination(docs.select(F.struct(*docs.columns).alias("__ml_row"), "text"), benchmark)
    return found.where(F.size("hits") == 0).select("__ml_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return concat_cut.pack(docs, public_tokenizers.path("word_bpe_49k.json"), mode="word", window=WINDOW, end_id=END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokenisation is beyond SQL; tests compare the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
