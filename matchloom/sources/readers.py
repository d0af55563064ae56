"""Record sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.normalize import address, id_list, name

RECORD = StructType().add("entity_id", StringType()).add("business_name", StringType()).add("business_address", StringType()).add("country", StringType())
TRUTH = StructType().add("source1_entity_id", StringType()).add("matched_entity_ids", StringType())


def records_tsv(spark: SparkSession, path: str | list[str], quoted: bool = False, schema: StructType = RECORD) -> DataFrame:
    """Tab-separated records, all text, missing is empty; quotes are data unless ``quoted``."""
    options = {"sep": "\t", "header": True} | ({} if quoted else {"quote": ""})
    return spark.read.schema(schema).options(**options).csv(path).fillna("")


def many_files(spark: SparkSession, pattern: str, expected: int | None = None, schema: StructType = RECORD) -> DataFrame:
    """All files of a pattern; an error if their number is not the expected one."""
    df = records_tsv(spark, pattern, schema=schema)
    found = len(df.inputFiles())
    if expected is not None and found != expected:
        raise ValueError(f"expected {expected} files, found {found}")
    return df


def first_existing(spark: SparkSession, *paths: str) -> DataFrame:
    """The first data set of those that exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return spark.read.parquet(path)
    raise FileNotFoundError(paths)


def trimmed_column(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.trim(column).alias(column))


def prepare(records: DataFrame, *keep: str, key: str = "entity_id") -> DataFrame:
    """entity_id, country, further columns, name_n, addr_n."""
    return records.select(key, "country", *keep, name("business_name").alias("name_n"), address("business_address", "country").alias("addr_n"))


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``; an error where a key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"duplicate {keys}")
    return df


def country_sample(df: DataFrame, country: str, limit: int | None, order: str = "entity_id", check: bool = False) -> DataFrame:
    """The first ``limit`` records of a country, in id order; all if None.  With ``check`` an error where it has none."""
    found = df.where(F.col("country") == country)
    if check and found.isEmpty():
        raise ValueError(f"no records of {country}")
    return found if limit is None else found.orderBy(order).limit(limit)


def selected(df: DataFrame, ids: DataFrame, key: str = "entity_id", check: bool = False) -> DataFrame:
    """Records whose id is wanted; with ``check`` an error where one is not there."""
    if check and not ids.join(df, key, "left_anti").isEmpty():
        raise ValueError("ids without a record")
    return df.join(ids.select(key).distinct(), key, "left_semi")


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1, tgt), distinct."""
    return truth.select(F.col("source1_entity_id").alias("s1"), F.explode(id_list("matched_entity_ids")).alias("tgt")).distinct()


def truth_counts(truth: DataFrame) -> DataFrame:
    """(s1, n_true): listed matches, repeats included."""
    listed = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return truth.groupBy(F.col("source1_entity_id").alias("s1")).agg(F.sum(F.size(listed)).cast("long").alias("n_true"))


def orphans(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs whose target has no record."""
    return pairs.join(records.select(F.col("entity_id").alias("tgt")), "tgt", "left_anti").select("s1", "tgt")


def hash_sample(df: DataFrame, n: int, key: str = "entity_id", seed: int = 0) -> DataFrame:
    """A sample that every run repeats: the n smallest hashes of the id."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def distractor_pool(targets: DataFrame, pairs: DataFrame, per_source: int, check: bool = False) -> DataFrame:
    """All true targets and the first ``per_source`` others of each source.  With ``check`` an error where a true target has no record."""
    from pyspark.sql import Window

    if check and not orphans(pairs, targets).isEmpty():
        raise ValueError("true targets without a record")
    wanted = pairs.select(F.col("tgt").alias("entity_id")).distinct()
    others = targets.join(wanted, "entity_id", "left_anti").withColumn("__n", F.row_number().over(Window.partitionBy("source").orderBy("entity_id"))).where(F.col("__n") <= per_source).drop("__n")
    return targets.join(wanted, "entity_id", "left_semi").unionByName(others)
