"""Sparse n-gram vectors as long tables (id, gram, w), and dense vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.normalize import squash, tokens


def char_grams(text: Column, low: int, high: int) -> Column:
    """All character n-grams of the text, low <= n <= high, with repeats."""
    def of(n: Column) -> Column:
        last = F.length(text) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i + 1, n))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(*[F.lit(n) for n in range(low, high + 1)]), of))


def word_grams(text: Column, low: int, high: int) -> Column:
    """Character n-grams within words, a blank on either side of each word; a padded word too short counts as one gram."""
    padded = F.transform(tokens(text), lambda t: F.concat(F.lit(" "), t, F.lit(" ")))
    def of(word: Column) -> Column:
        return F.filter(F.flatten(F.transform(F.array(*[F.lit(n) for n in range(low, high + 1)]), lambda n: F.when(F.length(word) > n, F.transform(F.sequence(F.lit(0), F.length(word) - n), lambda i: F.substring(word, i + 1, n))).when((n == low) | (F.length(word) == n), F.array(word)).otherwise(F.array().cast("array<string>")))), lambda g: g != "")

    return F.flatten(F.transform(padded, of))


def term_counts(df: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """(keep..., gram, n)."""
    return df.select(*keep, F.explode(terms).alias("gram")).groupBy(*keep, "gram").agg(F.count("*").alias("n"))


def unit_length(weights: DataFrame, *keep: str) -> DataFrame:
    """Weights divided by the vector's length."""
    norm = weights.groupBy(*keep).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norm, list(keep)).where("norm > 0").select(*keep, "gram", (F.col("w") / F.col("norm")).alias("w"))


def tf_vectors(df: DataFrame, terms: Column, *keep: str) -> DataFrame:
    return unit_length(term_counts(df, terms, *keep).withColumn("w", F.col("n").cast("double")), *keep)


def hashed(vectors: DataFrame, buckets: int, *keep: str) -> DataFrame:
    """Grams as hash buckets, without signs."""
    return vectors.groupBy(*keep, F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("gram")).agg(F.sum("w").alias("w"))


def record_bags(df: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Name and address bags: n-grams of the squashed text plus words of the plain text, each of unit length, added."""
    out = []
    for field, low, high in (("name_n", 2, 4), ("addr_n", 3, 4)):
        grams = tf_vectors(df, word_grams(squash(field), low, high), *keep)
        words = tf_vectors(df, tokens(field), *keep)
        out.append(grams.unionByName(words).groupBy(*keep, "gram").agg(F.sum("w").alias("w")))
    return out[0], out[1]


def idf(target_counts: DataFrame, n_targets: DataFrame, *group: str) -> DataFrame:
    """(group..., gram, idf) with smooth inverse document frequency, fitted on the targets."""
    df = target_counts.groupBy(*group, "gram").agg(F.count("*").alias("df"))
    total = n_targets.groupBy(*group).agg(F.count("*").alias("docs")) if group else n_targets.agg(F.count("*").alias("docs"))
    joined = df.join(F.broadcast(total), list(group)) if group else df.join(F.broadcast(total))
    return joined.select(*group, "gram", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def text_idf(targets: DataFrame, text: str, terms, group: str) -> DataFrame:
    """``idf`` of the targets' texts; the terms of a text that many targets have are made once."""
    texts = targets.groupBy(group, text).agg(F.count("*").alias("records"))
    df = texts.select(group, "records", F.explode(F.array_distinct(terms(F.col(text)))).alias("gram")).groupBy(group, "gram").agg(F.sum("records").alias("df"))
    total = texts.groupBy(group).agg(F.sum("records").alias("docs"))
    return df.join(F.broadcast(total), group).select(group, "gram", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_vectors(counts: DataFrame, weights: DataFrame, group: list[str], *keep: str) -> DataFrame:
    """TF-IDF vectors of unit length; terms that no target has are dropped."""
    w = counts.join(weights, [*group, "gram"]).withColumn("w", F.col("n") * F.col("idf"))
    return unit_length(w, *keep)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def combined_cosine(name_cos: Column, addr_cos: Column, weight: float, addr_1: Column, addr_2: Column) -> Column:
    """Cosine of [name, weight * address] vectors from the fields' cosines; an empty address is a zero vector."""
    length = lambda some: F.sqrt(1 + F.when(some, F.lit(weight * weight)).otherwise(0.0))
    return (name_cos + weight * weight * F.coalesce(addr_cos, F.lit(0.0))) / (length(addr_1) * length(addr_2))


def projection(df: DataFrame, vector: str, k: int) -> DataFrame:
    """``df`` with ``reduced``: centred, projected on the k first components, unit length."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = df.withColumn("__v", array_to_vector(F.col(vector)))
    vectors = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(vectors).transform(vectors)
    reduced = PCA(k=k, inputCol="__c", outputCol="__p").fit(vectors).transform(vectors)
    array = vector_to_array("__p")
    length = F.sqrt(dot(array, array))
    return reduced.withColumn("reduced", F.transform(array, lambda x: x / length)).drop("__v", "__c", "__p")
