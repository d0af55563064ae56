"""The matcher: gradient-boosted trees on pair features.

Spark's trees have no branch for missing values: a missing feature becomes the
column's sentinel and a flag of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

MISSING = -9.0


def complete(rows: DataFrame, features: list[str], flagged: tuple[str, ...] = ("t_top2", "owner_gap", "addr_nn_cos", "name_cos", "addr_cos")) -> tuple[DataFrame, list[str]]:
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in features if c in flagged}
    return rows.withColumns(flags).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features}), [*features, *flags]


def train(rows: DataFrame, features: list[str], rounds: int = 20, depth: int = 4, step: float = 0.1, balance: bool = False, held: str | None = None, counted: str | None = None) -> PipelineModel:
    """Fits on (features..., y); ``balance`` weighs positives by negatives over positives; ``held`` marks rows that stop training early.

    ``counted`` names the column that says how many pairs a row stands for.
    """
    data, names = complete(rows, features)
    data = data.withColumn("label", F.col("y").cast("double"))
    options: dict = {"maxIter": rounds, "maxDepth": depth, "stepSize": step, "seed": 0}
    each = F.col(counted).cast("double") if counted else F.lit(1.0)
    if balance:
        n = data.agg(F.sum(F.col("label") * each).alias("pos"), F.sum(each).alias("n")).first()
        each = each * F.when(F.col("label") == 1, F.lit((n["n"] - n["pos"]) / max(1.0, n["pos"]))).otherwise(1.0)
    if balance or counted:
        data = data.withColumn("weight", each)
        options["weightCol"] = "weight"
    if held:
        options["validationIndicatorCol"] = held
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    return Pipeline(stages=[assembler, GBTClassifier(**options)]).fit(data)


def floors(counts: DataFrame, features: list[str], most: int = 32) -> dict[str, np.ndarray]:
    """Lower ends of the bins of features with more than ``most`` values, as many pairs in each as can be; from the exact counts ``n`` of all pairs."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]))
    table = counts.select(each.alias("x"), "n").groupBy("x.feature", "x.value").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for feature, rows in table.groupby("feature"):
        rows = rows.sort_values("value")
        if len(rows) > most:
            below = (np.cumsum(rows["n"]) - rows["n"]).to_numpy()
            bins = (below * most // rows["n"].sum()).astype(np.int64)
            out[feature] = rows["value"].to_numpy()[np.unique(bins, return_index=True)[1]]
    return out


def in_bins(counts: DataFrame, features: list[str], lower: dict[str, np.ndarray]) -> DataFrame:
    """``counts`` (features..., y, n) with features as the lower ends of their bins: what trees of that many bins tell apart."""
    from .features import binned

    def of(batches):
        for b in batches:
            new = binned({c: b[c].to_numpy() for c in lower}, lower)
            yield pa.RecordBatch.from_arrays([pa.array(new[c]) if c in new else b[c] for c in b.schema.names], names=b.schema.names)

    return counts.mapInArrow(of, counts.schema).groupBy(*features, "y").agg(F.sum("n").alias("n"))


def predict(model: PipelineModel, rows: DataFrame, features: list[str], keep: tuple[str, ...] = ("s1", "tgt")) -> DataFrame:
    """``rows`` with ``p``."""
    data, _ = complete(rows, features)
    scored = model.transform(data).withColumn("p", vector_to_array("probability")[1])
    return scored.select(*keep, "p")


def importance(model: PipelineModel, spark) -> DataFrame:
    """(feature, weight), largest first."""
    names = model.stages[0].getInputCols()
    values = model.stages[1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, weight double").orderBy(F.col("weight").desc(), "feature")
