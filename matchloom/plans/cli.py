"""Command line: ``python -m matchloom.plans.cli STEP [SPLIT]``.

Steps: ``prep`` (TSV to normalised tables), ``block SPLIT`` (candidates), ``train``
(matcher and holdout scores), ``tune`` (decision rule), ``predict`` (match lists of the
test split).  Folders: MATCHLOOM_DATA (``SPLIT/SPLIT_sourceN.tsv``,
``train/train_truth.tsv``), MATCHLOOM_WORK, MATCHLOOM_OUT.  A step's tables are kept
and used again; delete them to run it anew.
"""

from __future__ import annotations

import json
import os
import sys

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from ..functions import normalize as nz
from ..operators import blocking as bl, decide as dc, evaluate as ev, features as ft, labels as lb, learn
from ..sources import readers as rd, sinks as sk

SPLITS, SOURCES = ("train", "test"), ("source1", "source2", "source3")


class Run:
    def __init__(self, spark: SparkSession, data: str, work: str, out: str):
        self.spark, self.data, self.work, self.out = spark, data, work, out

    def raw(self, split: str, source: str) -> DataFrame:
        return rd.records_tsv(self.spark, f"{self.data}/{split}/{split}_{source}.tsv")

    def side(self, split: str, s1: bool) -> DataFrame:
        if s1:
            return self.spark.read.parquet(f"{self.work}/prep/{split}_source1")
        a, b = (self.spark.read.parquet(f"{self.work}/prep/{split}_{s}").withColumn("source", F.lit(k)) for k, s in enumerate(SOURCES[1:]))
        return a.unionByName(b)

    def truth(self) -> DataFrame:
        return rd.records_tsv(self.spark, f"{self.data}/train/train_truth.tsv", quoted=True, schema=rd.TRUTH)

    def prep(self) -> None:
        for split in SPLITS:
            for source in SOURCES:
                sk.stage(rd.prepare(rd.assert_unique(self.raw(split, source), "entity_id")), f"{self.work}/prep/{split}_{source}")

    def block(self, split: str, weight: float = 1.0) -> DataFrame:
        """Both directions on the combined score, and the address channel."""
        found = sk.stage(bl.nearest_by_field(self.side(split, True), self.side(split, False), weight), f"{self.work}/nearest/{split}")
        return sk.stage(bl.three_channels(found), f"{self.work}/candidates/{split}")

    def features(self, split: str, pairs: DataFrame) -> DataFrame:
        return ft.full_set(pairs, self.side(split, True), self.side(split, False))

    def train(self, rounds: int = 20, depth: int = 5) -> DataFrame:
        kept = bl.keep(self.block("train"))
        part = nz.bucket("s1")
        queries = self.side("train", True).select(F.col("entity_id").alias("s1")).where(part == 9)
        known = rd.truth_pairs(self.truth())
        rows = sk.stage(lb.label(self.features("train", kept.where(part.between(6, 8))), known), f"{self.work}/features/train")
        names = [c for c in rows.columns if c not in ("s1", "tgt", "y")]
        held = F.pmod(F.crc32(F.concat(F.lit("stop:"), F.col("s1")).cast("binary")), F.lit(10)) == 0
        model = learn.train(rows.withColumn("held", held), names, rounds, depth, held="held")
        model.write().overwrite().save(f"{self.work}/model")
        rivals = sk.stage(self.features("train", lb.competitors(kept, queries)), f"{self.work}/features/holdout")
        return sk.stage(learn.predict(model, rivals, names), f"{self.work}/holdout")

    def tune(self) -> dict:
        """The first of the best rules on the holdout; written beside the model."""
        scored = self.spark.read.parquet(f"{self.work}/holdout")
        queries = self.side("train", True).select(F.col("entity_id").alias("s1")).where(nz.bucket("s1") == 9)
        grid = ev.rule_grid(scored, queries, rd.truth_counts(self.truth()), rd.truth_pairs(self.truth())).orderBy(F.desc("f05"), "rule")
        best = grid.first()
        rule = {"rule": dc.RULES[best["rule"]], "holdout_f05": best["f05"]}
        sk.settings(grid, f"{self.work}/rule", rule)
        return rule

    def predict(self) -> DataFrame:
        rule = json.loads(self.spark.read.text(f"{self.work}/rule").first()[0])["rule"]
        model = PipelineModel.load(f"{self.work}/model")
        kept = bl.keep(self.block("test"))
        rows = self.features("test", kept)
        scored = sk.stage(learn.predict(model, rows, [c for c in rows.columns if c not in ("s1", "tgt")]), f"{self.work}/test_scores")
        found = dc.decide(scored, rule)
        s1 = self.side("test", True)
        lists = {"matches": (found, "matched_entity_ids"), "candidates": (scored, "candidate_entity_ids")}
        variants = sk.unseen_variants(found, s1, self.side("train", True))
        lists |= {f"matches_{v}": (variants.where(F.col("variant") == v), "matched_entity_ids") for v in ("strict", "empty")}
        for name, (pairs, column) in lists.items():
            sk.id_lists(s1, pairs, column).write.mode("overwrite").options(sep="\t", header=True, emptyValue="").csv(f"{self.out}/{name}")
        written = [rd.records_tsv(self.spark, f"{self.out}/{name}", schema=StructType().add("s1", StringType()).add("ids", StringType())) for name in ("matches", "candidates")]
        return sk.validate_lists(s1, self.side("test", False), *written)


def main(arguments: list[str]) -> None:
    data, work, out = (os.environ.get(f"MATCHLOOM_{x}", x.lower()) for x in ("DATA", "WORK", "OUT"))
    run = Run(SparkSession.builder.appName("matchloom").getOrCreate(), data, work, out)
    step, *rest = arguments or ["help"]
    if step == "prep":
        run.prep()
    elif step == "block":
        run.block(rest[0] if rest else "train")
    elif step == "train":
        run.train()
        print(run.tune())
    elif step == "tune":
        print(run.tune())
    elif step == "predict":
        run.predict().show()
    else:
        print(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
