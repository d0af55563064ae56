"""All steps of the command line on the fixture, written as TSV."""

from pyspark.sql import functions as F

from matchloom.plans.cli import SOURCES, SPLITS, Run
from matchloom.plans.fixture import table

SF = "/root/testdata/sf0.001"


def test_prep_block_train_tune_predict(spark, tmp_path):
    for split in SPLITS:
        (tmp_path / split).mkdir()
        for source, name in zip(SOURCES, ("biz_s1", "biz_s2", "biz_s3")):
            table(spark, SF, name).toPandas().to_csv(tmp_path / split / f"{split}_{source}.tsv", sep="\t", index=False, quoting=3)
    table(spark, SF, "biz_truth").toPandas().to_csv(tmp_path / "train" / "train_truth.tsv", sep="\t", index=False)
    run = Run(spark, str(tmp_path), str(tmp_path / "work"), str(tmp_path / "out"))
    run.prep()
    run.train(rounds=2, depth=2)
    rule = run.tune()
    assert 0 <= rule["holdout_f05"] <= 1
    checks = {r.rule: r.violations for r in run.predict().collect()}
    assert set(checks.values()) == {0}
    matches = spark.read.options(sep="\t", header=True).csv(str(tmp_path / "out" / "matches"))
    assert matches.count() == 150 and matches.where(F.col("matched_entity_ids").isNotNull()).count() > 20
