"""Operators on small frames, and whole paths on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from matchloom.operators import blocking as bl, decide as dc, evaluate as ev, labels as lb, vectors as vx
from matchloom.plans import queries as q
from matchloom.sources import readers as rd, sinks as sk
from matchloom.streaming.topk import latest, running_top_k

SF = "/root/testdata/sf0.001"


def pairs(spark, rows):
    return spark.createDataFrame(rows, "s1 string, tgt string, p double")


def test_one_owner_and_expected(spark):
    scored = pairs(spark, [("a", "x", 0.9), ("b", "x", 0.9), ("b", "y", 0.6), ("c", "y", 0.7), ("c", "z", 0.1)])
    assert sorted(tuple(r) for r in dc.by_threshold(scored, 0.7).collect()) == [("a", "x", 0.9), ("c", "y", 0.7)]
    kept = {tuple(r) for r in dc.by_expectation(scored, 0.2, 0.0).collect()}
    assert ("a", "x", 0.9) in kept and all(t != "z" for _, t, _ in kept)
    owners = dc.owners(scored).groupBy("tgt").count().where("count > 1")
    assert owners.isEmpty()


def test_macro_f05_cases(spark):
    queries = spark.createDataFrame([("none",), ("false",), ("half",)], "s1 string")
    n_true = spark.createDataFrame([("half", 2)], "s1 string, n_true long")
    truth = spark.createDataFrame([("half", "x"), ("half", "y")], "s1 string, tgt string")
    predicted = pairs(spark, [("false", "x", 1.0), ("half", "x", 1.0)])
    got = {r.s1: r.f05 for r in ev.per_query(queries, n_true, predicted, truth).collect()}
    assert got == {"none": 1, "false": 0, "half": pytest.approx(1.25 / 1.5)}


def test_ranks_are_dense_and_knn_is_exact(spark):
    s, t = q._dense(spark, SF)
    a, b = bl.knn_both_ways(s, t, 5, 20, block=7, inner=4)
    one = bl.knn_both_ways(s, t, 5, 20)
    for many, single in zip((a, b), one):
        key = lambda df: sorted((r.s1, r.tgt, r.rank, round(r.score, 9)) for r in df.collect())
        assert key(many) == key(single)
    sizes = a.groupBy("tgt").agg(F.count("*").alias("n"), F.max("rank").alias("m")).where("n <> m + 1")
    assert sizes.isEmpty()


def all_scores(s1, targets, weight=1.0):
    """Every pair that shares a gram of the name or the address, through an inverted index."""
    bags = lambda df, key: [vx.unit_length(bag, key, "country") for bag in vx.record_bags(df.withColumnRenamed("entity_id", key), key, "country")]
    name, addr = (bl.sparse_scores(x, y) for x, y in zip(bags(s1, "s1"), bags(targets, "tgt")))
    both = name.withColumnRenamed("score", "name_cos").join(addr.withColumnRenamed("score", "addr_cos"), ["s1", "tgt"], "full")
    for df, key in ((s1, "s1"), (targets, "tgt")):
        both = both.join(df.select(F.col("entity_id").alias(key), (F.col("addr_n") != "").alias(f"some_{key}")), key)
    cos = lambda w: vx.combined_cosine(F.coalesce("name_cos", F.lit(0.0)), F.col("addr_cos"), w, F.col("some_s1"), F.col("some_tgt"))
    return both.select("s1", "tgt", "name_cos", "addr_cos", cos(weight).alias("score"), cos(1000.0).alias("addr_score"))


@pytest.mark.parametrize("block,inner,dense", [(1 << 14, 1024, 2048), (40, 16, 5)])
def test_nearest_by_field_is_exact(spark, block, inner, dense, monkeypatch):
    monkeypatch.setattr(bl, "DENSE_GRAMS", dense)
    s1, t = (sk.scratch(x, "records") for x in q._prep(spark, SF))
    every = sk.scratch(all_scores(s1, t), "scores")
    found = sk.scratch(bl.nearest_by_field(s1, t, block=block, inner=inner), "nearest")
    for way, score, per, other, k in (("a", "score", "tgt", "s1", 5), ("b", "score", "s1", "tgt", 20), ("c", "addr_score", "tgt", "s1", 2)):
        want = bl.top(every.withColumn("score", F.col(score)), per, other, k)
        got = bl.top(found.where(F.col("way") == way).withColumn("score", F.col(score)), per, other, k)
        near = lambda df: {(r.s1, r.tgt, r.rank): (round(r.score, 8), round(r.name_cos or 0, 8), round(r.addr_cos or 0, 8)) for r in df.collect()}
        want, got = near(want), near(got)
        assert len(want) == len(got)
        assert sum(got.get(key) == value for key, value in want.items()) >= 0.99 * len(want)  # sums in another order may swap equal scores
        assert sorted(v[0] for v in want.values()) == pytest.approx(sorted(v[0] for v in got.values()))


def test_sparse_top_k_equals_the_index(spark):
    a, b = q._grams(spark, SF, "addr_n")
    left, right = (sk.scratch(vx.unit_length(x.withColumn("w", F.col("n").cast("double")), key, "country"), "vectors") for x, key in ((a, "s1"), (b, "tgt")))
    for descending in (False, True):
        key = lambda df: sorted((r.s1, r.rank, r.tgt, round(r.score, 9)) for r in df.collect())
        want = key(bl.top_k(bl.sparse_scores(left, right), 7, descending_id=descending))
        got = key(bl.sparse_top_k(left, right, 7, descending_id=descending, block=30, inner=11))
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and sum(x == y for x, y in zip(got, want)) >= 0.99 * len(want)


def test_top_k_ties(spark):
    scores = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.5), ("q", "c", 0.0), ("q", "d", 0.9)], "s1 string, tgt string, score double")
    assert [r.tgt for r in bl.top_k(scores, 2, descending_id=True).orderBy("rank").collect()] == ["d", "b"]
    assert [r.tgt for r in bl.top_k(scores, 9).orderBy("rank").collect()] == ["d", "a", "b"]


def test_word_grams(spark):
    grams = lambda text: sorted(spark.createDataFrame([(text,)], "a string").select(vx.word_grams(F.col("a"), 2, 4)).first()[0])
    assert grams("ab") == sorted([" a", "ab", "b ", " ab", "ab ", " ab "])
    assert grams("") == []


def test_group_split_and_parts(spark):
    rows = q._candidates(spark, SF)
    train, test = lb.group_split(rows)
    assert train.count() + test.count() == rows.count() and lb.disjoint(train, test)
    sides = lb.nested_split(rows)
    parts = [sides.where(F.col("side") == x) for x in ("train", "valid", "holdout")]
    assert all(lb.disjoint(a, b) for i, a in enumerate(parts) for b in parts[:i]) and sum(x.count() for x in parts) == rows.count()


def test_readers_and_sinks(spark, tmp_path):
    path = tmp_path / "r.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nA\tthe "x\t\tUS\nB\tNA\tnull\tIndia\n')
    df = rd.records_tsv(spark, str(path))
    assert [tuple(r) for r in df.orderBy("entity_id").collect()] == [("A", 'the "x', "", "US"), ("B", "NA", "null", "India")]
    with pytest.raises(ValueError):
        rd.assert_unique(df.union(df), "entity_id")
    with pytest.raises(ValueError):
        rd.many_files(spark, str(path), expected=10)
    with pytest.raises(ValueError):
        rd.selected(df, spark.createDataFrame([("Z",)], "entity_id string"), check=True)
    first = sk.stage(df, str(tmp_path / "stage"))
    assert sk.stage(df.limit(0), str(tmp_path / "stage")).count() == first.count() == 2
    died = tmp_path / "died"
    (died / "_temporary").mkdir(parents=True)
    (died / "part-00000.parquet").write_bytes(b"half")
    assert sk.stage(df, str(died)).count() == 2
    with pytest.raises(ValueError):
        rd.country_sample(df, "France", 5, check=True)
    with pytest.raises(ValueError):
        rd.distractor_pool(df.withColumn("source", F.lit(0)), spark.createDataFrame([("A", "Z")], "s1 string, tgt string"), 1, check=True)
    assert rd.first_existing(spark, str(tmp_path / "none"), str(tmp_path / "stage")).count() == 2
    lists = sk.id_lists(df, spark.createDataFrame([("A", "y"), ("A", "x")], "s1 string, tgt string"), "ids")
    assert sorted(tuple(r) for r in lists.collect()) == [("A", "x,y"), ("B", "")]
    sk.append_tsv(df, str(tmp_path / "out"))
    sk.append_tsv(df, str(tmp_path / "out"))
    assert rd.records_tsv(spark, str(tmp_path / "out")).count() == 4


def test_written_lists_are_validated(spark):
    s1 = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    targets = spark.createDataFrame([("x",), ("y",)], "entity_id string")
    lists = lambda *rows: spark.createDataFrame(rows, "source1_entity_id string, ids string")
    wrong = lambda m, c: {r.rule for r in sk.validate_lists(s1, targets, m, c).collect() if r.violations}
    assert wrong(lists(("a", "x"), ("b", "")), lists(("a", "x,y"), ("b", None))) == set()
    assert wrong(lists(("a", "x"), ("a", "")), lists(("a", "y"), ("b", "z"), ("c", ""))) == {"matches_not_once", "candidates_not_once", "not_a_candidate"}


def test_truth_is_found_and_features_are_complete(spark):
    found = q.exact_name_recall(spark, SF).first()
    assert found.true_pairs == 180 and 0 < found.recall < 1
    assert q.entry(spark, SF).count() == 1
    features = q.features46(spark, SF)
    assert len(features.columns) == 48 and features.count() == features.select("s1", "tgt").distinct().count() > 0
    assert len(q.features18(spark, SF).columns) == 20


def test_features46_reads_both_fields_and_all_channels(spark):
    rows = q.features46(spark, SF).select("s1", "tgt", "name_cos", "addr_cos", "rank_a", "rank_b", "rank_c", "addr_nn_cos").collect()
    assert all(r.name_cos is not None or r.addr_cos is not None for r in rows)
    assert any(r.name_cos is not None for r in rows) and any(r.addr_cos is not None for r in rows)
    assert any(r.rank_c < 99 and r.addr_nn_cos is not None for r in rows)
    assert any(r.name_cos is None and r.rank_c == 0 for r in rows) or any(r.rank_a >= 1 and r.rank_b >= 3 and r.rank_c == 0 for r in rows)
    assert len({(r.s1, r.tgt) for r in rows}) == len(rows)


def test_every_oracle_has_a_query():
    assert set(q.ORACLES) <= set(q.QUERIES) and len(q.QUERIES) > 60


def test_streaming_top_k_equals_batch(spark, tmp_path):
    rows = [(f"q{i % 3}", f"t{i}", float((i * 37) % 101) / 100) for i in range(60)]
    schema = "s1 string, tgt string, score double"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = running_top_k(stream, str(tmp_path / "top"), 4, str(tmp_path / "check"))
    running.processAllAvailable()
    last = running.lastProgress["batchId"] if running.lastProgress["numInputRows"] else running.lastProgress["batchId"] - 1
    running.stop()
    got = sorted((r.s1, r.tgt, r.rank) for r in latest(spark, str(tmp_path / "top"), min(last, 2)).collect())
    want = sorted((r.s1, r.tgt, r.rank) for r in bl.top_k(spark.createDataFrame(rows, schema), 4, descending_id=True).collect())
    assert got == want
