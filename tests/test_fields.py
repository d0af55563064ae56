"""Searches by two fields, against the inverted index over all pairs, and how many addresses they multiply."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from matchloom.operators import blocking as bl, fields as fl
from matchloom.plans import queries as q
from matchloom.sources import sinks as sk

from .test_operators import all_scores


@pytest.fixture(scope="module")
def sides(spark):
    """Names and addresses that often repeat, with words twice, without words, and without a common gram."""
    names = ["red rod", "red rods", "old rod", "bluee bolt 12", "a", "", "red red rod inc", "zz"]
    addrs = ["12 oak st 70481", "13 oak st 70482", "012 oak st", "oak st", "7", "", "7 7 77", "12 12 oak", "5 elm rd 70481", " ", "x"]
    make = lambda side, n: spark.createDataFrame([(f"{side}{k:03}", ("US", "India")[k % 7 // 5], names[k * k % 8 if k % 2 else k % 8], addrs[k * 5 % 11 if k % 3 else k % 11]) for k in range(n)], "entity_id string, country string, name_n string, addr_n string")
    s1, t = sk.scratch(make("s", 60), "records"), sk.scratch(make("t", 90), "records")
    return s1, t, sk.scratch(all_scores(s1, t), "scores")


@pytest.mark.parametrize("first,patterns,names,levels", [(1024, 2048, 12_000_000, 8), (1, 3, 20, 50), (3, 2048, 1, 1)])
def test_nearest_by_field_on_odd_texts(spark, sides, monkeypatch, first, patterns, names, levels):
    s1, t, every = sides
    x, y = (pq.read_table(fl.measured(df).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]) for df in (t, s1))
    every = every.toPandas()
    for k, v in {"FIRST": first, "STEP": 16, "PATTERNS": patterns, "NAMES": names, "LEVELS": levels, "CELLS": 50, "POSTINGS": 64}.items():
        monkeypatch.setattr(fl, k, v)
    for a, b, own, other, ways in ((x, y, "tgt", "s1", {"a": (1.0, 5), "c": (1000.0, 2)}), (y, x, "s1", "tgt", {"b": (1.0, 20)})):
        for country in ("US", "India"):
            m, o = (df.filter([c == country for c in df["country"].to_pylist()]) for df in (a, b))
            got = fl._search(m, o, ways, 1.0, 7).to_pandas()
            for way, (w, k) in ways.items():
                score = "addr_score" if w > 1 else "score"
                mine = every[every[own].isin(m["id"].to_pylist())].copy()
                mine["round"] = -np.round(mine[score], 9)
                want = mine.sort_values([own, "round", other]).groupby(own).head(k)
                rows = got[got["way"] == way].sort_values(["query", "rank"])
                assert rows["query"].tolist() == want[own].tolist() and rows[score].tolist() == pytest.approx(want[score].tolist())
                assert (rows["other"].to_numpy() == want[other].to_numpy()).mean() > 0.98  # sums in another order may swap equal scores
                assert rows["name_cos"].tolist() == pytest.approx(want["name_cos"].fillna(0).tolist())


def test_not_every_pair_is_multiplied(spark, monkeypatch):
    """Before, both fields of all pairs of records were multiplied."""
    s1, t = (sk.scratch(x, "records") for x in q._prep(spark, "/root/testdata/sf0.01"))
    x, y = (pq.read_table(fl.measured(df.where("country = 'US'")).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]) for df in (s1, t))
    cells = []
    plain = fl._Addresses.cells
    monkeypatch.setattr(fl._Addresses, "cells", lambda self, i, j: cells.append(len(i)) or plain(self, i, j))
    monkeypatch.setattr(fl, "FIRST", 64)
    assert fl._search(x, y, {"b": (1.0, 20)}, 1.0, 64).num_rows == 20 * x.num_rows
    assert sum(cells) < 0.5 * x.num_rows * y.num_rows


def test_rare_words_and_likely_names_bound_what_is_multiplied(spark, monkeypatch):
    """Before, 35 % of these pairs were multiplied, and words of patterns were looked up for all of a word's addresses."""
    s1, t = (sk.scratch(x, "records") for x in q._prep(spark, "/root/testdata/sf0.01"))
    x, y = (pq.read_table(fl.measured(df.where("country = 'US'")).inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]) for df in (s1, t))
    cells = []
    plain = fl._Addresses.cells
    monkeypatch.setattr(fl._Addresses, "cells", lambda self, i, j: cells.append(len(i)) or plain(self, i, j))
    monkeypatch.setattr(fl, "FIRST", 64)
    whole = fl._search(x, y, {"b": (1.0, 20)}, 1.0, 64)
    assert sum(cells) < 0.3 * x.num_rows * y.num_rows
    for name, value in {"NEAR": 20, "FEW": 30, "TABLE": 1, "POOR": 2.0, "ALONE": 0.1}.items():  # other ways to the same pairs
        monkeypatch.setattr(fl, name, value)
    other = fl._search(x, y, {"b": (1.0, 20)}, 1.0, 64)
    key = lambda found: sorted(zip(found["query"].to_pylist(), found["rank"].to_pylist(), np.round(found["score"].to_numpy(), 8).tolist()))
    assert key(other) == key(whole)


def test_channels_in_one_pass_equal_the_joined_ones(spark, sides):
    found = sk.scratch(bl.nearest_by_field(*sides[:2], block=20, inner=7), "nearest")
    of = lambda way, score: found.where(F.col("way") == way).select("s1", "tgt", F.col(score).alias("score"), "rank")
    pairs = found.groupBy("s1", "tgt").agg(F.max("score").alias("cos"))
    want = bl.add_channel(bl.candidate_table(of("a", "score"), of("b", "score")), of("c", "addr_score"), pairs)
    got = bl.three_channels(found)
    key = lambda df: sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.select(want.columns).fillna(-1).collect())
    assert key(got) == key(want) != []
