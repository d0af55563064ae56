"""Hand-computed cases and properties of the normalisation and similarity functions."""

import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from matchloom.functions import normalize as nz, similarity as sim

from . import scalar_scorers as sc


def value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)) if cells else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("limittedd", "limited"), ("aa", "a"), ("", ""), ("no", "no")])
def test_squash(spark, text, want):
    assert value(spark, nz.squash("a"), a=text) == want


@pytest.mark.parametrize("text,want", [("s a s", "sas"), ("a b cd e f", "ab cd ef"), ("x", "x"), ("", ""), ("a 1 b", "a 1 b")])
def test_join_initials(spark, text, want):
    assert value(spark, nz.join_initials("a"), a=text) == want


@pytest.mark.parametrize("text,want", [("Société Générale & Cie", "societe generale and compagnie"), (None, ""), ("ABC Technologies Pvt. Ltd.", "abc technologies private limited"), ("Straße ŒUVRE Ł", "strasse oeuvre l"), ("  -- ", "")])
def test_name(spark, text, want):
    assert value(spark, nz.name("a"), a=text) == want


@pytest.mark.parametrize("text,want", [("private limited", "private limited"), ("acme s a s", "acme"), ("the acme group", "acme"), ("", "")])
def test_core(spark, text, want):
    assert value(spark, nz.core("a"), a=text) == want


@pytest.mark.parametrize("text,country,want", [
    ("12 Main St, Austin TX 78701", "US", "12 main street austin texas 78701"), ("5 ct fl", "US", "5 court florida"), ("5 ct fl", "India", "5 court floor"),
    ("1 a st tx 78701-1234", "US", "1 a street tx 78701 1234"), ("tx", "US", "texas"), ("78701", "US", "78701"), ("", "US", ""), (None, "US", ""), ("PO box 3", "India", "post office box 3"),
])
def test_address(spark, text, country, want):
    assert value(spark, nz.address("a", "c"), a=text, c=country) == want


def test_numbers_postcode_gap(spark):
    assert sorted(value(spark, nz.numbers("a"), a="0069 8c 00")) == ["0", "69", "8"]
    assert value(spark, nz.postcode("a"), a="05131 copper meadow lane") == ""
    assert value(spark, nz.postcode("a"), a="12 main st 78701") == "78701"
    assert value(spark, nz.postcode("a"), a="12 main st 78701 12") == ""
    gap = nz.number_gap(nz.numbers("a"), nz.numbers("b"))
    assert value(spark, gap, a="4747", b="4749") == 2
    assert value(spark, gap, a="1", b="1 2") == -1
    assert value(spark, F.log1p(F.greatest(gap, F.lit(-1 + 1e-9))), a="1", b="1 2") == pytest.approx(-20.7233, abs=1e-4)


def test_bucket_and_lists(spark):
    for text in ("S1-0000001", "é", ""):
        assert value(spark, nz.bucket("a"), a=text) == zlib.crc32(text.encode()) % 10
    assert value(spark, nz.id_list("a"), a=" x,,y,x ") == ["x", "y"]
    assert value(spark, nz.id_list("a"), a=None) == []


def test_jaccard_and_overlap(spark):
    a, b = F.col("a"), F.col("b")
    assert value(spark, sim.token_jaccard(a, b), a="x y y", b="y z") == pytest.approx(1 / 3)
    assert value(spark, sim.token_jaccard(a, b), a="", b="y") == 0
    assert value(spark, sim.number_overlap(a, b), a="12 a", b="b 12") == 1
    assert value(spark, sim.number_overlap(a, b), a="12a", b="12a") == 0


words = st.lists(st.sampled_from(["ab", "abc", "c", "ba", "é", "x" * 70, "ab" * 40, "\U0001f600"]), max_size=5).map(" ".join) | st.text("ab c\0", max_size=14)
VECTOR = {sim.ratios: sc.ratio_of, sim.sorted_ratios: sc.sorted_ratio_of, sim.set_ratios: sc.set_ratio_of, sim.partial_ratios: sc.partial_ratio_of, sim.jaro_winklers: sc.jaro_winkler_of}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), max_size=12))
def test_scorers_equal_brute_force(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert sim.subsequences(a, b).tolist() == [sc.subsequence(x, y) for x, y in pairs]
    for of, one in VECTOR.items():
        assert of(a, b).tolist() == pytest.approx([one(x, y) for x, y in pairs])


def test_scorers_as_columns(spark):
    rows = [("acme corp", "acme corporation"), (None, "x"), (None, None), ("", ""), ("acme corp", "acme corporation"), ("w " * 150, "w v " * 90)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(2)
    for column, one in zip((sim.ratio, sim.token_sort_ratio, sim.token_set_ratio, sim.partial_ratio, sim.jaro_winkler), VECTOR.values()):
        for r in df.select("a", "b", column("a", "b").alias("v")).collect():
            assert r.v == pytest.approx(one(r.a or "", r.b or ""))
        assert df.where("false").select(column("a", "b")).count() == 0


def test_known_scores():
    assert sim.ratios(["this is a test", ""], ["this is a test!", ""]).tolist() == pytest.approx([28 / 29, 1])
    assert sim.set_ratios(["fuzzy was a bear", ""], ["fuzzy fuzzy was a bear", ""]).tolist() == [1, 0]
    assert sim.sorted_ratios(["new york mets"], ["mets york new"])[0] == 1
    assert sim.partial_ratios(["test"], ["this is a test!"])[0] == 1
    assert sim.jaro_winklers(["martha"], ["marhta"])[0] == pytest.approx(0.961111, abs=1e-6)
