"""Searches by the patterns of texts, against the inverted index over all records."""

import pytest

from matchloom.operators import blocking as bl, numbered as nb, vectors as vx
from matchloom.plans import queries as q


def rows(df):
    return sorted((r.s1, r.rank, r.tgt) for r in df.collect())


def indexed(s1, targets, field, k, descending):
    a, b = (vx.tf_vectors(df.select(bl.F.col("entity_id").alias(key), "country", field), vx.char_grams(bl.F.col(field), 2, 4), key, "country") for df, key in ((s1, "s1"), (targets, "tgt")))
    return bl.top_k(bl.sparse_scores(a, b), k, descending_id=descending)


@pytest.fixture(scope="module")
def sides(spark):
    """Texts that often repeat, with and without numbers, on both sides."""
    texts = ["12 oak st 70481", "13 oak st 70482", "012 oak st", "oak st", "7", "", None, "77 é 7 7", "5 elm rd 70481", "x", "zz", "1200 oak ave 1", "123456789012", "12 12 12", "😀 12 oak"]
    make = lambda side, n: spark.createDataFrame([(f"{side}{k:03}", ("US", "India", None)[k % 7 // 3], texts[k * k % 15 if k % 2 else k % 15], k % 2) for k in range(n)], "entity_id string, country string, addr_n string, source int")
    return make("s", 60), make("t", 90)


@pytest.mark.parametrize("k", [1, 5, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_gram_top_k_equals_the_index(spark, sides, k, descending, monkeypatch):
    monkeypatch.setattr(nb, "PACK", 4)
    want = rows(indexed(*sides, "addr_n", k, descending))
    assert rows(nb.gram_top_k(*sides, "addr_n", k, descending_id=descending)) == want != []
    pairs = spark.createDataFrame([(s, t) for s, n, t in want if n % 3 == 0] + [("s001", "none")], "s1 string, tgt string")
    assert rows(nb.gram_top_k(*sides, "addr_n", k, descending_id=descending, wanted=pairs)) == [x for x in want if x[1] % 3 == 0]
    text = bl.text_top_k(*sides, "addr_n", q._char_grams, k, descending_id=descending, pairs=pairs)
    assert rows(text) == [x for x in want if x[1] % 3 == 0]


@pytest.mark.parametrize("k", [5, 50])
def test_addresses_of_the_fixture(spark, k):
    s1, t = (q.sk.scratch(x, "records") for x in q._prep(spark, "/root/testdata/sf0.001"))
    for field in ("addr_n", "name_n"):
        assert rows(nb.gram_top_k(s1, t, field, k, descending_id=True)) == rows(indexed(s1, t, field, k, True)) != []


def test_many_patterns_are_multiplied(spark, sides, monkeypatch):
    want = rows(indexed(*sides, "addr_n", 5, True))
    monkeypatch.setattr(nb, "PAIRS", 3)
    assert rows(nb.gram_top_k(*sides, "addr_n", 5, descending_id=True)) == want


@pytest.mark.parametrize("name", ["name_addr_union_topk", "recall_at_k"])
def test_address_vectors_are_not_copied_to_blocks(spark, monkeypatch, name):
    seen = []
    plain = bl.text_top_k
    monkeypatch.setattr(bl, "text_top_k", lambda s1, t, field, *x, **y: seen.append(field) or plain(s1, t, field, *x, **y))
    assert q.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 and seen == ["name_n"]
