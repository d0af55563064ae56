"""The pipeline's stages against plain Python, on a small part of the test documents and on odd rows."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_counting_ops import brute_hits, brute_lines
from tests.llm.test_partenum import brute

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}


def good(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")

    def covered(n):
        grams, count = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)], {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        return {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(n)}

    total = sum(map(len, w))
    if len(w) < 50 or 100 * len(covered(3)) > 50 * len(w) or any(sum(len(w[i]) for i in covered(n)) > x * total for n, x in LIMITS.items()):
        return False
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += len(re.sub(r"[\x20\x09-\x0D]", "", line))
        seen.add(line)
    return again <= 0.2 * total


def test_stages_equal_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(None, "null id " * 3 + " ".join(f"n{i}" for i in range(60)), "en", None, None), (900, None, None, "s", 0), (901, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id = 3"))
    want = [(r.doc_id, r.text) for r in docs.collect()]
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        if name == "quality_rules":
            want = [(d, t) for d, t in want if good(t)]
        elif name == "line_dedup":
            kept = brute_lines([(d, t) for d, t in want if d is not None])
            want = [(d, t if d is None else kept[(d, t)]) for d, t in want]
        elif name == "jaccard_join":
            named = sorted({(d, t) for d, t in want if d is not None})
            first = {d for d, _, c in brute(named) if d == c}
            want = [(d, t) for d, t in named if d in first] + [(d, t) for d, t in want if d is None]
        else:
            want = [(d, t) for d, t in want if not brute_hits(t, benchmark, 10)[1]]
        key = lambda x: (x[0] is None, x)
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=key) == sorted(want, key=key), name
        assert all(r.n_chars == len(r.text) for r in docs.collect() if r.n_chars is not None)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for d, x in want}
    seen = dict.fromkeys(ids, 0)
    for r in corpus_pipeline.packing(spark, docs, SF).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
    assert seen == {d: len(x) for d, x in ids.items()}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
