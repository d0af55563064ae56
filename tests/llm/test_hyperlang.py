"""Hyperdimensional language profiles: binding, bundling and held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa

from matchloom.llm import hyperlang as hl
from matchloom.llm.textarrays import text_buffers

DATA = "/root/testdata/sf0.01/documents.parquet"


def brute_grams(text):
    s, out = " ", {}
    for c in text or "":
        if c.isalpha():
            s += c.lower() if len(c.lower()) == 1 else c
        elif s[-1] != " ":
            s += " "
    if s == " ":
        return {}
    s += "" if s[-1] == " " else " "
    for i in range(len(s) - 2):
        out[s[i : i + 3]] = out.get(s[i : i + 3], 0) + 1
    return out


def test_grams_equal_brute_force():
    texts = ["Der Hund, die Katze!", None, "", "123 ...", "a", "ab", "1 a", "日", "Straße ÉTÉ İx 日本語 テ", "  x  yz  "]
    row, gram, n = hl.text_grams(*text_buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        got = {"".join(chr((int(g) >> 21 * j) & 0x1FFFFF) or " " for j in (2, 1, 0)).replace("\0", " "): int(c) for r, g, c in zip(row, gram, n) if r == k}
        assert got == brute_grams(t), t


def test_bundle_is_the_sum_of_bound_vectors():
    texts = ["hello world", "", "abc"]
    row, gram, n = hl.text_grams(*text_buffers(pa.array(texts)))
    got = hl.bundle(row, gram, n, 3, 256)
    for k in range(3):
        want = sum((c * hl.gram_vectors(np.array([g]), 256)[0] for r, g, c in zip(row, gram, n) if r == k), np.zeros(256))
        assert np.allclose(got[k], want)
    v = hl.gram_vectors(np.unique(gram), 1024)
    assert set(np.unique(v)) == {-1.0, 1.0}
    assert np.abs(v @ v.T - 1024 * np.eye(len(v))).max() < 200


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(DATA).select("doc_id", "text", "lang")
    rows = hl.learn_and_predict(docs).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, "en", 5), (2, "", None, 5), (3, "12 + 3", "en", 5), (4, "hello there", None, 5)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in hl.learn_and_predict(odd).collect()}
    assert got == {i: ("und", 0.0) for i in (1, 2, 3, 4)}
    assert hl.learn_and_predict(odd.where("false")).count() == 0


def test_predictions_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hl, "GRAMS", 40)
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("the mat and the hat", "en"), ("die maus und der hut", "de"), ("a", None), ("5 x", None), ("chien et chat", None), ("und die hand", None), (None, "en"), ("...", "fr")] * 3)]
    total = {}
    vector = lambda text: sum((c * hl.gram_vectors(np.array([sum(ord(x) * (x != " ") << 21 * (2 - j) for j, x in enumerate(g))], np.uint64), hl.DIMENSIONS)[0].astype(float) for g, c in brute_grams(text).items()), np.zeros(hl.DIMENSIONS))
    for i, t, lang in docs:
        if t and lang and zlib.crc32(str(i).encode()) % 4 != 2:
            total[lang] = total.get(lang, 0) + vector(t)
    for r in hl.learn_and_predict(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect():
        v = vector(r.text)
        cosine = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in total.items()} if v.any() else {}
        assert r.lang_pred == (max(sorted(cosine), key=cosine.get) if cosine else "und")
        assert abs(r.score - max(0, *cosine.values(), 0) if cosine else r.score) < 1e-5
