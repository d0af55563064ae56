"""Prefix-free parsing against plain Python: suffix order, repeated windows and the whole removal."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import prefix_free as pf
from matchloom.llm.textarrays import text_buffers


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-1])[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=40):
    rng = np.random.default_rng(seed)
    letters = list("abcdefgh é\n")
    text = lambda k: "".join(rng.choice(letters, k))
    shared = [text(k) for k in (150, 199, 200, 230, 260, 420, 900)]
    texts = [None, "", "short", "a" * 450, "ab" * 180, "a" * 200, shared[4], shared[4]]
    for _ in range(n):
        parts = [text(rng.integers(0, 260))]
        for _ in range(rng.integers(0, 4)):
            s = shared[rng.integers(0, len(shared))]
            x = rng.integers(0, 40)
            parts += [s[x : len(s) - rng.integers(0, 40)], text(rng.integers(0, 120))]
        texts.append("".join(parts))
    return texts + texts[10:14]


@pytest.mark.parametrize("seed", range(3))
def test_order_and_windows(seed):
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("ab"), rng.integers(1, 60))) for _ in range(12)] + ["aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 20, "x"]
    data, offsets = text_buffers(pa.array(texts))
    order = pf.corpus_order(data, offsets, 200, width=3, modulus=4)
    ends = offsets[np.searchsorted(offsets, order, "right")]
    raw = data.tobytes()
    suffixes = [raw[p:e] for p, e in zip(order.tolist(), ends.tolist())]
    assert sorted(order.tolist()) == list(range(len(data))) and suffixes == sorted(suffixes)
    for length in (1, 5, 12):
        got = pf.repeated_windows(data, offsets, length)
        all_windows = [(p, raw[p : p + length]) for a, e in zip(offsets[:-1], offsets[1:]) for p in range(a, e - length + 1)]
        count = {}
        for _, w in all_windows:
            count[w] = count.get(w, 0) + 1
        assert np.flatnonzero(got).tolist() == [p for p, w in all_windows if count[w] > 1]


@pytest.mark.parametrize("seed,local,hot", [(1, 64, 4096), (2, 2, 3), (3, 64, 1)])
def test_removal_equals_brute_force(spark, monkeypatch, seed, local, hot):
    monkeypatch.setattr(pf, "LOCAL_HOT", local)
    monkeypatch.setattr(pf, "HOT", hot)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in pf.remove_repeats(docs).collect()}
    for i, want in enumerate(brute(texts, 200)):
        assert got[i] == want, (i, texts[i])


def test_hot_partition_beside_whole_copies(spark):
    rng = np.random.default_rng(4)
    text = lambda k: "".join(rng.choice(list("abcdefghij "), k))
    passage, heads = text(150), [text(150) for _ in range(10)]
    hot = [(heads[i] if i < 10 else text(150)) + passage + text(150) for i in range(3 * pf.LOCAL_HOT)]
    copies = [h + passage + text(150) for h in heads] * 2
    texts = hot + copies
    rows = list(enumerate(texts))
    tasks = spark.sparkContext.parallelize([rows[: len(hot)], rows[len(hot) :]], 2)
    docs = spark.createDataFrame(tasks.flatMap(lambda x: x), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in pf.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert pf.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    long = "".join(np.random.default_rng(0).choice(list("abcdefghij"), 300))
    rows = pf.remove_repeats(spark.createDataFrame([(1, long), (1, long), (2, None), (None, "n")], schema), with_bytes=True).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, bytes(r.kept)) for r in rows) == [(0, 1, 0, b"n"), (1, 300, 300, b""), (1, 300, 300, b""), (2, 0, 0, b"")]
