"""Jaccard join and components against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import components, partenum
from matchloom.llm.textarrays import text_buffers


def shingles(text, n=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, num=80, den=100):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * inter >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def corpus(seed, families=25, members=9, common=True):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 40))
    texts = [None, "", "  \n", "one", "One", "one two", "one  TWO", "one two three four", "a b c d e", "a b c d e f", "ß É x y z q"]
    for _ in range(families):
        base = list(rng.choice(vocabulary, rng.integers(3, 160)))
        if common and rng.random() < 0.6:
            at = rng.integers(0, len(base))
            base[at:at] = passage
        for _ in range(rng.integers(1, members)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(map(str, copy)).replace("w1", "W1"))
    texts += texts[:30]
    return [(int(i), t) for i, t in enumerate(texts)]


def family(seed, members=120, words=90):
    """Copies of one text with up to a fifth of their words changed, most of which do not link with one another."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(members):
        copy = list(base)
        for at in rng.choice(words, rng.integers(0, 8), replace=False):
            copy[at] = f"n{rng.integers(0, 40)}"
        out.append(" ".join(copy[: words - int(rng.integers(0, 3))]))
    return out


@pytest.mark.parametrize("seed,limit", [(1, 2048), (2, 3)])
def test_components_equal_brute_force(spark, seed, limit):
    rows = corpus(seed)
    rows += [(1000 + i, t) for i, t in enumerate(family(seed))]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, k1 int").repartition(3)
    got = sorted(tuple(r) for r in partenum.similar_components(docs, matrix=limit).collect())
    assert got == brute(rows)


def test_null_ids_and_ids_of_two_texts_link(spark):
    words = [f"w{i}" for i in range(60)]
    left, right = " ".join(["x", "y"] + words), " ".join(words + ["p", "q"])
    middle, far = " ".join(words), " ".join(f"z{i}" for i in range(30))
    longer = " ".join(["x1", "y1", "v1", "u1", "t1"] + words + ["p1", "q1", "r1", "s1"])
    rows = [(1, left), (2, right), (None, middle), (5, far), (5, longer), (8, far + " end")]
    got = sorted((tuple(r) for r in partenum.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == sorted([(1, 58, 1), (2, 58, 1), (None, 56, 1), (5, 26, 5), (5, 65, 1), (8, 27, 5)], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert partenum.similar_components(docs).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (1, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in partenum.similar_components(docs).collect()) == [(1, 0, 1), (1, 0, 1), (2, 0, 2)]


def test_similar_sets_share_enough_signatures():
    rng = np.random.default_rng(5)
    for _ in range(60):
        size = int(rng.integers(1, 400))
        base = rng.integers(0, 1 << 54, 2 * size + 4, dtype=np.uint64)
        x = np.unique(base[:size])
        y = np.unique(np.concatenate([x[: len(x) - size // 12], base[size : size + size // 12]]))
        inter = len(np.intersect1d(x, y))
        if 100 * inter < 80 * (len(x) + len(y) - inter):
            continue
        both = np.concatenate([x, y])
        made, found = partenum.signatures(both, np.array([0, len(x), len(x) + len(y)]), np.array([7, 9], np.uint64), 80, 100)
        need = {int(e): (int(s), int(n)) for e, s, n in zip(*found)}
        by = {7: {}, 9: {}}
        for sig, e in zip(*(m.tolist() for m in made)):
            by[need[e][0]].setdefault(sig, e)
        shared = set(by[7]) & set(by[9])
        assert shared
        for who in (7, 9):
            counts = {}
            for sig in shared:
                counts[by[who][sig]] = counts.get(by[who][sig], 0) + 1
            assert any(n >= need[e][1] for e, n in counts.items())


@pytest.mark.parametrize("a,b,common", [(7, 8, 7), (13, 16, 13), (14, 16, 14), (15, 16, 14), (15, 18, 15), (30, 34, 29), (31, 38, 31), (62, 66, 57), (63, 78, 63)])
def test_sets_of_neighbouring_bands_meet(a, b, common):
    assert 100 * common >= 80 * (a + b - common)
    for seed in range(400):
        values = np.random.default_rng(seed).integers(0, 1 << 54, a + b - common, dtype=np.uint64)
        both = np.concatenate([np.sort(values[:a]), np.sort(values[a - common :])])
        made, found = partenum.signatures(both, np.array([0, a, a + b]), np.array([7, 9], np.uint64), 80, 100)
        of = {int(e): (int(s), int(n)) for e, s, n in zip(*found)}
        held = {7: {}, 9: {}}
        for sig, e in zip(*(m.tolist() for m in made)):
            held[of[e][0]].setdefault(e, set()).add(sig)
        kept = {who: [x & set().union(*held[16 - who].values()) for e, x in held[who].items()] for who in held}
        kept = {who: [x for x, e in zip(kept[who], held[who]) if len(x) >= of[e][1]] for who in held}
        assert set().union(*kept[7]) & set().union(*kept[9]), seed


def test_set_sizes_ignore_repeats():
    data, offsets = text_buffers(pa.array(["a b c d e a b c d e", None, "x"]))
    sets, first = partenum.shingle_sets(data, offsets)
    assert np.diff(first).tolist() == [5, 0, 1]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
