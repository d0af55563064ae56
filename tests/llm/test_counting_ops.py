"""Repetition rules, line dedup, packing and benchmark search against plain Python."""

import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import concat_cut, line_cuckoo, repetition, wu_manber
from matchloom.llm.encoding import UnitEncoder
from matchloom.llm.textarrays import text_buffers

P = pytest.importorskip("public_tokenizers")
WS = "\x20\x09\x0a\x0b\x0c\x0d"
TEXTS = [
    None, "", " ", "\n\n", "one\ntwo\n", "  A common Line here \nx", "a common line HERE\ny\nA common line here", "ß é " * 30,
    "same words again and again " * 40, "the licence text of this work\n" * 7 + "tail", "x" * 5000, "naïve café\r\nA common line here\t\n",
    "日本語 の テキスト\n日本語 の テキスト", " ".join(f"w{i}" for i in range(4000)), "# * $ % & | < >\n#\n#",
]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows.append((3, texts[3], "de", None))  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, doc string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_repetition_counts(spark):
    for row in repetition.repetition_quality(frame(spark).drop("kept")).collect():
        t = row.text or ""
        w = words(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(w) < 500 else set()
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(words(line)) and line in seen
            seen.add(line)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)), t
        assert row.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        for n in repetition.NGRAM_LIMITS:
            grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
            marked = {i + k for i, x in enumerate(grams) if grams.count(x) > 1 for k in range(n)} if len(w) < 500 else set()
            assert row[f"coverage_{n}"] == pytest.approx(sum(len(w[i]) for i in marked) / max(1, sum(map(len, w))))


def brute_lines(rows, least=10):
    first, count = {}, {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            k = line.strip(WS)
            k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
            if len(k) >= least:
                first[k] = min(first.get(k, doc), doc)
                count.setdefault(k, set()).add(doc)

    def kept(doc, text):
        out = []
        for line in (text or "").split("\n"):
            k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))
            if not (len(k) >= least and len(count[k]) > 1 and first[k] != doc):
                out.append(line)
        return "\n".join(out)

    return {(doc, text): kept(doc, text) for doc, text in rows}


def test_line_dedup_and_reversal(spark):
    docs = frame(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_lines(rows)
    for r in line_cuckoo.drop_repeated_lines(docs).collect():
        assert (r.kept_text or "") == want[(r.doc_id, r.text)]
        assert (r.kept_text is None) == (r.text is None)
        assert r.n_lines == len((r.text or "").split("\n"))
    # inserting and deleting documents leads back to the old decisions
    index = line_cuckoo.LineIndex.build(docs.where("doc_id <> 5"))
    before = {tuple(r) for r in index.dropped().collect()}
    grown = index.insert(docs.where("doc_id = 5"))
    assert {tuple(r) for r in grown.dropped().collect()} == {tuple(r) for r in line_cuckoo.LineIndex.build(docs).dropped().collect()} != before
    assert {tuple(r) for r in grown.delete(docs.where("doc_id = 5")).dropped().collect()} == before
    empty = line_cuckoo.drop_repeated_lines(docs.where("false"))
    assert empty.count() == 0


def test_changes_of_the_index_equal_a_new_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    some = [f"a line that is number {i}" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(some, rng.integers(0, 12))), "x") for i in range(80)] + [(3, some[0] + "\n" + some[1], "y"), (None, some[2], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    index = line_cuckoo.LineIndex.build(docs.where("doc_id % 3 <> 0"))
    index = index.insert(docs.where("doc_id % 3 = 0 or doc_id is null")).delete(docs.where("doc_id % 5 = 1")).insert(docs.where("doc_id = 6"))
    fresh = line_cuckoo.LineIndex.build(docs.where("doc_id % 5 <> 1 or doc_id = 6"))
    assert {tuple(r) for r in index.refs.collect()} == {tuple(r) for r in fresh.refs.collect()}
    counts = {}
    for doc, text in {(d, line) for d, t, _ in rows if d is not None and (d % 5 != 1 or d == 6) for line in t.split("\n")}:
        counts[text] = counts.get(text, 0) + 1
    assert sorted(r.n for r in fresh.refs.collect()) == sorted(n for k, n in counts.items() if n > 1 and len(k) >= 10)
    held = {r.shard: line_cuckoo.ShardFilter(r.blobs) for r in index.filters.collect()}
    assert all(held[r.k1 % index.shards].contains(np.array([r.k1]).view(np.uint64))[0] for r in index.refs.collect())
    want = {tuple(r) for r in fresh.dropped().collect()}
    assert {tuple(r) for r in index.dropped().collect()} == want
    monkeypatch.setattr(line_cuckoo, "FILTER_KEYS", 0)
    assert {tuple(r) for r in index.dropped().collect()} == want


def test_full_filters_get_a_further_one():
    rng = np.random.default_rng(2)
    f, keys = line_cuckoo.ShardFilter([]), rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    for k in range(0, 9000, 300):
        f.insert(keys[k : k + 300])
    f = line_cuckoo.ShardFilter(f.blobs())
    assert f.contains(keys).all() and 1 < len(f.filters) < 12
    f.remove(keys[:200])
    assert f.contains(keys[200:]).all() and f.contains(keys[:200]).mean() < 0.1


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    f = line_cuckoo.build_filter(keys)
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.002
    f.remove(keys[:500])
    assert f.contains(keys[500:]).all() and f.contains(keys[:500]).mean() < 0.05


@pytest.mark.parametrize("name,mode", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_unit_encoder_equals_library(name, mode):
    texts = [t or "" for t in TEXTS] + ["don't 's  \n\n x\r\n y\t z \n", "a\x1cb !\x1c!", "<|endoftext|> hi", "a  <|endoftext|>\n b<|endoftext|>c, x<|endoftext|>,<|startoftext|>. <|ENDOFTEXT|> <|endoftext", "<|endoftext|><|endoftext|>", "é à   b  c", "a.b,c;;'s.'t ) . ,x é,é. ×, ü.ü", "a\u0085 b", "　  x"]
    from tokenizers import Tokenizer

    e = UnitEncoder(P.path(name), mode)
    for order in (texts, texts[::-1]):
        ids, count = e.encode(*text_buffers(pa.array(order)))
        got = np.split(ids, np.cumsum(count)[:-1])
        assert [g.tolist() for g in got] == [x.ids for x in Tokenizer.from_file(P.path(name)).encode_batch(order, add_special_tokens=False)]


def test_packing_covers_every_id_once(spark):
    nameless = spark.createDataFrame([(None, "no id " * 90, "en", "s"), (None, None, "en", "s")], "doc_id long, text string, kept string, doc string")
    docs = frame(spark).unionByName(nameless).repartition(3)
    path = P.path("word_bpe_49k.json")
    window = 256
    rows = concat_cut.pack(docs, path, window=window, with_ids=True).collect()
    e = UnitEncoder(path, "word")
    stream = {}
    for r in rows:
        assert r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        stream.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for n, pieces in stream.items():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(pieces, pieces[1:]))
        size = sum(x for _, x in pieces)
        assert size <= window and size & (size - 1) == 0
    assert sorted(stream) == list(range(len(stream)))
    total = sum(r.length for r in rows)
    want = sum(len(e.tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert total == want
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(x for _, x in sorted(by_doc[(i, len(ids) // 4)])) == ids
    none = np.array([*e.tokenizer.encode("no id " * 90, add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert b"".join(x for _, x in sorted(by_doc[(None, len(none) // 4)])) == none and by_doc[(None, 1)] == [(0, np.array([2], "<u4").tobytes())]
    assert concat_cut.pack(docs.where("false"), path).count() == 0


def brute_hits(text, items, window):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = find(text), set(), set()
    for item, t in items:
        x = find(t)
        size = min(window, len(x))
        strings = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if size else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i : i + size]) in strings:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(w), sorted(hit), sorted(found)


def test_search_tables_stay_small():
    rng = np.random.default_rng(0)
    vocabulary = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(rng.choice(vocabulary, 200)) for _ in range(1500)]
    tracemalloc.start()
    searches = wu_manber.test_strings(texts, 10)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    size = sum(map(len, texts))
    assert held < 60 * size and most < 120 * size  # a block of 4 MB: about 200 MB
    assert sum(len(s.hashes) for s in searches) == len({tuple(t.split()[i : i + 10]) for t in texts for i in range(191)})


def test_benchmark_search(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "straße", "3", "The"]
    items = [(i, " ".join(rng.choice(vocabulary, 25))) for i in range(20)] + [(20, "short item"), (21, "w1"), (22, ""), (23, None), (24, "w1 w2 w3"), (25, "w1 w2 w3")]
    texts = [None, "", "...", "W1!", "short  ITEM", " ".join(rng.choice(vocabulary, 3000))]
    for _ in range(40):
        a = list(rng.choice(vocabulary, rng.integers(0, 60)))
        k = rng.integers(0, 20)
        b = (items[k][1]).upper().replace("É", "É").split()[rng.integers(0, 10) :]
        texts.append(" ".join(map(str, a)) + ", " + "-".join(b) + " " + " ".join(map(str, a[:5])))
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):
        for r in wu_manber.find_contamination(docs, bench, block_text=block).collect():
            n, hit, found = brute_hits(r.text, items, 10)
            assert (r.n_words, list(r.hits), list(r["items"])) == (n, hit, found)
