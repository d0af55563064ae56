"""Token shards: exact round trips."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from matchloom.llm import repair_tokens as rt

P = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300), st.integers(2, 5), st.data())
def test_grammar_round_trip(ids, least, data):
    ids = np.array(ids, np.uint32)
    g = rt.compress(ids, 6, min_count=least)
    assert g.decode().tolist() == ids.tolist()
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids) + 3))
    assert g.decode(a, b).tolist() == ids[a:b].tolist()
    assert (g.lengths >= 2).all() and g.sizes(g.symbols).sum() == len(ids)


def test_repeats_become_short():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    g = rt.compress(ids, 1000)
    assert len(g.symbols) + 2 * len(g.left) < len(ids) / 50
    payload = rt.pack_shard(ids, np.array([len(ids)]), [None], 1000)
    back, sizes, names = rt.unpack_shard(payload)
    assert back.decode().tolist() == ids.tolist() and sizes.tolist() == [len(ids)] and names == [None]
    assert back.decode(12345, 12400).tolist() == ids[12345:12400].tolist()


@pytest.mark.parametrize("least", [4, 5])
def test_no_pair_that_pays_is_left(least):
    ids = np.random.default_rng(least).zipf(1.3, 20000).clip(0, 300).astype(np.uint32)
    g = rt.compress(ids, 301, least)
    assert g.decode().tolist() == ids.tolist()
    pairs, count = np.unique((g.symbols[:-1] << 32) | g.symbols[1:], return_counts=True)
    apart = pairs[(count >= least) & (pairs >> 32 != pairs & 0xFFFFFFFF)]  # pairs that cannot overlap with themselves
    assert not len(apart)


def test_documents_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = {9: "a a a a a a " * 500, 2: None, 5: "", 7: "Größe 日本 x" * 20, 1: "the cat sat\n\n on the mat", -3: "neg", 2**40: "far", 11: "end<|endoftext|>, x  <|endoftext|> <|endoftext|>\n<|endoftext|"}
    rows = [(k, v, 1) for k, v in texts.items()] + [(7, texts[7], 2), (None, "no id", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    out = str(tmp_path / "shards")
    rt.write_shards(docs, out, path, shard_ids=200)
    got = sorted(rt.read_documents(spark, out, with_ids=True).collect(), key=lambda r: r.start)
    order = sorted((k, v) for k, v, _ in rows if k is not None)
    assert [r.doc_id for r in got] == [None, *(k for k, _ in order)]
    place = 0
    for r, text in zip(got, ["no id", *(v for _, v in order)]):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert list(r.ids) == want and r.start == place and r.n_tokens == len(want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        place += len(want)
    fetched = sorted((r.doc_id, list(r.ids)) for r in rt.fetch_documents(spark, out, [7, -3, 12345]).collect())
    assert fetched == sorted((r.doc_id, list(r.ids)) for r in got if r.doc_id in (7, -3))
    assert rt.encode_and_read(docs.where("false"), path).count() == 0
