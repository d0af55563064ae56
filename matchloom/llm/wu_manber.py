"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A test string is a window of ``window`` consecutive words of an item, or all words
of a shorter item.  Strings of one length form one search:

* the shift table gives, for the block of two words that ends at the current
  place, how far the window may move without missing a string; most places are
  never looked at;
* where the shift is zero, the hash of the window's words selects the bucket of
  strings with that hash;
* a direct comparison of the words confirms the occurrence.

All texts of a block are searched in lockstep: each lane holds a place in one
stretch of a text, and lanes move by their own shifts.  Long texts are cut into
overlapping stretches, so no lane runs much longer than the others.

Test strings are places in one array of the items' words, so the tables of a block
take about fifty times its text.  Items are broadcast in blocks of bounded size and
a worker builds a block's tables once.  One pass over the documents meets all blocks:
a task holds some documents and takes the blocks in turn.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .textarrays import BYTE_VALUES, LOWER, blocks, mix, owner, prefix_hashes, runs, span_hashes, text_buffers

#: Bytes of benchmark text in one broadcast block, and blocks whose tables a worker keeps.
BLOCK_TEXT = 4 << 20
KEPT_BLOCKS = 4
#: Bytes of documents that meet a block before the next one is taken.
HELD_TEXT = 32 << 20
STRETCH = 1024
U = np.uint64
_STEP = U(0xA0761D6478BD642F)
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Words:
    """The words of some texts: lower-cased bytes one after another, their ends, hashes, and each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low, inside = LOWER[data], IS_WORD[data]
        starts, ends, self.first = runs(inside, offsets)
        self.hashes = span_hashes(prefix_hashes(BYTE_VALUES[low]), starts, ends)
        self.letters = low[inside]
        self.ends = np.append(0, np.cumsum(ends - starts))


def window_hashes(words: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` words."""
    h = np.zeros(len(begin), U)
    for k in range(size):
        h = mix(h * _STEP + words[begin + k])
    return h


def same_words(x: Words, a: np.ndarray, y: Words, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the windows at word ``a`` of x and at word ``b`` of y hold the same words, byte for byte."""
    same = np.ones(len(a), bool)
    for k in range(1, size + 1):
        same &= x.ends[a + k] - x.ends[a] == y.ends[b + k] - y.ends[b]
    left = np.flatnonzero(same)
    for lo in range(0, len(left), 1 << 14):
        at = left[lo : lo + (1 << 14)]
        length = x.ends[a[at] + size] - x.ends[a[at]]
        ramp = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        unlike = x.letters[np.repeat(x.ends[a[at]], length) + ramp] != y.letters[np.repeat(y.ends[b[at]], length) + ramp]
        same[at] = np.bincount(np.repeat(np.arange(len(at)), length)[unlike], minlength=len(at)) == 0
    return same


class Search:
    """Tables for the test strings of one length: windows of the items' words."""

    def __init__(self, size: int, words: Words, begin: np.ndarray, item: np.ndarray):
        self.size, self.words, self.block = size, words, min(2, size)
        self.bits = int(np.clip(np.ceil(np.log2(8 * max(1, size * len(begin)))), 12, 24))
        reach = size - self.block + 1
        self.shift = np.full(1 << self.bits, reach, np.uint8 if reach < 256 else np.int64)
        for end in range(self.block - 1, size):  # shifts fall, so the least is written last
            self.shift[self.slots(np.stack([words.hashes[begin + end - self.block + 1 + k] for k in range(self.block)], -1))] = size - 1 - end
        h = window_hashes(words.hashes, begin, size)
        order = np.lexsort((begin, h))
        h, begin, self.item = h[order], begin[order], item[order]
        new = np.ones(len(h), bool)
        alike = np.flatnonzero(h[1:] == h[:-1])
        new[alike + 1] = ~same_words(words, begin[alike], words, begin[alike + 1], size)
        self.edges = np.append(np.flatnonzero(new), len(h))  # a string's items: those from its edge to the next
        self.hashes, self.begin = h[self.edges[:-1]], begin[self.edges[:-1]]

    def slots(self, block: np.ndarray) -> np.ndarray:
        """Place in the shift table of a block of words (last axis)."""
        h = block[..., 0]
        if self.block == 2:
            h = h * _STEP + block[..., 1]
        return (mix(h) >> U(64 - self.bits)).astype(np.int64)

    def occurrences(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and string of every occurrence."""
        words, first = text.hashes, text.first
        if len(words) < self.size or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.zeros(len(words), np.int64)
        slot[self.block - 1 :] = self.slots(np.stack([words[k : len(words) - self.block + 1 + k] for k in range(self.block)], -1))
        count = np.maximum(0, np.diff(first) - self.size + 1)
        lanes = -(-count // STRETCH)
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(first[:-1] + self.size - 1, lanes) + nth * STRETCH
        stop = np.minimum(at + STRETCH, np.repeat(first[1:], lanes))
        found = []
        while len(at):
            step = self.shift[slot[at]].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        begin = (np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)) - self.size + 1
        h = window_hashes(words, begin, self.size)
        lo, hi = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        string = np.arange((hi - lo).sum()) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
        begin = np.repeat(begin, hi - lo)
        right = same_words(text, begin, self.words, self.begin[string], self.size)
        return begin[right], string[right]


def test_strings(texts: list[str], window: int) -> list[Search]:
    """Searches for the windows of these texts; an item is its place in the list."""
    words = Words(*text_buffers(pa.array(texts, pa.string())))
    count = np.diff(words.first)
    out = []
    for size in np.unique(np.minimum(count, window)).tolist():
        items = np.flatnonzero(np.minimum(count, window) == size)
        windows = count[items] - size + 1
        begin = np.arange(windows.sum()) + np.repeat(words.first[items] - (np.cumsum(windows) - windows), windows)
        if size:
            out.append(Search(size, words, begin, np.repeat(items, windows)))
    return out


def search_block(searches: list[Search], text: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of a block of texts the words that are hit, and (text, item) of all items found, once each."""
    row_of = owner(text.first)
    cover = np.zeros(len(text.hashes) + 1, np.int64)
    found = [np.zeros((0, 2), np.int64)]
    for search in searches:
        begin, string = search.occurrences(text)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + search.size, -1)
        pairs = np.unique(np.stack([row_of[begin], string], -1), axis=0)
        size = np.diff(search.edges)[pairs[:, 1]]
        at = np.arange(size.sum()) + np.repeat(search.edges[pairs[:, 1]] - (np.cumsum(size) - size), size)
        found.append(np.unique(np.stack([np.repeat(pairs[:, 0], size), search.item[at]], -1), axis=0))
    return np.flatnonzero(np.cumsum(cover)[:-1] > 0), np.unique(np.concatenate(found), axis=0)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark on the driver, a block of about ``limit`` bytes of text at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // limit + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item"], r["text"]) for r in part.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_text: int = BLOCK_TEXT) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (numbers of the words inside occurrences) and ``items``.

    Null or empty text has no words and no hits; items with a null id or text, or
    without words, are never found; equal items are all reported.  Further columns
    are kept, those named like the results are replaced.
    """
    docs = docs.drop("n_words", "hits", "items")
    schema = StructType([*docs.schema.fields]).add("n_words", LongType()).add("hits", ArrayType(LongType())).add("items", ArrayType(StringType()))
    text_at, n = docs.columns.index(text_col), len(docs.columns)
    context = docs.sparkSession.sparkContext
    shared = [(uuid.uuid4().hex, context.broadcast(items)) for items in item_blocks(benchmark, item_col, item_text_col, block_text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, text_at):
            count = [np.zeros(len(batch), np.int64) for batch in held]
            hits = [[[] for _ in range(len(batch))] for batch in held]
            names = [[set() for _ in range(len(batch))] for batch in held]
            for key, block in shared:
                items, searches = _tables(key, block, window)
                for k, batch in enumerate(held):
                    for lo, hi, d, o in blocks(*text_buffers(batch.column(text_at))):
                        text = Words(d, o)
                        count[k][lo:hi] = np.diff(text.first)
                        hit, found = search_block(searches, text)
                        row = np.searchsorted(text.first, hit, "right") - 1
                        for i, word in zip((row + lo).tolist(), (hit - text.first[row]).tolist()):
                            hits[k][i].append(word)
                        for i, item in found.tolist():
                            names[k][i + lo].add(items[item])
            for k, batch in enumerate(held):
                arrays = [pa.array(count[k]), pa.array([sorted(set(x)) for x in hits[k]], pa.list_(pa.int64())), pa.array([sorted(x) for x in names[k]], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def _held(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches of about ``HELD_TEXT`` bytes together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text_at).nbytes
        if size > HELD_TEXT:
            yield held
            held, size = [], 0
    if held:
        yield held


_built: dict[str, tuple[list[str], list[Search]]] = {}


def _tables(key: str, block, window: int) -> tuple[list[str], list[Search]]:
    """Item ids and searches of a broadcast block; a worker keeps those of the last few blocks."""
    if key not in _built:
        while len(_built) >= KEPT_BLOCKS:
            _built.pop(next(iter(_built)))
        rows = block.value
        _built[key] = [item for item, _ in rows], test_strings([text for _, text in rows], window)
    return _built[key]
