"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

``LineIndex`` keeps three tables, all keyed by the line key's 128-bit hash:

* ``postings``: which document holds which key (one row each);
* ``refs``: exact counts, with the smallest document that holds the key;
* ``filters``: one cuckoo filter for each shard of the keys that two documents or
  more hold.  Most lines occur once, so most look-ups end at the filter.

``insert`` and ``delete`` return a new index and work on the keys that the documents
touch: their counts are taken anew, keys that have become shared enter the filters,
keys that no longer are leave them.  Deleting what was inserted gives the old answers
again, because the counts are exact and a cuckoo filter, unlike a Bloom filter, can
forget a key.  A shard whose filter is full gets a further one, twice as large.

Filters are broadcast while they are small.  Beyond that they are dealt with the
postings, by shard, and a task streams a shard's postings past its filters.

Documents with a null id hold no keys and keep all their lines.  Rows that share
an id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import materialise, shuffle_parts
from .textarrays import BYTE_VALUES, BYTE_VALUES_2, CHAR_START, IS_SPACE, LOWER, blocks, counts_before, lines, mix, owner, prefix_hashes, span_hashes, sums, text_buffers

SHARDS = 64  # at least; a shard has about SHARD_KEYS shared keys when an index is built
SHARD_KEYS = 1_000_000
#: Keys whose filters together may be broadcast (about 2.5 bytes a key); beyond it filters and postings meet by shard.
FILTER_KEYS = 8_000_000
SALTS = 16  # tasks that share a shard's postings then, so that a line of very many documents is no task's own
U = np.uint64


class CuckooFilter:
    """16-bit fingerprints in buckets of four; whole arrays at a time.

    No false negatives; a key that is not there is reported with a chance of
    about 8 / 65,536.
    """

    SLOTS = 4

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / 0.8))))
            table = np.zeros((buckets, self.SLOTS), np.uint16)
        self.table = table

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys)
        mark = np.maximum(h >> U(48), U(1)).astype(np.uint16)
        return mark, (h & U(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(U)) & U(len(self.table) - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray, rounds: int = 500) -> None:
        """Adds keys; a key added twice has to be removed twice.  Doubles the table when it is too full."""
        mark, bucket = self._places(keys)
        rng = np.random.default_rng(len(keys))
        for turn in range(rounds):
            if not len(mark):
                return
            order = np.argsort(bucket, kind="stable")
            mark, bucket = mark[order], bucket[order]
            begin = np.flatnonzero(np.diff(bucket, prepend=-1))
            nth = np.arange(len(bucket)) - np.repeat(begin, np.diff(np.append(begin, len(bucket))))
            free = np.cumsum(self.table[bucket] == 0, axis=1)
            fits = nth < free[:, -1]
            slot = (free > nth[:, None]).argmax(1)
            self.table[bucket[fits], slot[fits]] = mark[fits]
            mark, bucket = mark[~fits], bucket[~fits]
            if turn % 2 == 0 or not len(mark):
                bucket = self._other(bucket, mark)
                continue
            first = np.flatnonzero(np.diff(bucket, prepend=-1))  # one eviction a bucket and round
            where = bucket[first], rng.integers(0, self.SLOTS, len(first))
            out = self.table[where].copy()
            self.table[where] = mark[first]
            mark[first] = out
            bucket = self._other(bucket, mark)
        raise OverflowError("cuckoo filter is full; build it with a larger capacity")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, bucket = self._places(keys)
        return (self.table[bucket] == mark[:, None]).any(1) | (self.table[self._other(bucket, mark)] == mark[:, None]).any(1)

    def remove(self, keys: np.ndarray) -> np.ndarray:
        """Forgets one copy of each key that is there; which ones were."""
        found = np.zeros(len(keys), bool)
        for i, key in enumerate(keys):  # few: keys whose count falls below two
            mark, bucket = self._places(np.array([key], U))
            for b in (bucket[0], self._other(bucket, mark)[0]):
                at = np.flatnonzero(self.table[b] == mark[0])
                if len(at):
                    self.table[b, at[0]] = 0
                    found[i] = True
                    break
        return found


def build_filter(keys: np.ndarray, capacity: int = 0) -> CuckooFilter:
    capacity = max(capacity, len(keys))
    while True:
        f = CuckooFilter(capacity)
        try:
            f.insert(keys)
            return f
        except OverflowError:
            capacity *= 2


class ShardFilter:
    """The filters of a shard; a key is in one of them."""

    def __init__(self, blobs: list[bytes]):
        self.filters = [CuckooFilter(0, np.frombuffer(b, np.uint16).reshape(-1, CuckooFilter.SLOTS).copy()) for b in blobs]

    def blobs(self) -> list[bytes]:
        return [f.table.tobytes() for f in self.filters]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for f in self.filters:
            out |= f.contains(keys)
        return out

    def insert(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        last = self.filters[-1].table if self.filters else np.zeros((0, CuckooFilter.SLOTS), np.uint16)
        if np.count_nonzero(last) + len(keys) <= 0.8 * last.size:
            grown = CuckooFilter(0, last.copy())
            try:
                grown.insert(keys)
                self.filters[-1] = grown
                return
            except OverflowError:
                pass
        self.filters.append(build_filter(keys, int(1.6 * last.size)))

    def remove(self, keys: np.ndarray) -> None:
        for f in reversed(self.filters):
            keys = keys[~f.remove(keys)]


def line_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Of all lines of a block: starts, ends, first line of each text, both hash halves, and whether the key is long enough."""
    starts, ends, first = lines(data, offsets)
    solid = counts_before(~IS_SPACE[data])
    places = np.flatnonzero(~IS_SPACE[data])
    lo, hi = solid[starts], solid[ends]
    some = hi > lo
    key_start, key_end = starts.copy(), starts.copy()
    key_start[some] = places[lo[some]]
    key_end[some] = places[hi[some] - 1] + 1
    chars = counts_before(CHAR_START[data])
    low = LOWER[data]
    h1 = span_hashes(prefix_hashes(BYTE_VALUES[low]), key_start, key_end)
    h2 = span_hashes(prefix_hashes(BYTE_VALUES_2[low]), key_start, key_end)
    return starts, ends, first, h1, h2, chars[key_end] - chars[key_start] >= min_chars


def postings_of(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, doc): each long enough line key of each document, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi, d, o in blocks(data, offsets):
                *_, first, h1, h2, long_enough = line_keys(d, o, min_chars)
                row = owner(first)[long_enough]
                h1, h2 = h1[long_enough], h2[long_enough]
                _, once = np.unique(h1 ^ mix(h2 + mix(row.astype(U))), return_index=True)
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(row[once]))
                yield pa.RecordBatch.from_arrays([pa.array(h1[once].view(np.int64)), pa.array(h2[once].view(np.int64)), ids], names=["k1", "k2", "doc"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "k1 long, k2 long, doc long")


def _shard(shards: int) -> F.Column:
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int").alias("shard")


FILTERS = "shard int, blobs array<binary>"


def updated_filters(filters: DataFrame, added: DataFrame, removed: DataFrame | None, shards: int) -> DataFrame:
    """(shard, blobs) after keys (k1) have come and gone."""
    change = added.select(_shard(shards), "k1", F.lit(True).alias("come"))
    if removed is not None:
        change = change.unionByName(removed.select(_shard(shards), "k1", F.lit(False).alias("come")))

    def change_shard(key, left, right):
        f = ShardFilter(left["blobs"][0].as_py() if left.num_rows else [])
        k1, come = right["k1"].to_numpy().view(U), np.array(right["come"].to_pylist(), bool)
        f.remove(k1[~come])
        f.insert(k1[come])
        return pa.table({"shard": [key[0].as_py()], "blobs": [f.blobs()]}, schema=pa.schema([("shard", pa.int32()), ("blobs", pa.list_(pa.binary()))]))

    return filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInArrow(change_shard, FILTERS)


def _counted(postings: DataFrame) -> DataFrame:
    """(k1, k2, first_doc, n) of the keys that two documents or more hold."""
    counted = postings.groupBy("k1", "k2").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.count("*").alias("n"))
    return counted.where("first_doc < last_doc").select("k1", "k2", "first_doc", "n")


def _once(postings: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """Postings of rows that share an id, each once."""
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long")).count().where("count > 1")
    return postings if repeated.isEmpty() else postings.distinct()


@dataclass
class LineIndex:
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    min_chars: int
    shards: int

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> "LineIndex":
        postings = materialise(_once(postings_of(docs, min_chars, id_col, text_col), docs, id_col), "line-postings")
        # only keys that occur again are kept in the table: a key without an entry has a count of one
        refs = materialise(_counted(postings), "line-refs")
        shards = max(SHARDS, refs.count() // SHARD_KEYS)
        none = docs.sparkSession.createDataFrame([], FILTERS)
        filters = materialise(updated_filters(none, refs, None, shards), "line-filters")
        return cls(postings, refs, filters, min_chars, shards)

    def _changed(self, postings: DataFrame, touched: DataFrame) -> "LineIndex":
        """The index with these postings, of which only the touched keys' counts may differ."""
        changed = _counted(postings.join(touched, ["k1", "k2"], "left_semi"))
        refs = materialise(self.refs.join(touched, ["k1", "k2"], "left_anti").unionByName(changed), "line-refs")
        come, gone = (a.join(b, ["k1", "k2"], "left_anti") for a, b in ((refs, self.refs), (self.refs, refs)))
        filters = materialise(updated_filters(self.filters, come, gone, self.shards), "line-filters")
        return LineIndex(postings, refs, filters, self.min_chars, self.shards)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "LineIndex":
        """The index with further documents.  New postings of an id replace none: delete it first to change a text."""
        new = _once(postings_of(docs, self.min_chars, id_col, text_col), docs, id_col).join(self.postings, ["k1", "k2", "doc"], "left_anti")
        new = materialise(new.select("k1", "k2", "doc"), "line-postings")
        return self._changed(self.postings.unionByName(new), new.select("k1", "k2").distinct())

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> "LineIndex":
        """The index without these documents: counts fall, and a key's next smallest document becomes its first."""
        gone = ids.select(F.col(id_col).cast("long").alias("doc")).distinct()
        postings = materialise(self.postings.join(gone, "doc", "left_anti").select("k1", "k2", "doc"), "line-postings")
        return self._changed(postings, self.postings.join(gone, "doc", "left_semi").select("k1", "k2").distinct())

    def dropped(self) -> DataFrame:
        """(doc, k1, k2): keys that a document loses, because a smaller one holds them."""
        few = self.refs.count() <= FILTER_KEYS
        rows = _probe(self.postings, self.filters, self.shards) if few else _probe_by_shard(self.postings, self.filters, self.shards)
        return rows.join(self.refs, ["k1", "k2"]).where("doc > first_doc").select("doc", "k1", "k2")


POSTINGS = "k1 long, k2 long, doc long"


def _probe(postings: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows whose key may be shared, by filters that every task has; their size is bounded by FILTER_KEYS."""
    shared = postings.sparkSession.sparkContext.broadcast({r["shard"]: [bytes(b) for b in r["blobs"]] for r in filters.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {s: ShardFilter(b) for s, b in shared.value.items()}
        for batch in batches:
            k1 = batch.column(0).to_numpy()
            keep = np.zeros(len(k1), bool)
            shard = k1 % shards
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for s, f in known.items():
                at = order[edges[s] : edges[s + 1]]
                keep[at] = f.contains(k1[at].view(U))
            yield batch.filter(pa.array(keep))

    return postings.mapInArrow(run, POSTINGS)


def _probe_by_shard(postings: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The same with filters and postings dealt by shard: a task holds one shard's filters at a time."""
    salted = postings.select(_shard(shards), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("array<binary>").alias("blobs"), "k1", "k2", "doc")
    copies = filters.select("shard", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"), "blobs", *[F.lit(None).cast("long").alias(c) for c in ("k1", "k2", "doc")])
    dealt = copies.unionByName(salted).repartition(shuffle_parts(postings.sparkSession, postings), "shard", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, f = None, ShardFilter([])
        for batch in batches:
            shard, blobs = batch.column(0).to_numpy(), batch.column(1)
            heads = np.flatnonzero(~np.asarray(blobs.is_null()))
            edges = np.unique(np.concatenate([[0, len(batch)], heads, np.flatnonzero(np.diff(shard)) + 1]))
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if shard[a] != current:  # a shard's filters come first
                    current, f = shard[a], ShardFilter([])
                if blobs[a].is_valid:
                    f, a = ShardFilter(blobs[a].as_py()), a + 1
                if z > a:
                    part = batch.slice(a, z - a).select([2, 3, 4])
                    yield part.filter(pa.array(f.contains(part.column(0).to_numpy().view(U))))

    ordered = dealt.sortWithinPartitions("shard", F.col("blobs").isNull())
    return ordered.select("shard", "blobs", "k1", "k2", "doc").mapInArrow(run, POSTINGS)


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", index: LineIndex | None = None) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    A line goes if its key (stripped, A-Z in lower case, ``min_chars`` code points
    or more) is also in a document with a smaller id; all occurrences within one
    document share their fate.  Null or empty text is one empty line and stays as
    it is.  Further columns are kept; any named like the three results are replaced.
    """
    index = index or LineIndex.build(docs, min_chars, id_col, text_col)
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    keys = index.dropped().groupBy(F.col("doc").alias("__ml_doc")).agg(F.collect_list("k1").alias("__ml_drop_1"), F.collect_list("k2").alias("__ml_drop_2"))
    joined = docs.join(keys.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col("__ml_doc"), "left")
    columns = docs.columns
    text_at, n = columns.index(text_col), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(text_at))
            for lo, hi, d, o in blocks(data, offsets):
                starts, ends, first, h1, h2, long_enough = line_keys(d, o, min_chars)
                drop_1, drop_2 = (batch.column(n + k).slice(lo, hi - lo) for k in (0, 1))
                size = np.zeros(hi - lo, np.int64)
                size[:] = drop_1.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                row = owner(first)
                where = mix(row.astype(U) + U(1))
                drop_row = mix(np.repeat(np.arange(hi - lo), size).astype(U) + U(1))
                lost = np.sort(mix(drop_1.flatten().to_numpy().view(U) ^ drop_row) + drop_2.flatten().to_numpy().view(U))
                mine = mix(h1 ^ where) + h2
                gone = long_enough & _contains(lost, mine)
                n_dropped = sums(gone, first)
                raw = d.tobytes()
                texts, names = [], batch.column(text_at).slice(lo, hi - lo)
                for k, null in enumerate(names.is_null().to_pylist()):
                    if not n_dropped[k]:
                        texts.append(None if null else raw[o[k] : o[k + 1]])
                    else:
                        a, b = first[k], first[k + 1]
                        texts.append(b"\n".join(raw[s:e] for s, e, g in zip(starts[a:b].tolist(), ends[a:b].tolist(), gone[a:b].tolist()) if not g))
                arrays = [batch.column(k).slice(lo, hi - lo) for k in range(n)]
                arrays += [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.diff(first)), pa.array(n_dropped)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "kept_text", "n_lines", "n_dropped"])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("kept_text", StringType()).add("n_lines", LongType()).add("n_dropped", LongType())
    return joined.select(*columns, "__ml_drop_1", "__ml_drop_2").mapInArrow(run, schema)


def _contains(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values

