"""Token-id output with Re-Pair grammar compression.

Documents are encoded in ascending order of their ids and written as shards.  A
shard holds a grammar: pairs of symbols that occur often are replaced by
nonterminals, again and again, until no pair occurs often enough to pay for its rule.
Each rule is stored with the length of its expansion, so any range of ids is decoded
by expanding only the symbols that cover it (``fetch_documents``).

A rule takes two symbols and a length of four bytes, so it pays from five
occurrences on with symbols of two bytes and from four on with those of four.
Symbols have two bytes where the vocabulary is below 2**16; a shard then has room
for 2**16 less the vocabulary rules, and makes those of the most frequent pairs.

Shard layout (little-endian): magic ``RPG1``; u32 first nonterminal, rules,
symbols, documents; u64 ids; u8 symbol width, 3 bytes of zero; then the arrays
rule left, rule right (symbol width), expansion length (u32), symbols (symbol
width), ids of each document (u64), document ids (i64), nulls (u8: 1 where the
document id is null).

Shards are rows of a Parquet data set (part, number, start, payload); ``start`` is
the place of the shard's first id within its part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .encoding import unit_encoder
from .storage import scratch_path, shuffle_parts
from .textarrays import blocks, mix, text_buffers

MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIIQB3x")
SHARD_IDS = 1 << 19
#: Occurrences from which a rule pays, by bytes of a symbol.
PAYS = {2: 5, 4: 4}
#: A round that adds fewer than one in so many rules is the last at its count, and a round takes pairs down to one in SPAN of the most frequent.
FEW, SPAN = 50, 6
#: Symbols of two bytes where the vocabulary leaves room for this many rules.
NARROW = 1 << 16
SHARD_SCHEMA = "part int, number int, start long, n_docs int, n_ids long, payload binary"
U = np.uint64


class Grammar:
    """Symbols below ``base`` are ids; symbol ``base + k`` stands for ``left[k] right[k]``."""

    def __init__(self, base: int, left: np.ndarray, right: np.ndarray, symbols: np.ndarray):
        self.base, self.left, self.right, self.symbols = base, left, right, symbols
        self.lengths = np.ones(len(left), np.int64)
        for k in range(len(left)):  # rules only use earlier symbols
            self.lengths[k] = self.size_of(int(left[k])) + self.size_of(int(right[k]))

    def size_of(self, symbol: int) -> int:
        return 1 if symbol < self.base else int(self.lengths[symbol - self.base])

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a run of symbols: the expansions of the rules it uses, copied side by side."""
        rules = np.unique(symbols[symbols >= self.base]) - self.base
        needed, todo = np.zeros(len(self.left), bool), rules
        while len(todo):
            needed[todo] = True
            parts = np.concatenate([self.left[todo], self.right[todo]])
            todo = np.unique(parts[parts >= self.base]) - self.base
            todo = todo[~needed[todo]]
        start = np.cumsum(np.where(needed, self.lengths, 0)) - np.where(needed, self.lengths, 0)
        table = np.zeros(int(self.lengths[needed].sum()), np.uint32)
        base, left, right, at, lengths = self.base, self.left.tolist(), self.right.tolist(), start.tolist(), self.lengths.tolist()
        for k in np.flatnonzero(needed).tolist():  # rules only use earlier ones
            place = at[k]
            for part in (left[k], right[k]):
                if part < base:
                    table[place] = part
                    place += 1
                else:
                    n, source = lengths[part - base], at[part - base]
                    table[place : place + n] = table[source : source + n]
                    place += n
        sizes = self.sizes(symbols)
        ends = np.cumsum(sizes)
        out = np.repeat(symbols.astype(np.uint32), sizes)
        inside = out >= base
        origin = np.zeros(len(symbols), np.int64)
        rule = symbols >= base
        origin[rule] = start[symbols[rule] - base] - (ends[rule] - sizes[rule])
        out[inside] = table[(np.repeat(origin, sizes) + np.arange(len(out)))[inside]]
        return out

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start:stop``, expanding only the symbols that cover them."""
        if start == 0 and stop is None:
            return self.expand(self.symbols)
        ends = np.cumsum(self.sizes(self.symbols))
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a : b + 1])[start - before : stop - before]


def _merge(places: np.ndarray, rank: np.ndarray, worst: int) -> np.ndarray:
    """Which places' pairs are replaced: of overlapping pairs the better ranked, of equal ones the first.

    ``places`` ascend; pairs overlap where places are neighbours.  ``worst`` is above
    all ranks.
    """
    n = len(places)
    if not n:
        return places
    touch = np.diff(places) == 1
    begin = np.append(True, ~touch | (rank[1:] != rank[:-1]))  # else a run of one symbol, whose every other pair counts
    rank = np.where((places - np.maximum.accumulate(np.where(begin, places, 0))) % 2 == 0, rank, worst)
    before, after, found = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    for _ in range(3):
        before[0] = after[-1] = worst
        before[1:], after[:-1] = np.where(touch, rank[:-1], worst), np.where(touch, rank[1:], worst)
        at = (rank < worst) & (rank < before) & (rank <= after)
        if not at.any():
            break
        found |= at
        rank[at] = worst
        rank[:-1][at[1:] & touch] = worst
        rank[1:][at[:-1] & touch] = worst
    return np.flatnonzero(found)


def _frequent(symbols: np.ndarray, floor: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of the pairs at least a sixth as frequent as the most frequent one; the pairs, how often they occur, and the least count.

    Counts in hashed bins are never below the true ones, so the places of rare bins
    are passed over before the exact count.  The least count is ``most`` at most.
    """
    a, b = symbols[:-1], symbols[1:]
    bins = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(14)).astype(np.int64)
    tally = np.bincount(bins, minlength=1 << 18)
    least = min(int(tally.max()) // SPAN, most)
    while True:
        least = max(floor, least)
        places = np.flatnonzero((tally >= least)[bins])
        pair, count = np.unique((a[places].astype(U) << U(32)) | b[places], return_counts=True)
        if least == floor or (count >= least).any():
            return places, pair[count >= least], count[count >= least], least
        least //= 2


def compress(ids: np.ndarray, base: int, min_count: int = PAYS[2], limit: int | None = None) -> Grammar:
    """Re-Pair in rounds, each of which replaces all of the most frequent pairs, until no pair occurs ``min_count`` times."""
    symbols = ids.astype(np.uint32)
    limit = limit or max(NARROW, base + len(ids))
    rules: list[np.ndarray] = []
    known, names, nxt = np.zeros(0, U), np.zeros(0, np.uint32), base
    most = len(ids)
    while len(symbols) > 1 and nxt < limit:
        places, pairs, count, least = _frequent(symbols, min_count, most)
        if not len(pairs):
            break
        rank_of = np.empty(len(pairs), np.int64)
        rank_of[np.lexsort((mix(pairs), -count))] = np.arange(len(pairs))
        at_place = (symbols[places].astype(U) << U(32)) | symbols[places + 1]
        at = np.minimum(np.searchsorted(pairs, at_place), len(pairs) - 1)
        real = pairs[at] == at_place
        places, at_place, at = places[real], at_place[real], at[real]
        some = _merge(places, rank_of[at], len(pairs))
        chosen = places[some]
        used, inverse, times = np.unique(at_place[some], return_inverse=True, return_counts=True)
        name, old = np.zeros(len(used), np.uint32), np.zeros(len(used), bool)
        if len(known):
            place = np.minimum(np.searchsorted(known, used), len(known) - 1)
            old = known[place] == used
            name[old] = names[place[old]]
        new = np.flatnonzero(~old & (times >= min_count))[: limit - nxt]
        worth = old.copy()
        worth[new] = True
        if not worth.any():  # overlapping pairs that occur less often than it seemed
            if least == min_count:
                break
            most = least // 2
            continue
        name[new] = nxt + np.arange(len(new))
        nxt += len(new)
        if len(new) * FEW < nxt - base:  # what is left at this count overlaps: it goes with the pairs of the next one
            most = max(min_count, least - 1)
        rules.append(used[new])
        order = np.argsort(np.concatenate([known, used[new]]))
        known, names = np.concatenate([known, used[new]])[order], np.concatenate([names, name[new]])[order]
        kept = worth[inverse]
        symbols[chosen[kept]] = name[inverse[kept]]
        stay = np.ones(len(symbols), bool)
        stay[chosen[kept] + 1] = False
        symbols = symbols[stay]
    pairs = np.concatenate(rules or [np.zeros(0, U)])
    return Grammar(base, (pairs >> U(32)).astype(np.int64), (pairs & U(0xFFFFFFFF)).astype(np.int64), symbols.astype(np.int64))


def pack_shard(ids: np.ndarray, sizes: np.ndarray, docs: list[int | None], base: int) -> bytes:
    narrow = base < NARROW
    grammar = compress(ids, base, PAYS[2 if narrow else 4], NARROW if narrow else None)
    width = "<u2" if narrow else "<u4"
    head = _HEAD.pack(MAGIC, base, len(grammar.left), len(grammar.symbols), len(docs), len(ids), 2 if narrow else 4)
    arrays = [grammar.left.astype(width), grammar.right.astype(width), grammar.lengths.astype("<u4"), grammar.symbols.astype(width), sizes.astype("<u8"), np.array([0 if d is None else d for d in docs], "<i8"), np.array([d is None for d in docs], np.uint8)]
    return head + b"".join(a.tobytes() for a in arrays)


def unpack_shard(payload: bytes) -> tuple[Grammar, np.ndarray, list[int | None]]:
    """Grammar, ids of each document, document ids."""
    magic, base, rules, symbols, docs, _, width = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    kind, at, got = f"<u{width}", _HEAD.size, []
    for dtype, n in ((kind, rules), (kind, rules), ("<u4", rules), (kind, symbols), ("<u8", docs), ("<i8", docs), ("u1", docs)):
        got.append(np.frombuffer(payload, dtype, n, at))
        at += got[-1].nbytes
    grammar = Grammar.__new__(Grammar)
    grammar.base, grammar.left, grammar.right, grammar.lengths, grammar.symbols = base, got[0].astype(np.int64), got[1].astype(np.int64), got[2].astype(np.int64), got[3].astype(np.int64)
    return grammar, got[4].astype(np.int64), [None if null else d for d, null in zip(got[5].tolist(), got[6].tolist())]


def write_shards(docs: DataFrame, path: str, tokenizer: str, mode: str = "byte", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Writes all documents in ascending id order (nulls first, equal ids by text) to ``path``.

    Null or empty text is the end id alone.  A document longer than a shard has a
    shard to itself.  Further columns are not read.  An empty table writes an
    empty data set.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(shuffle_parts(docs.sparkSession, docs), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(tokenizer, mode)
        base = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        part, number, start = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        sizes: list[int] = []
        names: list[int | None] = []

        def shard() -> pa.RecordBatch:
            nonlocal number, start
            ids = np.concatenate(held)
            row = [part, number, start, len(names), len(ids), pack_shard(ids, np.array(sizes), names, base)]
            number, start = number + 1, start + len(ids)
            held.clear(), sizes.clear(), names.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=[x.split()[0] for x in SHARD_SCHEMA.split(", ")])

        end, waiting = np.array([end_id], np.uint32), 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            docs_here = batch.column(0).to_pylist()
            for lo, hi, d, o in blocks(data, offsets):
                ids, count = encoder.encode(d, o)
                at = 0
                for k, n in enumerate(count.tolist()):
                    if waiting and waiting + n + 1 > shard_ids:
                        yield shard()
                        waiting = 0
                    held += [ids[at : at + n], end]
                    sizes.append(n + 1)
                    names.append(docs_here[lo + k])
                    waiting, at = waiting + n + 1, at + n
        if names:
            yield shard()

    rows.mapInArrow(run, SHARD_SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the data set.

    ``start`` counts the ids of all documents before it.  One number for each part
    comes to the driver to make the parts' prefix sums; parts are as many as the
    partitions that wrote them.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    base, place = {}, 0
    for row in sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["part"]):
        base[row["part"]] = place
        place += row["n"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                grammar, sizes, names = unpack_shard(payload.as_py())
                ids = grammar.decode().astype("<u4")
                begin = np.cumsum(sizes) - sizes
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(begin.tolist(), sizes.tolist())]
                arrays = [pa.array(names, pa.int64()), pa.array(base[part] + start + begin), pa.array(sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.array([ids[a : a + n].astype(np.int32) for a, n in zip(begin.tolist(), sizes.tolist())], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    return shards.select("part", "start", "payload").mapInArrow(run, schema)


def fetch_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents asked for: only the symbols that cover them are expanded.

    The list is a query, so it is sent to all tasks.  An id that several documents
    have gives a row for each, one that none has gives no row.
    """
    wanted = set(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                grammar, sizes, names = unpack_shard(payload.as_py())
                ends = np.cumsum(sizes)
                for k, name in enumerate(names):
                    if name in wanted:
                        found = grammar.decode(int(ends[k] - sizes[k]), int(ends[k])).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([found], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spark.read.schema(SHARD_SCHEMA).parquet(path).select("payload").mapInArrow(run, "doc_id long, ids array<int>")


def encode_and_read(docs: DataFrame, tokenizer: str, mode: str = "byte", end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    path = scratch_path(spark, "token-shards")
    write_shards(docs, path, tokenizer, mode, end_id)
    return read_documents(spark, path)
