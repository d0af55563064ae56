"""The best targets of each record by character n-grams, for texts that differ mostly in their numbers.

The n-grams without a digit depend only on a text's pattern (the text with 0 for each
number).  Their product is formed once for two patterns; with the lengths of the rest
it bounds the score of all texts of the patterns.  A block of records of one pattern
gets the targets of those patterns whose bound reaches a score that k targets surely
have, and leaves a pattern out once the k best found are above its bound.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import blocking as bl, vectors as vx
from ..sources.sinks import scratch

#: Records of a pattern in one block, scores held at a time, grams multiplied as dense columns, and pairs of patterns that are planned on the driver.
PACK, STEP, DENSE, PAIRS = 1 << 13, 1 << 18, 512, 1 << 21
#: Texts of like numbers, and blocks of targets of a pattern taken together.
CELL, MOST = 128, 16
NINE, SHIFT, NUMBER = 1e9, 32, re.compile("[0-9]+")


def gram_keys(texts: list[str], low: int, high: int, alphabet: np.ndarray, digits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count) of the n-grams with a digit, or of those without; a gram is a number over the sorted ``alphabet``."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    text, last = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size)
    before = np.concatenate([[0], np.cumsum((chars >= 48) & (chars <= 57))])
    code, base = np.searchsorted(alphabet, chars).astype(np.uint64) + np.uint64(1), len(alphabet) + 1
    base = np.uint64(base if base ** high < 1 << 64 else 0x9E3779B97F4A7C15)  # a hash where the numbers are too large
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in range(low, high + 1):
        start = np.flatnonzero(np.arange(len(chars)) + n <= last)
        start = start[(before[start + n] > before[start]) == digits]
        key = np.zeros(len(start), np.uint64)
        for j in range(n):
            key = key * base + code[start + j]
        rows.append(text[start])
        keys.append(key)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], key[new], np.diff(np.append(new, len(row)))


def squares(grams: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    return np.bincount(grams[0], grams[2].astype(float) ** 2, n)


def letters(texts) -> np.ndarray:
    return np.unique(np.frombuffer(("".join(texts) + "0123456789").encode("utf-32-le"), np.uint32))


def bound(common, own, rest, other, low, high):
    """The most that a score can be: the patterns' product, the squared lengths (own pattern, rest) and (other pattern, rest from low to high)."""
    x, low, high = np.sqrt(rest), np.sqrt(low), np.sqrt(high)
    with np.errstate(divide="ignore", invalid="ignore"):
        y = np.clip(np.where(common > 0, x * other / common, high), low, high)  # the score rises up to here and then falls
        return np.nan_to_num((common + x * y) / np.sqrt((own + rest) * (other + y * y)))


def gram_top_k(s1: DataFrame, targets: DataFrame, text: str, k: int, low: int = 2, high: int = 4, descending_id: bool = False, wanted: DataFrame | None = None, group: str = "country") -> DataFrame:
    """(s1, tgt, rank) of ``blocking.text_top_k`` with the counts of character n-grams; exact for any texts.

    Records have entity_id (unique), the group and the text.  With ``wanted`` (s1, tgt)
    only those pairs come out.  Where the patterns are too many to plan (nearly as many
    as texts), all pairs of texts are multiplied.
    """
    spark = s1.sparkSession
    side = lambda df, *more: df.select(F.col("entity_id").alias("id"), F.col(group).alias("g"), F.col(text).alias("text"), F.regexp_replace(text, "[0-9]+", "0").alias("pattern"), *more).where(F.col("g").isNotNull() & (F.length("text") >= low))
    if wanted is not None:
        s1 = s1.join(wanted.groupBy(F.col("s1").alias("entity_id")).agg(F.collect_set("tgt").alias("wanted")), "entity_id")
    sides = side(s1, *(["wanted"] if wanted is not None else [])), side(targets)
    known = [df.groupBy("g", "pattern").agg(F.count("*").alias("n")).limit(PAIRS // 16 + 1).toPandas() for df in sides]
    per = [x.groupby("g").size() for x in known]
    if (per[0] * per[1]).sum() > PAIRS or max(map(len, known)) > PAIRS // 16:
        return bl.text_top_k(s1, targets, text, lambda c: vx.char_grams(c, low, high), k, descending_id, group=group, pairs=wanted).select("s1", "tgt", "rank")
    packs = [_packs(df, x, low, high) for df, x in zip(sides, known)]
    plan = _plan(known, packs, k, low, high)
    pairs = F.broadcast(spark.createDataFrame(plan))
    left, right = packs
    chunks = left.select(F.col("pid").alias("q"), F.col("chunk").alias("c"))
    right = right.drop("chunk").join(pairs, "pid").join(F.broadcast(chunks), "q")
    parts = max(1, min(4 * spark.sparkContext.defaultParallelism, left.count()))
    left = left.withColumnsRenamed({"pid": "q", "chunk": "c"}).repartition(parts, "q", "c")
    right = right.repartition(parts, "q", "c")
    kinds = dict(s1.dtypes)["entity_id"], dict(targets.dtypes)["entity_id"]
    search = partial(_search, k=k, low=low, high=high, descending=descending_id)
    return left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(lambda x, y: search(x, y), f"s1 {kinds[0]}, tgt {kinds[1]}, rank int")


def _packs(df: DataFrame, known, low: int, high: int) -> DataFrame:
    """The records as one row for each block of a pattern (pid), with the least and the largest squared length of the numbers' grams."""
    patterns = known.assign(pid=np.arange(len(known)), chunks=-(-known["n"] // PACK))[["g", "pattern", "pid", "chunks"]]
    rows = df.join(F.broadcast(df.sparkSession.createDataFrame(patterns, "g string, pattern string, pid long, chunks long")), ["g", "pattern"])
    fields = [c for c in ("id", "text", "wanted") if c in df.columns]
    listed = rows.groupBy("pid", F.pmod(F.xxhash64("text"), "chunks").alias("chunk")).agg(F.first("pattern").alias("pattern"), F.collect_list(F.struct(*fields)).alias("l")).select("pid", "chunk", "pattern", *[F.col(f"l.{c}").alias(c) for c in fields])

    def measure(batches):
        for batch in batches:
            lows, highs = [], []
            for texts in batch["text"]:
                texts = pc.unique(texts.values).to_pylist()
                found = squares(gram_keys(texts, low, high, letters(texts), True), len(texts))
                lows.append(found.min())
                highs.append(found.max())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lows, pa.float64()), pa.array(highs, pa.float64())], [*batch.schema.names, "low", "high"])

    schema = ", ".join(f"{c} {t}" for c, t in listed.dtypes) + ", low double, high double"
    return scratch(listed.mapInArrow(measure, schema), "packs")


def _plan(known: list, packs: list[DataFrame], k: int, low: int, high: int):
    """(q, pid, common, own, other): the patterns of targets that can hold one of the k best of a pattern of records."""
    import pandas as pd

    ranges = [df.groupBy("pid").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().set_index("pid") for df in packs]
    sides = [x.assign(pid=np.arange(len(x))).join(r, "pid") for x, r in zip(known, ranges)]
    found = [pd.DataFrame({"q": np.zeros(0, int), "pid": np.zeros(0, int), "common": np.zeros(0), "own": np.zeros(0), "other": np.zeros(0)})]
    for g, mine in sides[0].groupby("g"):
        theirs = sides[1][sides[1]["g"] == g]
        if not len(theirs):
            continue
        alphabet = letters([*mine["pattern"], *theirs["pattern"]])
        grams_y = gram_keys(list(theirs["pattern"]), low, high, alphabet, False)
        other, n, least, most = squares(grams_y, len(theirs)), theirs["n"].to_numpy(), theirs["low"].to_numpy(), theirs["high"].to_numpy()
        for lo in range(0, len(mine), 256):
            part = mine.iloc[lo : lo + 256]
            grams_x = gram_keys(list(part["pattern"]), low, high, alphabet, False)
            table, own = bl._products((grams_x[0], grams_x[1].view(np.int64), grams_x[2]), (grams_y[0], grams_y[1].view(np.int64), grams_y[2]), len(part), len(theirs)), squares(grams_x, len(part))
            for i, (q, a, z) in enumerate(zip(part["pid"], part["low"], part["high"])):
                common = np.rint(table[i])
                needed = np.zeros(len(theirs), bool)
                # Squared lengths are whole numbers; where they are many, a range of them has the surest and the highest of its ends.
                edges = np.unique(np.rint(np.linspace(a, z, min(int(z - a) + 1, 64))))
                for u, v in zip(edges, np.append(edges[1:] - 1, edges[-1])):
                    sure = common / np.sqrt(np.maximum((own[i] + v) * (other + most), 1e-300))
                    order = np.argsort(-sure)
                    at = np.searchsorted(np.cumsum(n[order]), k)
                    floor = sure[order[at]] if at < len(order) else 0.0
                    top = bound(common, own[i], u, other, least, most) if u == v else np.minimum(1, (common + np.sqrt(v * most)) / np.sqrt(np.maximum((own[i] + u) * (other + least), 1e-300)))
                    needed |= (top > 0) & (top >= floor - 1e-8)
                j = np.flatnonzero(needed)
                found.append(pd.DataFrame({"q": q, "pid": theirs["pid"].to_numpy()[j], "common": common[j], "own": own[i], "other": other[j]}))
    return pd.concat(found).astype({"q": "int64", "pid": "int64"}) if len(found) > 1 else found[0]


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """An order of the texts that brings like numbers together, and where its parts of about CELL texts begin (and the last ends)."""
    keys = np.array([max(NUMBER.findall(t), key=len, default="")[:-2] for t in texts], "U")
    order = np.lexsort((np.array(texts, "U"), keys))
    keys = keys[order]
    begin = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    cuts = [0]
    for a, z in zip(begin[:-1], begin[1:]):
        if z - cuts[-1] > CELL and a > cuts[-1]:
            cuts.append(a)
        cuts += range(cuts[-1] + CELL, z - CELL // 4, CELL)
    return order, np.array([*cuts, len(keys)])


class _Rest:
    """Products of the numbers' grams of texts with those of the cells of other texts."""

    def __init__(self, x, y, n: int, cuts: np.ndarray):
        m, self.cuts, n_cells = int(cuts[-1]), cuts, len(cuts) - 1
        grams = np.unique(x[1])
        place = np.minimum(np.searchsorted(grams, y[1]), max(len(grams) - 1, 0))
        shared = grams[place] == y[1] if len(grams) else np.zeros(len(place), bool)
        rows_y, gram_y, n_y, gram_x = y[0][shared], place[shared], y[2][shared], np.searchsorted(grams, x[1])
        cost = np.bincount(gram_x, minlength=len(grams)) * np.bincount(gram_y, minlength=len(grams))
        heavy = np.argsort(-cost, kind="stable")[:DENSE]
        heavy = heavy[cost[heavy] > n * m / 128]
        column = np.full(len(grams), -1)
        column[heavy] = np.arange(len(heavy))
        self.left, self.right = np.zeros((n, len(heavy)), np.float32), np.zeros((m, len(heavy)), np.float32)
        for dense, row, gram, w in ((self.left, x[0], gram_x, x[2]), (self.right, rows_y, gram_y, n_y)):
            on = column[gram] >= 0
            dense[row[on], column[gram[on]]] = w[on]
        cell = np.searchsorted(cuts, rows_y, "right") - 1
        most = np.zeros((len(grams), n_cells), np.float32)
        np.maximum.at(most, (gram_y, cell), n_y.astype(np.float32))
        begin = np.searchsorted(x[0], np.arange(n + 1))
        self.most = np.zeros((n, n_cells))
        for lo in range(0, n, 1024):
            hi = min(n, lo + 1024)
            a, z = begin[lo], begin[hi]
            full = np.flatnonzero(begin[lo + 1 : hi + 1] > begin[lo:hi])
            if len(full):
                self.most[lo + full] = np.add.reduceat(most[gram_x[a:z]] * x[2][a:z, None].astype(np.float32), begin[lo + full] - a, axis=0)
        light = (column[gram_x] < 0) & (np.bincount(gram_y, minlength=len(grams))[gram_x] > 0)
        self.rows, self.grams, self.n, self.kinds = x[0][light], gram_x[light], x[2][light], len(grams)
        at = cell * len(grams) + gram_y
        order = np.argsort(at, kind="stable")
        self.to, self.w = (rows_y - cuts[cell])[order], n_y[order]
        self.count = np.bincount(at, minlength=n_cells * len(grams))
        self.first = np.cumsum(self.count) - self.count

    def of(self, rows: np.ndarray, cell: int) -> np.ndarray:
        """A table of the rows (ascending) and all texts of the cell."""
        lo, hi = self.cuts[cell : cell + 2]
        out = (self.left[rows] @ self.right[lo:hi].T).astype(float)
        a, z = np.searchsorted(self.rows, rows), np.searchsorted(self.rows, rows, "right")
        at = np.repeat(a - (np.cumsum(z - a) - (z - a)), z - a) + np.arange((z - a).sum())
        gram = self.grams[at] + cell * self.kinds
        size = self.count[gram]
        to = np.arange(size.sum()) + np.repeat(self.first[gram] - (np.cumsum(size) - size), size)
        if len(to):
            row = np.repeat(np.arange(len(rows)), z - a) * (hi - lo)
            out += np.bincount(np.repeat(row, size) + self.to[to], np.repeat(self.n[at], size) * self.w[to], out.size).reshape(out.shape)
        return out


def _search(x: pa.Table, y: pa.Table, k: int, low: int, high: int, descending: bool) -> pa.Table:
    """The k best of a block of records of one pattern, from the blocks of targets that the plan names."""
    flat = lambda t, c: t.column(c).combine_chunks().flatten()
    ids = flat(y, "id") if y.num_rows else pa.array([])
    if not x.num_rows or not len(ids):
        return pa.table({"s1": flat(x, "id")[:0] if x.num_rows else pa.array([], pa.string()), "tgt": ids[:0].cast(pa.string()) if not y.num_rows else ids[:0], "rank": pa.array([], pa.int32())})
    names, texts = flat(x, "id"), flat(x, "text").dictionary_encode()
    row_of, texts = texts.indices.to_numpy(), texts.dictionary.to_pylist()
    sort = pc.sort_indices(ids).to_numpy()[:: 1 if descending else -1]  # the last is the best of equal ones
    order = np.empty(len(ids), np.int64)
    order[sort] = np.arange(len(ids))
    alphabet = letters([*x.column("pattern").to_pylist(), *y.column("pattern").unique().to_pylist()])
    grams = gram_keys(texts, low, high, alphabet, True)
    rest = squares(grams, len(texts))
    of = {c: y.column(c).to_numpy() for c in ("pid", "common", "own", "other", "low", "high")}
    size = pc.list_value_length(y.column("id").combine_chunks()).to_numpy()
    start, words = np.cumsum(size) - size, flat(y, "text")
    groups = [p[lo : lo + MOST] for p in (np.flatnonzero(of["pid"] == pid) for pid in np.unique(of["pid"])) for lo in range(0, len(p), MOST)]
    tops = [bound(of["common"][p[0]], of["own"][p[0]], rest, of["other"][p[0]], of["low"][p].min(), of["high"][p].max()) for p in groups]
    best = np.full((len(texts), k), -1, np.int64)
    for g in np.argsort([-t.max() for t in tops], kind="stable"):
        rows = np.flatnonzero(np.floor(tops[g] * NINE) + 2 >= best.min(1) >> SHIFT)
        if len(rows):
            p = groups[g]
            at = np.concatenate([np.arange(start[i], start[i] + size[i]) for i in p])
            _meet(best, tops[g], texts, grams, of["own"][p[0]] + rest, of["common"][p[0]], of["other"][p[0]], words.take(pa.array(at)), order[at], len(sort), k, low, high, alphabet)
    best = -np.sort(-best, axis=1)
    if "wanted" in x.column_names:
        listed = x.column("wanted").combine_chunks().flatten()
        record = np.repeat(np.arange(len(names)), pc.list_value_length(listed).to_numpy())
        at = pc.index_in(listed.flatten(), value_set=ids)
        there = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        record, place = record[there], at.take(pa.array(there)).to_numpy().astype(np.int64)
        found = np.where(best >= 0, best & ((1 << SHIFT) - 1), -1)[row_of[record]] == order[place][:, None]
        hit = np.flatnonzero(found.any(1))
        return pa.table({"s1": names.take(pa.array(record[hit])), "tgt": ids.take(pa.array(place[hit])), "rank": pa.array(found[hit].argmax(1).astype(np.int32))})
    record, rank = np.nonzero(best[row_of] >= 0)
    return pa.table({"s1": names.take(pa.array(record)), "tgt": ids.take(pa.array(sort[best[row_of[record], rank] & ((1 << SHIFT) - 1)])), "rank": pa.array(rank.astype(np.int32))})


def _meet(best, top, texts, grams, length, common, other, words, order, n_order, k, low, high, alphabet) -> None:
    """Brings the best targets of a pattern into ``best``: score at nine decimals, then the place of the id.

    A text meets first the cell of targets that promises most, then those that can
    still have a better score.
    """
    words = words.dictionary_encode()
    code, found = words.indices.to_numpy(), words.dictionary.to_pylist()
    by_cell, cuts = cells(found)
    found, m = [found[i] for i in by_cell], len(found)
    place = np.empty(m, np.int64)
    place[by_cell] = np.arange(m)
    code = place[code]
    by = np.lexsort((-order, code))
    count = np.bincount(code, minlength=m)
    first = np.cumsum(count) - count
    members, leader = order[by], order[by[first]]
    text_at = np.zeros(n_order if count.max() > 1 else 0, np.int32)
    if count.max() > 1:
        text_at[leader] = np.arange(m)
    grams_y = gram_keys(found, low, high, alphabet, True)
    rest, size = _Rest(grams, grams_y, len(texts), cuts), other + squares(grams_y, m)
    inverse, own = 1 / np.sqrt(size), NINE / np.sqrt(length)
    promise = np.minimum((common + rest.most) * own[:, None] * np.maximum.reduceat(inverse, cuts[:-1]), top[:, None] * NINE)
    promise = np.where(common + rest.most > 0, np.floor(promise) + 2, -2)  # no common gram: no score
    leading = promise.argmax(1)

    def meet(rows: np.ndarray, c: int) -> None:
        lo, hi = cuts[c : c + 2]
        for some in (rows[i : i + STEP // (hi - lo)] for i in range(0, len(rows), STEP // (hi - lo))):
            score = rest.of(some, c)
            score += common
            score *= own[some][:, None]
            score *= inverse[lo:hi]
            key = np.rint(score, out=score).astype(np.int64) << SHIFT
            key |= leader[lo:hi]
            if not common:
                key[score <= 0] = -1
            if hi - lo > k:
                key = np.partition(key, hi - lo - k, axis=1)[:, hi - lo - k :]
            if count[lo:hi].max() > 1:
                key = _members(key, text_at, np.minimum(count, k), first, members)
            both = np.concatenate([best[some], key], axis=1)
            best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]

    for again in (False, True):
        for c in range(len(cuts) - 1):
            rows = np.flatnonzero(((leading == c) != again) & (promise[:, c] >= np.maximum(best.min(1) >> SHIFT, -1)))
            if len(rows):
                meet(rows, c)


def _members(key: np.ndarray, text_at: np.ndarray, count: np.ndarray, first: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Each text's place as those of its best records; rows are filled up with -1."""
    n, (row, column) = len(key), np.nonzero(key >= 0)
    key = key[row, column]
    text = text_at[key & ((1 << SHIFT) - 1)]
    size = count[text]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    row, place = np.repeat(row, size), members[np.repeat(first[text], size) + inner]
    width = np.bincount(row)
    out = np.full((n, width.max() if len(row) else 0), -1, np.int64)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)] = np.repeat(key >> SHIFT, size) << SHIFT | place
    return out
