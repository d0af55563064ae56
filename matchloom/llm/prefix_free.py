"""Suffix-array dedup by prefix-free parsing.

Removes every byte covered by a string of ``length`` bytes that also starts
somewhere else in the corpus.

1. Triggers.  Each window of ``length`` bytes has one trigger: the rolling hash of
   ``WIDTH`` bytes that is smallest in it.  The windows of one trigger make a phrase,
   the text that they cover.  Both depend on the windows' own bytes only, so equal
   windows anywhere lie in phrases with equal trigger strings.
2. Dictionary.  Phrases are dealt by their trigger string.  Phrases that occur
   twice are removed whole, those whose trigger string is nowhere else are kept
   whole.  What remains are the ends of repeated passages: phrases that differ but
   share a trigger string.
3. Suffix order.  The texts of these phrases are parsed once more, with finer
   triggers, into a dictionary and a parse.  The suffix array of the dictionary and
   the suffix array of the parse together give the order of all suffixes, in which
   windows that are equal stand next to each other.

A trigger string with very many different phrases (a common line) is not gathered
in a task: hashes of its windows are dealt by themselves, each once a task.  So no
task holds more than a bounded number of phrases of one trigger string.

Windows in suffix order are compared by their bytes.  Whole phrases count as equal by
128 bits of hashes (of the trigger string and of the phrase), windows of hot trigger
strings by two hashes of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import bucket_keys, discard, materialise, release, shuffle_parts
from .textarrays import BYTE_VALUES, BYTE_VALUES_2, blocks, mix, owner, prefix_hashes, span_hashes, text_buffers

LENGTH = 200
WIDTH = 64
#: Different phrases of one trigger string beyond which its windows are dealt by themselves: within a task's flush, and in a bucket.
LOCAL_HOT = 64
HOT = 4096
FLUSH = 1 << 18
CHUNK = 1 << 20  # bytes of phrases ordered at a time
U = np.uint64

_TRIGGER = np.dtype([("h", "<u8"), ("e", "<u8"), ("row", "<u8"), ("pos", "<u4"), ("twice", "u1")])
_WINDOW = np.dtype([("w", "<u8"), ("v", "<u8"), ("row", "<u8"), ("pos", "<u4"), ("known", "u1")])
ROWS = "bucket int, kind int, payload binary, row long, pos long, stop long"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
BY_TRIGGER, BY_PHRASE, BEACON, FULL, ASK, ASK_HOT, RUN, PHRASES, WINDOWS = range(9)


def minima(values: np.ndarray, span: int) -> np.ndarray:
    """Smallest value of each ``span`` consecutive ones."""
    n = len(values)
    if n < span:
        return values[:0]
    padded = np.full(-(-n // span) * span, np.iinfo(U).max, U)
    padded[:n] = values
    table = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - span + 1], ahead[span - 1 : n])


def triggers(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, width: int = WIDTH):
    """(text, first window, last window, trigger place, trigger hash, phrase hash) of all phrases of a block."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(U), none.astype(U)
    c = prefix_hashes(BYTE_VALUES[data])
    place = np.arange(n - width + 1)
    hashes = span_hashes(c, place, place + width)
    bits = U(max(24, int(n).bit_length()))
    low = minima((hashes >> bits << bits) | (n - place).astype(U), length - width + 1)  # of equal ones the last
    at = n - (low & ((U(1) << bits) - U(1))).astype(np.int64)
    size = np.maximum(np.diff(offsets) - length + 1, 0)
    rows = np.repeat(np.arange(len(size)), size)
    p = np.repeat(offsets[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    m = at[p]
    new = np.append(True, (m[1:] != m[:-1]) | (rows[1:] != rows[:-1])) if len(p) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(p)) - 1
    a, b, t = p[begin], p[end], m[begin] if len(p) else none
    phrase = mix(span_hashes(c, a, b + length) + (t - a).astype(U) * U(0x9E3779B97F4A7C15))
    return rows[begin], a, b, t, hashes[t], phrase


def suffix_ranks(symbols: np.ndarray, depth: int, stop: np.ndarray | None = None) -> np.ndarray:
    """Rank of each suffix among all, by its first ``depth`` symbols or more (prefix doubling).

    A suffix ends where ``stop`` says, or at the end of the symbols.
    """
    n = len(symbols)
    stop = np.full(n, n) if stop is None else stop
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while step < depth and rank.max(initial=0) < n:
        ahead = np.arange(n) + step
        inside = ahead < stop
        key = rank.astype(U) << U(32)
        key[inside] |= rank[ahead[inside]].astype(U)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return rank


def corpus_order(data: np.ndarray, offsets: np.ndarray, depth: int, width: int = 8, modulus: int = 24) -> np.ndarray:
    """All places of the texts in the order of their suffixes (as far as ``depth`` bytes), by prefix-free parsing."""
    n = len(data)
    filled = np.flatnonzero(np.diff(offsets))
    texts, text_ends = offsets[filled], offsets[filled + 1]
    place = np.arange(max(0, n - width + 1))
    found = place[span_hashes(prefix_hashes(BYTE_VALUES[data]), place, place + width) % U(modulus) == 0]
    home = np.searchsorted(texts, found, "right") - 1
    found = found[(found > texts[home]) & (found + width <= text_ends[home])]
    begin = np.union1d(texts, found)
    stop = np.append(begin[1:], n)
    last = np.isin(stop, text_ends)
    # a phrase runs from one trigger to the end of the next, or of its text: no suffix of a phrase that is
    # longer than a trigger is a prefix of another one
    reach = np.where(last, stop, stop + width)
    c = prefix_hashes(BYTE_VALUES[data])
    names, first, parse = np.unique(mix(span_hashes(c, begin, reach) + last.astype(U)), return_index=True, return_inverse=True)
    size = reach[first] - begin[first] + 1
    start = np.cumsum(size) - size
    ramp = np.arange(size.sum()) - np.repeat(start, size)
    dictionary = np.zeros(int(size.sum()), np.int64)  # each phrase and an end mark: 1 before more text, 0 at the end of a text
    inner = ramp < np.repeat(size - 1, size)
    dictionary[inner] = data[(np.repeat(begin[first], size) + ramp)[inner]].astype(np.int64) + 2
    dictionary[start + size - 1] = ~last[first]
    ranks = suffix_ranks(dictionary, int(size.max(initial=1)) + 1, np.repeat(start + size, size))
    phrase_rank = ranks[start]
    # texts end with a mark of their own in the parse, so that nothing is compared across texts
    closing = np.flatnonzero(last)
    text_of = np.searchsorted(texts, begin, "right") - 1
    parsed = np.insert(phrase_rank[parse] + len(offsets), closing + 1, text_of[closing])
    moved = np.arange(len(parse)) + np.cumsum(last) - last
    parse_rank = suffix_ranks(parsed, depth)
    after = np.zeros(len(parse), np.int64)
    after[:] = parse_rank[moved + 1]
    phrase_of = np.repeat(np.arange(len(begin)), stop - begin)
    own = ranks[start[parse][phrase_of] + np.arange(n) - begin[phrase_of]]
    return np.lexsort((after[phrase_of], own))


def repeated_windows(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Marks the places whose ``length`` bytes, within their text, also start elsewhere."""
    order = corpus_order(data, offsets, length)
    order = order[order + length <= offsets[np.searchsorted(offsets, order, "right")]]
    h = span_hashes(prefix_hashes(BYTE_VALUES[data]), order, order + length)
    same = h[1:] == h[:-1]
    alike = np.flatnonzero(same)
    span = np.arange(length)
    for lo in range(0, len(alike), 1 << 12):
        at = alike[lo : lo + (1 << 12)]
        same[at] = (data[order[at][:, None] + span] == data[order[at + 1][:, None] + span]).all(axis=1)
    out = np.zeros(len(data), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _rows(kind: int, row: np.ndarray, pos: np.ndarray, stop: np.ndarray | None = None, keys: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    n = len(row)
    if n:
        bucket = pa.nulls(n, pa.int32()) if keys is None else pa.array(np.array(keys, np.int32)[_bucket(row.astype(U), len(keys))])
        arrays = [bucket, pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.binary()), pa.array(row.astype(U).view(np.int64)), pa.array(pos.astype(np.int64)), pa.nulls(n, pa.int64()) if stop is None else pa.array(stop.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    """A trigger is the smallest hash of its window, so hashes are mixed once more."""
    return ((mix(values) >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _packed(kind: int, items: np.ndarray, by: np.ndarray, keys: list[int]) -> Iterator[pa.RecordBatch]:
    target = _bucket(by, len(keys))
    order = np.argsort(target, kind="stable")
    items, edges = items[order], np.searchsorted(target[order], np.arange(len(keys) + 1))
    yield from _payloads(kind, [(keys[k], items[a:z].tobytes()) for k, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if z > a])


def _payloads(kind: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    if rows:
        arrays = [pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays + [pa.nulls(len(rows), t) for t in _TYPES[3:]], names=_NAMES)


def _scan(keys: list[int], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            items = np.concatenate(held)
            held.clear()
            items = items[np.lexsort((items["e"], items["h"]))]
            new = np.append(True, (items["h"][1:] != items["h"][:-1]) | (items["e"][1:] != items["e"][:-1]))
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(items)))
            whole = np.repeat(count > 1, count)
            yield from _rows(FULL, items["row"][whole], items["pos"][whole], keys=keys)
            one = items[begin]
            one["twice"] = count > 1
            first = np.flatnonzero(np.append(True, one["h"][1:] != one["h"][:-1]))
            several = np.diff(np.append(first, len(one)))
            hot = np.repeat(several > LOCAL_HOT, several)
            yield from _packed(BY_TRIGGER, one[~hot], one["h"][~hot], keys)
            yield from _packed(BY_PHRASE, one[hot], one["e"][hot], keys)
            beacons = one[first[several > LOCAL_HOT]]
            yield from _packed(BEACON, beacons, beacons["h"], keys)

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            names = batch.column(0).to_numpy().view(U)
            for lo, hi, d, o in blocks(data, offsets):
                text, a, b, t, h, e = triggers(d, o, length)
                items = np.zeros(len(text), _TRIGGER)
                items["h"], items["e"], items["row"], items["pos"] = h, e, names[lo:hi][text], t - o[text]
                held.append(items)
                if sum(map(len, held)) > FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], kinds: dict[int, np.dtype], passed: list[pa.RecordBatch]) -> dict[int, np.ndarray]:
    got: dict[int, list[bytes]] = {k: [] for k in kinds}
    for batch in batches:
        kind = batch.column(1).to_numpy()
        rest = np.flatnonzero(~np.isin(kind, list(kinds)))
        if len(rest):
            passed.append(batch.take(pa.array(rest)))
        for i in np.flatnonzero(np.isin(kind, list(kinds))).tolist():
            got[int(kind[i])].append(batch.column(2)[i].as_py())
    return {k: np.frombuffer(b"".join(v), t) for (k, t), v in zip(kinds.items(), got.values())}


def _dictionary():
    """Decides phrases that are whole repeats or single; asks for the texts of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        got = _unpacked(batches, {BY_TRIGGER: _TRIGGER, BY_PHRASE: _TRIGGER, BEACON: _TRIGGER}, passed)
        yield from passed
        for kind in (BY_TRIGGER, BY_PHRASE):
            items = got[kind]
            if not len(items):
                continue
            items = items[np.lexsort((items["e"], items["h"]))]
            begin = np.flatnonzero(np.append(True, (items["h"][1:] != items["h"][:-1]) | (items["e"][1:] != items["e"][:-1])))
            count = np.diff(np.append(begin, len(items)))
            whole = (np.add.reduceat(items["twice"].astype(np.int64), begin) + count) > 1
            all_whole = np.repeat(whole, count)
            yield from _rows(FULL, items["row"][all_whole], items["pos"][all_whole])
            one = items[begin]
            if kind == BY_PHRASE:
                yield from _rows(ASK_HOT, one["row"], one["pos"])
                continue
            first = np.flatnonzero(np.append(True, one["h"][1:] != one["h"][:-1]))
            several = np.diff(np.append(first, len(one)))
            some_single = np.minimum.reduceat(whole.astype(np.int64), first) == 0
            lit = np.isin(one["h"][first], got[BEACON]["h"])
            # phrases of a lit trigger string are compared with those dealt by phrase, so whole ones send their windows too
            ask = np.repeat(((several > 1) & some_single) | lit, several)
            hot = np.repeat((several > HOT) | lit, several)
            yield from _rows(ASK, one["row"][ask & ~hot], one["pos"][ask & ~hot])
            yield from _rows(ASK_HOT, one["row"][ask & hot], one["pos"][ask & hot])

    return run


def _fetch(keys: list[int], length: int):
    """Runs of whole phrases; texts of the phrases asked for, and window hashes of the hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy().view(U)
            data, offsets = text_buffers(batch.column(1))
            asked = batch.column(2)
            for lo, hi, d, o in blocks(data, offsets):
                part = asked.slice(lo, hi - lo)
                codes = np.unique((np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy()) << 36) | part.flatten().to_numpy())
                text, a, b, t, h, _ = triggers(d, o, length)
                code = (text << 36) | ((t - o[text]) << 2)
                for kind in (FULL, ASK, ASK_HOT):
                    of = codes[(codes & 3) == kind - FULL] - (kind - FULL)
                    chosen = np.flatnonzero(np.isin(code, of))
                    x, y, row = a[chosen], b[chosen] + length, names[lo:hi][text[chosen]]
                    shift = o[text[chosen]]
                    if kind == FULL:
                        yield from _rows(RUN, row, x - shift, y - shift)
                    elif kind == ASK and len(chosen):
                        target = _bucket(h[chosen], len(keys))
                        raw, payloads = d.tobytes(), {}
                        for k, s, e, g, r, w in zip(target.tolist(), x.tolist(), y.tolist(), h[chosen].tolist(), row.tolist(), (x - shift).tolist()):
                            payloads.setdefault(k, []).append(np.array([g, r], "<u8").tobytes() + np.array([w, e - s], "<u4").tobytes() + raw[s:e])
                        yield from _payloads(PHRASES, [(keys[k], b"".join(v)) for k, v in payloads.items()])
                    elif len(chosen):
                        size = y - length - x + 1
                        place = np.repeat(x - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        items = np.zeros(len(place), _WINDOW)
                        for field, table in (("w", BYTE_VALUES), ("v", BYTE_VALUES_2)):
                            items[field] = span_hashes(prefix_hashes(table[d]), place, place + length)
                        items["row"], items["pos"] = np.repeat(row, size), place - np.repeat(shift, size)
                        yield from _windows(items, keys, length)

    return run


def _windows(items: np.ndarray, keys: list[int] | None, length: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows that occur twice among these; each once to its bucket."""
    items = items[np.lexsort((items["v"], items["w"]))]
    begin = np.flatnonzero(np.append(True, (items["w"][1:] != items["w"][:-1]) | (items["v"][1:] != items["v"][:-1]))) if len(items) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(items)))
    twice = np.repeat(count > 1, count)
    at = items[twice & (items["known"] == 0)]
    if len(at):
        at = at[np.lexsort((at["pos"], at["row"]))]
        head = np.append(True, (at["row"][1:] != at["row"][:-1]) | (at["pos"][1:].astype(np.int64) != at["pos"][:-1].astype(np.int64) + 1))
        edge = np.flatnonzero(head)
        last = np.append(edge[1:], len(at)) - 1
        yield from _rows(RUN, at["row"][edge], at["pos"][edge], at["pos"][last].astype(np.int64) + length)
    if keys is not None and len(items):
        one = items[begin]
        one["known"] = count > 1
        yield from _packed(WINDOWS, one, one["w"], keys)


def _resolve(length: int):
    """Runs of repeated windows among the phrases of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: list[bytes] = []
        found: list[tuple[int, int, int, bytes]] = []
        for batch in batches:
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2)):
                raw = payload.as_py()
                if kind == WINDOWS:
                    windows.append(raw)
                    continue
                at = 0
                while at < len(raw):
                    g, r = np.frombuffer(raw, "<u8", 2, at).tolist()
                    w, size = np.frombuffer(raw, "<u4", 2, at + 16).tolist()
                    found.append((g, r, w, raw[at + 24 : at + 24 + size]))
                    at += 24 + size
        yield from _windows(np.frombuffer(b"".join(windows), _WINDOW), None, length)
        found.sort(key=lambda x: x[0])
        lo = 0
        while lo < len(found):
            hi, size = lo, 0
            while hi < len(found) and (size < CHUNK or found[hi][0] == found[hi - 1][0]):
                size += len(found[hi][3])
                hi += 1
            data = np.frombuffer(b"".join(x[3] for x in found[lo:hi]), np.uint8)
            offsets = np.append(0, np.cumsum([len(x[3]) for x in found[lo:hi]]))
            hit = np.flatnonzero(repeated_windows(data, offsets, length))
            if len(hit):
                which = np.searchsorted(offsets, hit, "right") - 1
                edge = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (which[1:] != which[:-1])))
                last = np.append(edge[1:], len(hit)) - 1
                row = np.array([x[1] for x in found[lo:hi]], U)[which[edge]]
                base = np.array([x[2] for x in found[lo:hi]], np.int64)[which[edge]] - offsets[which[edge]]
                yield from _rows(RUN, row, hit[edge] + base, hit[last] + base + length)
            lo = hi

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row.

    Null or empty text: no bytes.  Rows that are repeated as a whole remove each
    other's bytes (from ``length`` bytes on).  Rows are told apart by a 64-bit hash of
    id and text.  ``kept`` are the remaining bytes, which may cut a character.
    Further columns are not read.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark, docs)
    keys = bucket_keys(spark, parts)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    long_rows = rows.where(F.octet_length("text") >= length).select("row", "text")
    marks = materialise(long_rows.mapInArrow(_scan(keys, length), ROWS).repartition(parts, "bucket").mapInArrow(_dictionary(), ROWS), "suffix-marks")
    release(spark)
    codes = marks.groupBy("row").agg(F.collect_list(F.col("pos") * 4 + F.col("kind") - FULL).alias("codes")).withColumnRenamed("row", "__row")
    asked = long_rows.join(codes.hint("shuffle_hash"), F.col("row") == F.col("__row")).select("row", "text", "codes")
    fetched = asked.mapInArrow(_fetch(keys, length), ROWS)
    fetched = materialise(fetched, "suffix-fetched")
    discard(marks)
    release(spark)
    resolved = fetched.where(F.col("kind") != RUN).repartition(parts, "bucket").mapInArrow(_resolve(length), ROWS)
    runs = fetched.where(F.col("kind") == RUN).unionByName(resolved).select("row", "pos", "stop")
    runs = materialise(runs.groupBy("row").agg(F.collect_list("pos").alias("starts"), F.collect_list("stop").alias("stops")).withColumnRenamed("row", "__row"), "suffix-runs")
    discard(fetched)
    release(spark)
    joined = rows.join(runs.hint("shuffle_hash"), F.col("row") == F.col("__row"), "left").select("doc_id", "text", "starts", "stops")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi, d, o in blocks(data, offsets):
                begin, stop = batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo)
                shift = np.repeat(o[:-1], begin.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                depth = np.zeros(len(d) + 1, np.int64)
                np.add.at(depth, begin.flatten().to_numpy() + shift, 1)
                np.add.at(depth, stop.flatten().to_numpy() + shift, -1)
                gone = np.cumsum(depth)[:-1] > 0
                lost = np.append(0, np.cumsum(gone))[o]
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                at = o[:-1][o[:-1] < len(d)]
                head[at] = gone[at]
                spans = np.append(0, np.cumsum(head))[o]
                kept, left = d[~gone].tobytes(), o - lost
                pieces = [kept[x:y] for x, y in zip(left[:-1].tolist(), left[1:].tolist())]
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(o)), pa.array(np.diff(lost)), pa.array(np.diff(spans)), pa.array([hashlib.sha256(x).hexdigest() for x in pieces])]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(pieces, pa.binary())] if with_bytes else []), names=[x.split()[0] for x in schema.split(", ")])

    return joined.mapInArrow(run, schema)
