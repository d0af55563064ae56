"""Exact n-gram Jaccard join with PartEnum signatures.

Sets of word shingles are put in size bands.  Two sets with a similarity of t or
more differ in at most ``(1 - t) / (1 + t) * (a + b)`` elements.  The domain of the
elements is dealt over partitions of three parts each, more than half as many as
that difference, so there are partitions in which such sets differ in one part at
most.  The signatures are the subsets of two parts of each partition, hashed over
the elements in them; sets near the lower end of a band also join the band below,
so any two sets that may be similar meet in one band.

* A set has ``need`` signatures at least in common with each set it links with:
  those it has, less those that the largest possible difference can spoil.  Sets of
  which fewer signatures occur elsewhere are dropped; of the others, the ``need - 1``
  most frequent signatures are left out, since one of the rest is common too.  So a
  passage that many documents share makes no group by itself.
* A set too small or too unevenly dealt for a guarantee, in its own band or in the
  band below, also enumerates its single elements.
* Of the sets left in groups, the elements that another such set has are counted.
  The count bounds the size of any partner; sets with no possible partner go.
* Groups are worked off in rounds.  A round compares the members nearest to the
  rest of their group (representatives: 1, then 8, 64, ... of them) with all other members
  in another component; then components are found anew.  A family of copies is one
  component after the first round, so its pairs are not expanded; a pair is left out
  only if it is in one component already, or if sizes, bounds or parity sketches rule
  it out.  Every other pair is verified on the sets.

Equal sets are one set from the start.  Shingles are 54-bit hashes; a set's 64-bit
name is held against a second hash wherever documents get their component.
Signatures travel as packed arrays, one row for each pair of tasks: 32 bits of a
signature besides its bucket; a false common signature costs a comparison only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .storage import bucket_keys, discard, materialise, release, shuffle_parts
from .textarrays import BYTE_VALUES, IS_SPACE, LOWER, blocks, mix, owner, prefix_hashes, runs, span_hashes, text_buffers

U = np.uint64
THRESHOLD = (80, 100)  # 100 * intersection >= 80 * union
SHINGLE = 5
GROWTH = 8  # representatives of a round, times those of the round before
PARTS = 3  # parts of a partition; the subsets of two of them are its signatures
LEAST_PARTS = 8
TASK_BYTES = 4 << 20  # packed signatures of one task after the first rounds
MATRIX = 2048  # members up to which all possible partners within a group are looked up
SKETCH_BITS = 2048
FLUSH = 1 << 18
#: Sets (16 bytes each) whose texts are picked by a broadcast join; beyond it both sides are dealt by id.
BROADCAST_SETS = 500_000
_ROW_BITS = 10  # rows of a block; the other bits of a word hold the shingle's hash


def set_bands(num: int, den: int, up_to: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower sizes of the bands and the partitions of each: more than half of what sets of the band can differ in."""
    low = [1]
    while low[-1] <= up_to:
        low.append(2 * low[-1])
    low = np.array(low, np.int64)
    return low, difference(2 * low - 1, num, den) // 2 + 1


def difference(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Most elements in which a set of this size can differ from a similar one.

    With t = num/den: |x| = a and |y| = b <= a/t differ in (1-t)/(1+t) * (a+b) at
    most, which is a/t - a for the largest b.
    """
    return size * (den - num) // num


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (54 bits, ascending) and the first of each text."""
    low = LOWER[data]
    starts, ends, first = runs(~IS_SPACE[data], offsets)
    words = span_hashes(prefix_hashes(BYTE_VALUES[low]), starts, ends)
    row = owner(first)
    keys = []
    m = len(words) - n + 1
    if m > 0:
        h = np.zeros(m, U)
        for k in range(n):
            h = h * U(0xA0761D6478BD642F) + words[k : k + m]
        inside = row[:m] == row[n - 1 :]
        keys.append((row[:m][inside].astype(U) << U(64 - _ROW_BITS)) | (mix(h[inside]) >> U(_ROW_BITS)))
    count = np.diff(first)
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        if len(short):
            h = np.full(len(short), size, U)
            for k in range(size):
                h = h * U(0xA0761D6478BD642F) + words[first[short] + k]
            keys.append((short.astype(U) << U(64 - _ROW_BITS)) | (mix(mix(h) + U(size)) >> U(_ROW_BITS)))
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, U)
    if len(keys):
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
    rows = (keys >> U(64 - _ROW_BITS)).astype(np.int64)
    return keys & U((1 << (64 - _ROW_BITS)) - 1), np.searchsorted(rows, np.arange(len(offsets)))


def set_ids(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    size = np.diff(first)
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        c = np.zeros(len(sets) + 1, U)
        np.cumsum(mix(sets + U(seed)), out=c[1:])
        out.append(mix(c[first[1:]] - c[first[:-1]] + size.astype(U) * U(seed)))
    return out[0], out[1]


def signatures(sets: np.ndarray, first: np.ndarray, ids: np.ndarray, num: int, den: int):
    """(signature, entity) of all sets, and (entity, set, need) of all entities: a set in one band."""
    size = np.diff(first)
    low, partitions = set_bands(num, den, int(size.max(initial=1)))
    band = np.searchsorted(low, size, "right") - 1
    diff = difference(size, num, den)
    made, entities = [], []
    weak = np.zeros(len(size), bool)
    for shift in (0, 1):
        b = band - shift
        # b is at least low[band] / t below any partner in the band below
        chosen = np.flatnonzero((size > 0) & (b >= 0) & ((shift == 0) | (num * size < den * low[np.maximum(band, 0)])))
        if not len(chosen):
            continue
        entity = mix(ids[chosen] + b[chosen].astype(U) + U(1))
        length, count = size[chosen], partitions[b[chosen]]
        at = np.repeat(first[chosen] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        of = np.repeat(np.arange(len(chosen)), length)
        values = sets[at]
        before = np.cumsum(count) - count
        part = (((values >> U(22)) * (PARTS * count).astype(U)[of]) >> U(32)).astype(np.int64) + PARTS * before[of]  # ascending
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        content, filled = np.zeros(PARTS * int(count.sum()), U), np.zeros(PARTS * int(count.sum()), bool)
        content[part[begin]], filled[part[begin]] = mix(np.add.reduceat(mix(values), begin)), True
        content, filled = content.reshape(-1, PARTS), filled.reshape(-1, PARTS)
        holder = np.repeat(np.arange(len(chosen)), count)
        place = np.arange(len(holder)) - before[holder]
        for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            on = np.flatnonzero(filled[:, i] | filled[:, j])
            where = (place[on] * 256 + b[chosen][holder[on]] * PARTS + k).astype(U)
            made.append((mix(mix(content[on, i] * U(0x9E3779B97F4A7C15) + content[on, j]) + where), entity[holder[on]]))
        # of a partition with one filled part, both signatures go with one difference; else two, then the third
        parts = filled.sum(axis=1)
        two, three = (np.bincount(holder[x], minlength=len(chosen)) for x in (parts == 1, parts > 1))
        # in the band below, partners are smaller than ``low[band]``: |x| = a and |y| = b differ in (1-t)/(1+t) * (a+b) at most
        most = diff[chosen] if shift == 0 else np.minimum(diff[chosen], (low[band[chosen]] - 1 + length) * (den - num) // (den + num))
        spoilt = 2 * np.minimum(most, two + three) + np.minimum(np.maximum(most - two - three, 0), three)
        need = 2 * two + 3 * three - spoilt
        entities.append((entity, ids[chosen], np.maximum(need, 1)))
        weak[chosen] |= need < 1
    if weak.any():
        # two sets that meet in a band in which neither has a guarantee both list their elements
        single = mix(ids + U(0x517CC1B727220A95))
        made.append((mix(sets[np.repeat(weak, size)] + U(0x2545F4914F6CDD1D)), np.repeat(single[weak], size[weak])))
        entities.append((single[weak], ids[weak], -(-num * size[weak] // den)))
    if not made:
        return (np.zeros(0, U),) * 2, (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*made)), tuple(np.concatenate(x) for x in zip(*entities))


PACKED = "bucket int, kind int, payload binary, doc long, n long, k1 long, k2 long, key long"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 5]
DOC, SIGNATURE, ENTITY, COUNTED, MEMBER, LABEL, PAIR, ELEMENT, FOUND = range(9)
_SIG = np.dtype([("sig", "<u4"), ("entity", "<u8")])
_LARGE = np.dtype([("sig", "<u8"), ("set", "<u8")])
_ITEMS = {
    SIGNATURE: _SIG,
    ELEMENT: _SIG,
    ENTITY: np.dtype([("entity", "<u8"), ("set", "<u8"), ("need", "<i4")]),
    COUNTED: np.dtype([("sig", "<u8"), ("entity", "<u8"), ("count", "<u4")]),
    MEMBER: _LARGE,
    LABEL: np.dtype([("set", "<u8"), ("root", "<u8"), ("size", "<i8"), ("most", "<i8"), ("sketch", "<u8", (SKETCH_BITS // 64,))]),
    FOUND: np.dtype([("set", "<u8"), ("count", "<u4")]),
}


def _folded(items: np.ndarray) -> bytes:
    """Signatures in the order of their entities, each entity once."""
    begin = np.flatnonzero(np.append(True, items["entity"][1:] != items["entity"][:-1]))
    count = np.diff(np.append(begin, len(items))).astype("<u4")
    return np.uint64(len(begin)).tobytes() + items["entity"][begin].tobytes() + count.tobytes() + items["sig"].tobytes()


def _unfolded(payload: bytes, bucket: int) -> np.ndarray:
    """Short signatures get their bucket as upper half."""
    n = int(np.frombuffer(payload, "<u8", 1)[0])
    count = np.frombuffer(payload, "<u4", n, 8 + 8 * n)
    sig = np.frombuffer(payload, "<u4", offset=8 + 12 * n)
    out = np.empty(len(sig), _LARGE)
    out["sig"], out["set"] = sig.astype(U) | U(bucket << 32), np.repeat(np.frombuffer(payload, "<u8", n, 8), count)
    return out


def _rows(length: int, kind: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """Rows that are not packed."""
    known = {"kind": np.full(length, kind, np.int32), **columns}
    arrays = [pa.nulls(length, t) if c not in known else known[c] if isinstance(known[c], pa.Array) else pa.array(known[c].view(np.int64) if known[c].dtype == U else known[c]) for c, t in zip(_NAMES, _TYPES)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _packed(kind: int, items: np.ndarray, target: np.ndarray, keys: list[int]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that has items."""
    fold = items.dtype == _SIG
    order = np.lexsort((items["entity"], target)) if fold else np.argsort(target, kind="stable")
    items = items[order]
    edges = np.searchsorted(target[order], np.arange(len(keys) + 1))
    rows = [(keys[b], _folded(items[a:z]) if fold else items[a:z].tobytes()) for b, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if z > a]
    if rows:
        yield _rows(len(rows), kind, bucket=np.array([r[0] for r in rows], np.int32), payload=pa.array([r[1] for r in rows], pa.binary()))


def _unpacked(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...], passed: list[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """The packed items by kind; rows of other kinds go to ``passed``."""
    got: dict[int, list[np.ndarray]] = {k: [] for k in kinds}
    for batch in batches:
        kind = batch.column(1).to_numpy()
        mine = np.isin(kind, kinds)
        if not mine.all():
            passed.append(batch.take(pa.array(np.flatnonzero(~mine))))
        for i in np.flatnonzero(mine).tolist():
            payload, k = batch.column(2)[i].as_py(), int(kind[i])
            got[k].append(_unfolded(payload, batch.column(0)[i].as_py()) if _ITEMS[k] == _SIG else np.frombuffer(payload, _ITEMS[k]))
    return {k: np.concatenate(v) if v else np.zeros(0, _LARGE if _ITEMS[k] == _SIG else _ITEMS[k]) for k, v in got.items()}


def _begins(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of each group of equal values."""
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(ordered)))


def _distinct(items: np.ndarray, *fields: str) -> np.ndarray:
    """Items in the order of the fields, each combination once."""
    if not len(items):
        return items
    items = items[np.lexsort([items[f] for f in fields[::-1]])]
    new = np.zeros(len(items), bool)
    new[0] = True
    for f in fields:
        new[1:] |= items[f][1:] != items[f][:-1]
    return items[new]


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    return ((values >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _scan(rows: DataFrame, keys: list[int], num: int, den: int, n: int) -> DataFrame:
    """Sets of all texts: their names (DOC) and, once for each set in a task, signatures."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        entities: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                sig, entity = (np.concatenate(x) for x in zip(*held))
                items = np.empty(len(sig), _SIG)
                items["sig"], items["entity"] = sig & U(0xFFFFFFFF), entity
                yield from _packed(SIGNATURE, items, _bucket(sig, len(keys)), keys)
                entity, of, need = (np.concatenate(x) for x in zip(*entities))
                items = np.empty(len(entity), _ITEMS[ENTITY])
                items["entity"], items["set"], items["need"] = entity, of, need
                yield from _packed(ENTITY, items, _bucket(entity, len(keys)), keys)
                held.clear()
                entities.clear()
                seen.clear()

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi, d, o in blocks(data, offsets, rows=1 << _ROW_BITS):
                sets, first = shingle_sets(d, o, n)
                k1, k2 = set_ids(sets, first)
                dealt = np.array(keys, np.int32)[(np.arange(hi - lo) + lo) % len(keys)]
                yield _rows(hi - lo, DOC, bucket=dealt, doc=batch.column(0).slice(lo, hi - lo), n=np.diff(first), k1=k1, k2=k2, key=batch.column(2).slice(lo, hi - lo))
                fresh = np.array([k not in seen and not seen.add(k) for k in k1.tolist()], bool)
                size = np.where(fresh, np.diff(first), 0)
                made, found = signatures(sets[np.repeat(fresh, np.diff(first))], np.append(0, np.cumsum(size)), k1, num, den)
                held.append(made)
                entities.append(found)
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield from flush()
        yield from flush()

    return rows.select("__ml_id", "__ml_text", "__ml_key").mapInArrow(signed, PACKED)


def _common(got: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, holder and number of rows of the signatures that two holders or more have."""
    got = got[np.argsort(got["sig"])]
    begin, size = _begins(got["sig"])
    if not len(got):
        return got["sig"], got["set"], np.zeros(0, np.int64)
    several = np.minimum.reduceat(got["set"], begin) != np.maximum.reduceat(got["set"], begin)
    kept = np.repeat(several, size)
    return got["sig"][kept], got["set"][kept], np.repeat(size, size)[kept]


def _shared(keys: list[int]):
    """Signatures that two entities or more have, with their frequency, dealt by entity."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        sig, entity, count = _common(_unpacked(batches, (SIGNATURE,), passed)[SIGNATURE])
        yield from passed
        items = np.empty(len(sig), _ITEMS[COUNTED])
        items["sig"], items["entity"], items["count"] = sig, entity, np.minimum(count, 0xFFFFFFFF)
        yield from _packed(COUNTED, items, _bucket(entity, len(keys)), keys)

    return shared


def _survivors(keys: list[int]):
    """The rarest shared signatures of entities that have enough of them, all but ``need - 1``, dealt by signature.

    Two entities that link have ``need`` in common at least; the rarest of these is
    followed by ``need - 1`` more in the order of either, so it is not left out.
    """

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _unpacked(batches, (COUNTED, ENTITY), [])
        known, sig = _distinct(got[ENTITY], "entity"), _distinct(got[COUNTED], "entity", "count", "sig")
        begin, count = _begins(sig["entity"])
        place = np.searchsorted(known["entity"], sig["entity"][begin])
        kept = np.arange(len(sig)) - np.repeat(begin, count) <= np.repeat(count - known["need"][place], count)
        items = np.empty(int(kept.sum()), _LARGE)
        items["sig"], items["set"] = mix(sig["sig"][kept]), np.repeat(known["set"][place], count)[kept]
        yield from _packed(MEMBER, items, _bucket(items["sig"], len(keys)), keys)

    return survivors


def _grouped(keys: list[int]):
    """Members of the groups of two sets or more, dealt by set."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _distinct(_unpacked(batches, (MEMBER,), [])[MEMBER], "sig", "set")
        _, size = _begins(got["sig"])
        got = got[np.repeat(size, size) > 1]
        yield from _packed(MEMBER, got, _bucket(got["set"], len(keys)), keys)

    return grouped


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set of a bucket once."""
    yield pa.RecordBatch.from_arrays([pa.array(np.unique(_unpacked(batches, (MEMBER,), [])[MEMBER]["set"]).view(np.int64))], names=["set"])


def parity_sketch(elements: np.ndarray) -> bytes:
    """A bit for each hash slot: whether it holds an odd number of elements.  Sets differ in at least as many elements as sketches in bits."""
    odd = np.bincount((mix(elements + U(3)) % U(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


ELEMENTS = "bucket int, set long, size long, sketch binary, elements binary"


def _elements(n: int, keys: list[int]):
    """Elements of the sets (column 0) from texts (column 1); a text that is not of its set goes."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            wanted = batch.column(0).to_numpy().view(U)
            for lo, hi, d, o in blocks(data, offsets, rows=1 << _ROW_BITS):
                sets, first = shingle_sets(d, o, n)
                right = np.flatnonzero(set_ids(sets, first)[0] == wanted[lo:hi])
                parts = [sets[first[i] : first[i + 1]] for i in right.tolist()]
                bucket = np.array(keys, np.int32)[_bucket(wanted[lo:hi][right], len(keys))]
                arrays = [pa.array(bucket), pa.array(wanted[lo:hi][right].view(np.int64)), pa.array(np.diff(first)[right]), pa.array([parity_sketch(x) for x in parts], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in ELEMENTS.split(", ")])

    return elements


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket, the first of each set."""
    seen: set[int] = set()
    for batch in batches:
        yield batch.filter(pa.array([s not in seen and not seen.add(s) for s in batch.column(1).to_pylist()], pa.bool_()))


def _asked(keys: list[int]):
    """The elements of all sets, dealt by element."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                values, sets = (np.concatenate(x) for x in zip(*held))
                items = np.empty(len(values), _SIG)
                items["sig"], items["entity"] = values & U(0xFFFFFFFF), sets
                yield from _packed(ELEMENT, items, _bucket(values, len(keys)), keys)
                held.clear()

        for batch in batches:
            for name, raw in zip(batch.column(0).to_numpy().view(U), batch.column(1)):
                values = mix(np.frombuffer(raw.as_py(), "<u8"))
                held.append((values, np.full(len(values), name, U)))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield from flush()
        yield from flush()

    return asked


def _met(keys: list[int]):
    """Of each set the number of elements that another set has too, bucket by bucket, dealt by set."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, count = np.unique(_common(_unpacked(batches, (ELEMENT,), [])[ELEMENT])[1], return_counts=True)
        items = np.empty(len(sets), _ITEMS[FOUND])
        items["set"], items["count"] = sets, count
        yield from _packed(FOUND, items, _bucket(sets, len(keys)), keys)

    return met


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = _unpacked(batches, (FOUND,), [])[FOUND]
    sets, at = np.unique(got["set"], return_inverse=True)
    found = np.bincount(at, got["count"], len(sets)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64)), pa.array(found)], names=["set", "found"])


def _label(keys: list[int], sketched: bool):
    """Members of the groups and, once for each task that needs it, what is known of their sets, dealt by signature."""

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        got = _unpacked(batches, (MEMBER,), rows)[MEMBER]
        if not rows or not len(got):
            return
        labels = np.zeros(sum(len(r) for r in rows), _ITEMS[LABEL])
        for field, column in (("size", 3), ("most", 4), ("set", 5), ("root", 6)):
            values = np.concatenate([r.column(column).to_numpy() for r in rows])
            labels[field] = values.view(U) if labels[field].dtype == U else values
        if sketched:
            labels["sketch"] = np.frombuffer(b"".join(x.as_py() for r in rows for x in r.column(2)), "<u8").reshape(len(labels), -1)
        labels = labels[np.argsort(labels["set"])]
        place = np.minimum(np.searchsorted(labels["set"], got["set"]), len(labels) - 1)
        known = labels["set"][place] == got["set"]
        got, place = got[known], place[known]
        target = _bucket(got["sig"], len(keys))
        yield from _packed(MEMBER, got, target, keys)
        both = np.unique((target.astype(U) << U(32)) | place.astype(U))
        place, target = (both & U(0xFFFFFFFF)).astype(np.int64), (both >> U(32)).astype(np.int64)
        for lo in range(0, len(place), 1 << 16):
            yield from _packed(LABEL, labels[place[lo : lo + (1 << 16)]], target[lo : lo + (1 << 16)], keys)

    return labelled


def _choose(keys: list[int], representatives: int, sketched: bool, matrix: int, num: int, den: int):
    """Pairs to be verified: the first representatives of each group with its other members.

    Yields, dealt by set, also the members that still may link with one of another
    component, without the representatives.
    """

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _unpacked(batches, (MEMBER, LABEL), [])
        labels, items = _distinct(got[LABEL], "set"), got[MEMBER]
        if not len(items):
            return
        at = np.searchsorted(labels["set"], items["set"])
        near = labels["most"] * 1024 // np.maximum(labels["size"], 1)
        order = np.lexsort((mix(items["set"]), -near[at], items["sig"]))
        items, at = items[order], at[order]
        size, most, root = (labels[x][at] for x in ("size", "most", "root"))
        pairs: list[np.ndarray] = []
        rest = np.zeros(len(items), bool)

        def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return (size[y] <= most[x]) & (size[x] <= most[y]) & (root[x] != root[y])

        def flush() -> Iterator[pa.RecordBatch]:
            if not pairs:
                return
            both = np.unique(np.concatenate(pairs))
            pairs.clear()
            for lo in range(0, len(both), 1 << 14):
                a, b = ((x & U(0xFFFFFFFF)).astype(np.int64) for x in (both[lo : lo + (1 << 14)] >> U(32), both[lo : lo + (1 << 14)]))
                if sketched:
                    apart = np.bitwise_count(labels["sketch"][a] ^ labels["sketch"][b]).sum(axis=1, dtype=np.int64)
                    kept = apart * (den + num) <= (den - num) * (labels["size"][a] + labels["size"][b])
                    a, b = a[kept], b[kept]
                if len(a):
                    yield _rows(len(a), PAIR, k1=labels["set"][a], k2=labels["set"][b])

        def note(x: np.ndarray, y: np.ndarray) -> None:
            x, y = at[x], at[y]
            pairs.append((np.minimum(x, y).astype(U) << U(32)) | np.maximum(x, y).astype(U))

        begin, count = _begins(items["sig"])
        for m in np.unique(count[count > 1]).tolist():
            where = begin[count == m]
            if m <= matrix:
                step = max(1, (1 << 21) // (m * m))
                for lo in range(0, len(where), step):
                    x = where[lo : lo + step, None] + np.arange(m)
                    ok = possible(x[:, :, None], x[:, None, :])
                    live = ok.any(axis=2)
                    first = live & (np.cumsum(live, axis=1) <= representatives)
                    g, i, j = np.nonzero(ok & first[:, :, None])
                    note(x[g, i], x[g, j])
                    later = live & ~first
                    rest[x] = (ok & later[:, None, :]).any(axis=2) & later
                    if sum(map(len, pairs)) > 1 << 20:
                        yield from flush()
                continue
            for start in where.tolist():
                x = np.arange(start, start + m)
                if root[x].min() == root[x].max():
                    continue
                for i in x[:representatives].tolist():
                    other = x[x > i]
                    other = other[possible(np.full(len(other), i), other)]
                    note(np.full(len(other), i), other)
                    if sum(map(len, pairs)) > 1 << 20:
                        yield from flush()
                rest[x[representatives:]] = True
        yield from flush()
        yield from _packed(MEMBER, items[rest], _bucket(items["set"][rest], len(keys)), keys)

    return chosen


def _forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Links that keep the components of these links, and no more."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a, b):
        u, v = find(x), find(y)
        if u != v:
            parent[max(u, v)] = min(u, v)
            kept.append((x, y))
    return kept


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among the pairs: exact on the sets.  Each batch leaves out links that others of it imply."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep_a, keep_b = [], []
            for i, (p, q) in enumerate(zip(a, b)):
                both = np.concatenate([np.frombuffer(batch.column(k)[i].as_py(), "<u8") for k in (2, 3)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if den * common >= num * (len(both) - common):
                    keep_a.append(p)
                    keep_b.append(q)
            kept = _forest(keep_a, keep_b)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], names=["a", "b"])

    one = sets.select(F.col("set").alias("a"), F.col("elements").alias("x"))
    two = sets.select(F.col("set").alias("b"), F.col("elements").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(verified, "a long, b long")


def _possible_sets(rows: DataFrame, groups: DataFrame, reps: DataFrame, parts: int, keys: list[int], num: int, den: int, n: int) -> DataFrame:
    """(bucket, set, size, most, sketch, elements) of the sets in groups that may have a partner; ``most``: its largest size."""
    alive = groups.repartition(parts, "bucket").mapInArrow(_members, "set long")
    chosen = materialise(alive.join(reps.groupBy(F.col("k1").alias("set")).agg(F.min("key").alias("__ml_key")), "set"), "jaccard-chosen")
    near = F.broadcast(chosen) if chosen.count() <= BROADCAST_SETS else chosen.hint("shuffle_hash")
    texts = rows.join(near, "__ml_key").select("set", "__ml_text")
    elements = materialise(texts.mapInArrow(_elements(n, keys), ELEMENTS).repartition(parts, "bucket").mapInArrow(_once, ELEMENTS), "jaccard-elements")
    asked = elements.select("set", "elements").mapInArrow(_asked(keys), PACKED).repartition(parts, "bucket").mapInArrow(_met(keys), PACKED)
    found = asked.repartition(parts, "bucket").mapInArrow(_totals, "set long, found long")
    # common elements c of sets of a and b link them if c * (num + den) >= num * (a + b)
    bound = (F.floor(F.col("found") * (num + den) / num) - F.col("size")).cast("long")
    sets = elements.join(found, "set").withColumn("most", bound).where(F.col("most") * den >= F.col("size") * num)
    sets = materialise(sets.select("bucket", "set", "size", "most", "sketch", "elements"), "jaccard-sets")
    discard(chosen, elements)
    return sets


def _linked(groups: DataFrame, sets: DataFrame, parts: int, keys: list[int], matrix: int, num: int, den: int) -> DataFrame:
    """(node, root) of all sets that link with another one."""
    spark, links, roots, representatives = groups.sparkSession, None, None, 1
    while True:
        sketched = roots is not None
        known = sets if roots is None else sets.join(roots.withColumnRenamed("node", "set"), "set", "left")
        root = F.col("set") if roots is None else F.coalesce("root", "set")
        labels = known.select("bucket", F.lit(LABEL).alias("kind"), (F.col("sketch") if sketched else F.lit(None).cast("binary")).alias("payload"), F.col("size").alias("doc"), F.col("most").alias("n"), F.col("set").alias("k1"), root.alias("k2"), F.lit(None).cast("long").alias("key"))
        labelled = groups.unionByName(labels).repartition(parts, "bucket").mapInArrow(_label(keys, sketched), PACKED)
        out = materialise(labelled.repartition(parts, "bucket").mapInArrow(_choose(keys, representatives, sketched, matrix, num, den), PACKED), "jaccard-round")
        pairs = out.where(F.col("kind") == PAIR).select(F.col("k1").alias("a"), F.col("k2").alias("b")).distinct()
        new = materialise(_verified(pairs, sets, num, den), "jaccard-links")
        discard(groups)
        release(spark)
        if links is None or not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            roots = components(links)
        groups = out.where(F.col("kind") == MEMBER)
        groups._matchloom_path = out._matchloom_path
        if groups.isEmpty():
            discard(groups)
            return roots
        representatives *= GROWTH


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, matrix: int = MATRIX) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``.

    Null, empty and blank texts have no shingles and are their own component.
    A text of fewer words than a shingle is one shingle.  Rows with a null id are
    linked like others but name no component; rows that share an id each keep the
    component of their own text.  Further columns are not read.
    """
    spark, (num, den) = docs.sparkSession, threshold
    parts = shuffle_parts(spark, docs)
    keys = bucket_keys(spark, parts)
    rows = docs.select(F.col(id_col).cast("long").alias("__ml_id"), F.col(text_col).cast("string").alias("__ml_text"))
    rows = rows.withColumn("__ml_key", F.xxhash64("__ml_id", "__ml_text"))
    shared = materialise(_scan(rows, keys, num, den, shingle).repartition(parts, "bucket").mapInArrow(_shared(keys), PACKED), "jaccard-shared")
    of_doc = shared.where(F.col("kind") == DOC).select("doc", "n", "k1", "k2", "key")
    release(spark)
    packed = shared.where(F.col("kind") != DOC)
    size = packed.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    few = min(parts, max(LEAST_PARTS, size // TASK_BYTES))  # what is left is far less than the input
    keys = bucket_keys(spark, few)
    packed = packed.repartition(parts, "bucket").mapInArrow(_survivors(keys), PACKED)
    groups = materialise(packed.repartition(few, "bucket").mapInArrow(_grouped(keys), PACKED), "jaccard-groups")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "key"))
    reps = of_doc.where("n > 0").groupBy("k1", "k2").agg(first.alias("first")).select("k1", "k2", F.col("first.doc").alias("rep"), "first.key")
    reps = materialise(reps, "jaccard-reps")
    sets = _possible_sets(rows, groups, reps, few, keys, num, den, shingle)
    release(spark)
    roots = _linked(groups, sets, few, keys, matrix, num, den)
    named = roots.join(reps.select(F.col("k1").alias("node"), "rep"), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    of_set = reps.join(roots.join(least, "root").select(F.col("node").alias("k1"), "component"), "k1", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    of_set = materialise(of_set, "jaccard-components")
    discard(sets, reps)
    return of_doc.join(of_set, ["k1", "k2"], "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component")).alias("component_id"))
