"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  The vector of an n-gram binds the
vectors of its letters: each is permuted (rotated) by its place in the n-gram, then
all are multiplied.  A text's vector bundles (adds) those of its n-grams; a
language's prototype bundles all n-grams of all its learning texts.  A text gets
the language whose prototype has the largest cosine with it.

Letter vectors come from a hash of the code point, so no alphabet is fixed and
workers need to agree on nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .storage import materialise
from .textarrays import blocks, mix, text_buffers

DIMENSIONS = 1024
N = 3
UNKNOWN = "und"
GRAMS = 1 << 16  # of a language, bundled in one task
ROWS = 128  # texts bundled by one matrix product
CACHE_GRAMS = 200_000
U = np.uint64
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def gram_bits(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of packed n-grams as bits: 1 for -1."""
    words = np.arange(dimensions // 64, dtype=U)
    out = np.zeros((len(grams), dimensions // 8), np.uint8)
    for k in range(N):
        cp = (grams >> U(21 * k)) & U(0x1FFFFF)
        letter = mix(mix(cp + U(1))[:, None] + words[None, :] * U(0x9E3779B97F4A7C15)).view(np.uint8)
        out ^= np.roll(letter, 5 * k, axis=1)  # the permutation: a rotation by 40 places for each step
    return out


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of packed n-grams, +1 and -1; known ones come from the worker's cache."""
    known, bits = _cache.get(dimensions, (np.zeros(0, U), np.zeros((0, dimensions // 8), np.uint8)))
    place = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
    new = known[place] != grams if len(known) else np.ones(len(grams), bool)
    if new.any():
        if len(known) + int(new.sum()) > CACHE_GRAMS:
            known, bits = known[:0], bits[:0]
            new = np.ones(len(grams), bool)
        known, bits = np.concatenate([known, grams[new]]), np.concatenate([bits, gram_bits(grams[new], dimensions)])
        order = np.argsort(known)
        known, bits = known[order], bits[order]
        _cache[dimensions] = known, bits
        place = np.searchsorted(known, grams)
    return 1 - 2 * np.unpackbits(bits[place], axis=1).astype(np.float32)


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, packed n-gram, count) of a block's texts: letters in lower case, one blank around words.

    A text with a letter has a blank before and after it, so an n-gram at least.
    """
    raw = data.tobytes().decode("utf-8", "replace")
    cps = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(offsets), np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=(chars := np.zeros(len(data), np.int64))) if len(data) else (chars := np.zeros(0, np.int64))
    starts[:] = np.append(0, chars)[offsets]
    letters = _letters()[cps].astype(U)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    solid = letters > 0
    # keep letters and the first other character after one; put a blank before each text and after it
    after = np.zeros(len(letters), bool)
    after[1:] = solid[:-1] & (row[1:] == row[:-1])
    keep = solid | after
    letters, row = letters[keep], row[keep]
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    stop = np.append(first[1:], len(row))
    filled = first < stop
    at = np.concatenate([first[filled], stop[filled][letters[stop[filled] - 1] > 0]])
    of = np.concatenate([np.flatnonzero(filled), np.flatnonzero(filled)[letters[stop[filled] - 1] > 0]])
    order = np.lexsort((of, at))  # a text's end before the next one's start
    letters, row = np.insert(letters, at[order], 0), np.insert(row, at[order], of[order])
    if len(letters) < N:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    m = len(letters) - N + 1
    gram = np.zeros(m, U)
    for k in range(N):
        gram = (gram << U(21)) | letters[k : k + m]
    inside = row[:m] == row[N - 1 :]
    row, gram = row[:m][inside], gram[inside]
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    begin = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))) if len(row) else np.zeros(0, np.int64)
    return row[begin], gram[begin], np.diff(np.append(begin, len(row)))


def bundle(row: np.ndarray, gram: np.ndarray, count: np.ndarray, n_rows: int, dimensions: int) -> np.ndarray:
    """Vectors of texts: counts times n-gram vectors."""
    out = np.zeros((n_rows, dimensions), np.float32)
    edges = np.searchsorted(row, np.arange(0, n_rows + ROWS, ROWS))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if b <= a:
            continue
        lo = k * ROWS
        distinct, at = np.unique(gram[a:b], return_inverse=True)
        for c in range(0, len(distinct), 4096):
            some = (at >= c) & (at < c + 4096)
            table = np.zeros((min(ROWS, n_rows - lo), min(4096, len(distinct) - c)), np.float32)
            table[row[a:b][some] - lo, at[some] - c] = count[a:b][some]
            out[lo : lo + len(table)] += table @ gram_vectors(distinct[c : c + 4096], dimensions)
    return out


def is_held_out(id_col: str) -> F.Column:
    """Whether a document is kept from learning: crc32 of its id modulo 4 is 2.  A null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of every language of ``docs``, from the n-gram counts of all its texts.

    Rows without text or language teach nothing.  One task bundles about ``GRAMS``
    distinct n-grams; one vector for each language comes to the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, code = batch.column(0).dictionary_encode(), None
            code = langs.indices.to_numpy()
            data, offsets = text_buffers(batch.column(1))
            for lo, hi, d, o in blocks(data, offsets):
                row, gram, n = text_grams(d, o)
                lang = code[lo:hi][row]
                order = np.lexsort((gram, lang))
                lang, gram, n = lang[order], gram[order], n[order]
                if len(lang):
                    begin = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])))
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[begin])), pa.array(gram[begin].view(np.int64)), pa.array(np.add.reduceat(n, begin))], names=["lang", "gram", "n"])

    def bundled(key, table):
        grams = table["gram"].to_numpy().view(U)
        total = np.zeros(dimensions)
        for c in range(0, len(grams), 4096):
            total += table["n"].to_numpy()[c : c + 4096].astype(np.float64) @ gram_vectors(grams[c : c + 4096], dimensions)
        return pa.table({"lang": [key[0].as_py()], "vector": [total.tolist()]}, schema=pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float64()))]))

    def added(key, table):
        total = np.add.reduce(np.array(table["vector"].to_pylist()))
        return pa.table({"lang": [key[0].as_py()], "vector": [total.tolist()]}, schema=pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float64()))]))

    counts = materialise(rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    slices = counts.count() // GRAMS + 1
    parts = counts.withColumn("slice", F.pmod(F.xxhash64("gram"), F.lit(slices))).groupBy("lang", "slice").applyInArrow(bundled, "lang string, vector array<double>")
    return {r["lang"]: np.array(r["vector"]) for r in parts.groupBy("lang").applyInArrow(added, "lang string, vector array<double>").collect()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the cosine, at least 0).

    Null text, text without letters, or no prototypes: ``und`` with score 0.  Of
    equal cosines the first language by name.  Further columns are kept; those
    named like the results are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    names = sorted(prototypes)
    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    dimensions = len(next(iter(prototypes.values()))) if names else DIMENSIONS
    table = np.array([prototypes[k] / max(np.linalg.norm(prototypes[k]), 1e-12) for k in names]).reshape(len(names), dimensions)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(text_at))
            for lo, hi, d, o in blocks(data, offsets):
                row, gram, n = text_grams(d, o)
                known = np.zeros(hi - lo, bool)
                known[row] = True
                lang, score = np.full(hi - lo, UNKNOWN, object), np.zeros(hi - lo)
                if names and known.any():
                    vectors = bundle(row, gram, n, hi - lo, dimensions)
                    cosine = vectors @ table.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
                    best = cosine.argmax(1)
                    lang[known] = np.array(names, object)[best[known]]
                    score[known] = np.clip(cosine[np.arange(hi - lo), best], 0, 1)[known]
                arrays = [c.slice(lo, hi - lo) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(lang.tolist(), pa.string()), pa.array(score)], names=schema.names)

    return docs.mapInArrow(run, schema)


def learn_and_predict(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Learns from the rows that are not held out, predicts all: ``held_out``, ``lang_pred`` and ``score`` are added."""
    prototypes = learn(docs.where(~is_held_out(id_col)), lang_col, text_col)
    return predict(docs.withColumn("held_out", is_held_out(id_col)), prototypes, text_col)
