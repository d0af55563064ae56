"""Quality rules on repetition coverage.

Rolling hashes of several n-gram lengths over the words of a text, in numpy, mark
the words inside n-grams that occur twice or more; the characters of the marked
words against all characters of words give one coverage for each length.  The
characters of repeated lines give one more.  A text whose coverage is above the
published limits of repetition filters is rejected.

Hashes are compared within one text only, so 64 bits are ample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from .textarrays import BYTE_VALUES, CHAR_START, IS_SPACE, blocks, counts_before, lines, mix, owner, prefix_hashes, runs, span_hashes, sums, text_buffers

#: Largest share of characters (of words) inside duplicated n-grams, by n: the limits of published web-text filters.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: The same for characters of lines that repeat an earlier line.
LINE_LIMIT = 0.20
MIN_WORDS = 50
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
U = np.uint64


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    order = np.argsort(key)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _later(key: np.ndarray) -> np.ndarray:
    """Whether each value occurred before."""
    out = np.ones(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = False
    return out


def _covered(words: np.ndarray, row: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    """Words inside an n-gram that its text has twice or more."""
    inside = np.zeros(len(words), bool)
    m = len(words) - n + 1
    if m <= 0:
        return inside
    h = np.zeros(m, U)
    for k in range(n):
        h = h * U(0xA0761D6478BD642F) + words[k : k + m]
    valid = np.flatnonzero(row[: m] == row[n - 1 :])
    found = valid[_repeated(mix(h[valid] ^ seed[valid]))]
    for k in range(n):
        inside[found + k] = True
    return inside


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """Counts of each text of a block."""
    starts, ends, first = runs(~IS_SPACE[data], offsets)
    row = owner(first)
    c = prefix_hashes(BYTE_VALUES[data])
    words = span_hashes(c, starts, ends)
    seed = mix(row.astype(U) + U(1))
    chars = counts_before(CHAR_START[data])
    size = chars[ends] - chars[starts]
    symbols = counts_before(SYMBOLS[data])
    out = {"n_words": np.diff(first), "word_chars": sums(size, first), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}
    line_start, line_end, line_first = lines(data, offsets)
    solid = counts_before(~IS_SPACE[data])
    line_row = owner(line_first)
    again = (solid[line_end] > solid[line_start]) & _later(mix(span_hashes(c, line_start, line_end) ^ mix(line_row.astype(U) + U(1))))
    out["n_dup_lines"] = sums(again, line_first)
    # characters of words only, so that blank space never counts for either side
    word_chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(CHAR_START[data] & ~IS_SPACE[data], out=word_chars[1:])
    out["dup_line_chars"] = sums(np.where(again, word_chars[line_end] - word_chars[line_start], 0), line_first)
    out["n_repeat_words"] = sums(_covered(words, row, seed, 3), first)
    for n in lengths:
        out[f"dup_chars_{n}"] = sums(np.where(_covered(words, row, seed, n), size, 0), first)
    return out


def repetition_quality(docs: DataFrame, text_col: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with counts, coverages and the verdict ``kept``.

    Null or empty text: no words, all counts and coverages 0, ``base_failed``.
    Coverage of a text without words is 0.  Further columns are kept; any named
    like a result is replaced.
    """
    limits = dict(NGRAM_LIMITS if limits is None else limits)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["line_coverage", *(f"coverage_{n}" for n in limits)]
    docs = docs.drop(*counts, *shares, "base_failed", "kept")
    schema = StructType([*docs.schema.fields])
    for name in counts:
        schema = schema.add(name, LongType())
    for name in shares:
        schema = schema.add(name, DoubleType())
    schema = schema.add("base_failed", BooleanType()).add("kept", BooleanType())
    text_at, names = docs.columns.index(text_col), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(text_at))
            for lo, hi, d, o in blocks(data, offsets):
                m = measure(d, o, tuple(limits))
                total = np.maximum(m["word_chars"], 1)
                coverage = [m["dup_line_chars"] / total, *(m[f"dup_chars_{n}"] / total for n in limits)]
                failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                kept = ~failed
                for share, limit in zip(coverage, [line_limit, *limits.values()]):
                    kept &= share <= limit
                arrays = [column.slice(lo, hi - lo) for column in batch.columns]
                arrays += [pa.array(x) for x in (*(m[c] for c in counts), *coverage, failed, kept)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, schema)
