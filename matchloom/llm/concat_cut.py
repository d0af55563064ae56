"""Packing: concatenate and cut.

Two passes.  The first encodes each text once, appends the end id and keeps the
ids with their place within their partition.  The totals of the partitions (one
number each) give, as prefix sums, where every partition begins in the stream of
all ids.  The second pass cuts each document where the stream passes a multiple
of the window; every piece is a boundary record.

The stream's order is the order of the partitions of the input.  Windows are
full but for the last one, so padding is below one window for the whole corpus.
The last window is cut into descending powers of two where that is shorter than
padding it, which leaves no padding at all: sequences of a power of two need none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .encoding import unit_encoder
from .storage import materialise
from .textarrays import blocks, text_buffers

TOKEN_SCHEMA = "part int, local_start long, doc_id long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(ids: np.ndarray, wide: bool) -> bytes:
    return ids.astype("<u4" if wide else "<u2").tobytes()


def encode_documents(docs: DataFrame, path: str, mode: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each document with its end id, and their place within the partition.

    Null or empty text: the end id alone.  A null id stays null.  Written to the
    shared folder, so that texts are encoded once.  Ids take two bytes where the
    vocabulary allows it, else four (``ids`` starts with the width).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(path, mode)
        wide = max(encoder.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi, d, o in blocks(data, offsets):
                ids, count = encoder.encode(d, o)
                ids = ids.astype("<u4" if wide else "<u2")
                ends = np.cumsum(count)
                tail = np.array([end_id], ids.dtype).tobytes()
                head = b"\x04" if wide else b"\x02"
                payload = [head + ids[e - c : e].tobytes() + tail for e, c in zip(ends.tolist(), count.tolist())]
                starts = place + np.cumsum(count + 1) - (count + 1)
                place = int(starts[-1] + count[-1] + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, part, np.int32)), pa.array(starts), batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(payload, pa.binary())], names=["part", "local_start", "doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, TOKEN_SCHEMA), "tokens")


def partition_starts(tokens: DataFrame) -> tuple[dict[int, int], int]:
    """First place of each partition in the stream, and the stream's length.

    One row for each partition of the input comes to the driver, never more.
    """
    ends = tokens.groupBy("part").agg(F.max(F.col("local_start") + (F.length("ids") - 1) / F.when(F.substring("ids", 1, 1) == F.lit(b"\x04"), 4).otherwise(2)).cast("long").alias("total")).collect()
    starts, place = {}, 0
    for row in sorted(ends, key=lambda r: r["part"]):
        starts[row["part"]] = place
        place += row["total"]
    return starts, place


def window_edges(total: int, window: int) -> np.ndarray:
    """Ends of the sequences in the last, incomplete window: descending powers of two."""
    rest, place, ends = total % window, total - total % window, []
    while rest:
        size = 1 << (rest.bit_length() - 1)
        place, rest = place + size, rest - size
        ends.append(place)
    return np.array(ends, np.int64)


def pack(docs: DataFrame, path: str, mode: str = "word", window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece; with ``with_ids`` also its ids (little-endian, 4 bytes).

    Each id lies in exactly one piece; offsets within a sequence leave no gap.
    Null ids and repeated rows are packed like any other document.  An empty
    table gives no rows.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    tokens = encode_documents(docs, path, mode, end_id, id_col, text_col)
    base, total = partition_starts(tokens)
    full, tail = total // window, window_edges(total, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for part, local, doc, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
                wide = raw[0] == 4
                ids = np.frombuffer(raw, "<u4" if wide else "<u2", offset=1).astype("<u4")
                at, n, done = base[part] + local, len(ids), 0
                while done < n:
                    place = at + done
                    if place < full * window:
                        sequence, offset = divmod(place, window)
                        end = (sequence + 1) * window
                    else:
                        k = int(np.searchsorted(tail, place, "right"))
                        sequence, offset, end = full + k, place - (int(tail[k - 1]) if k else full * window), int(tail[k])
                    size = min(n - done, end - place)
                    piece = ids[done : done + size].tobytes()
                    for column, value in zip(out, (doc, done, size, zlib.crc32(piece), n, sequence, offset, piece if with_ids else None)):
                        column.append(value)
                    done += size
            arrays = [pa.array(x, pa.int64()) for x in out[:7]] + ([pa.array(out[7], pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=[*(x.split()[0] for x in PIECE_SCHEMA.split(", ")), *(["ids"] if with_ids else [])])

    return tokens.mapInArrow(run, PIECE_SCHEMA + (", ids binary" if with_ids else ""))
