"""Packing (concatenate and cut).

All documents form one stream of token ids; the stream is cut into windows of ``seq_len``. Pass one
tokenises each partition once and writes the ids with their offset inside the partition. Prefix sums
over the partitions' token totals (one number a partition) give global offsets, joined by partition. Pass two cuts the
stored ids at multiples of ``seq_len``; the first and last window of a partition are boundary records
that ``sequences`` joins across partitions. Nothing is sorted and no text is shuffled.

Null texts count as empty (they still have the end id), repeated rows are packed as often as they
stand there, an empty table gives no pieces, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, materialise, slices, with_offsets
from .tokens import encoded, encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one, as a table in the shared folder: doc_id, part, local (offset in its partition), n, ids (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local = TaskContext.get().partitionId(), 0
        for b, ids, n in encoded(batches, tokenizer, 1):
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            at = np.cumsum([local, *n])
            yield pa.record_batch([b.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(at[:-1], pa.int64()), pa.array(n, pa.int64()), binary_rows(ids, n)], names=["doc_id", "part", "local", "n", "ids"])
            local = int(at[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, "doc_id long, part int, local long, n long, ids binary"), "packed-ids")


def id_bytes(tokenizer: str) -> int:
    return encoder(tokenizer).dtype.itemsize


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document inside a window of ``seq_len`` ids.

    doc_id, start (its ids before the piece), length, ids_crc32 (of little-endian 32-bit ids),
    doc_tokens (with the end id), sequence_id, offset (in the sequence), boundary (the window
    goes on in another partition) and, if asked for, the ids as little-endian 32-bit bytes.
    Only the very last sequence is shorter than ``seq_len``.
    """
    if seq_len < 1:
        raise ValueError("seq_len must be positive")
    ids = tokenised(docs, tokenizer, end_id, id_col, text_col)
    kind = "<u2" if id_bytes(tokenizer) == 2 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            out: list[list] = [[] for _ in range(9)]
            for doc, local, n, raw, first, total in zip(*(c.to_pylist() for c in b.columns)):
                at, wide, done, last = first + local, np.frombuffer(raw, kind).astype("<u4"), 0, first + total
                while done < n:
                    seq, off = divmod(at + done, seq_len)
                    take = min(n - done, seq_len - off)
                    piece = wide[done : done + take]
                    edge = seq * seq_len < first or (seq + 1) * seq_len > last
                    for x, v in zip(out, (doc, done, take, zlib.crc32(piece), n, seq, off, edge, piece.tobytes() if with_ids else None)):
                        x.append(v)
                    done += take
            kinds = [*[pa.int64()] * 7, pa.bool_(), pa.binary()]
            names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"]
            k = 9 if with_ids else 8
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out[:k], kinds)], names=names[:k])

    placed = with_offsets(ids, "part", "n").select("doc_id", "local", "n", "ids", "__before", "__total")
    return placed.mapInArrow(run, PIECE + ", ids binary" * with_ids)


def sequences(pieces: DataFrame, seq_len: int = 1024, pad_id: int = 0) -> DataFrame:
    """Sequences from ``pack(..., with_ids=True)``: sequence_id, input_ids, n_tokens, doc_ids, doc_offsets.

    Pieces meet by sequence_id, at most ``seq_len`` of them; the last sequence is padded with ``pad_id``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            rows = [np.frombuffer(b"".join(x), "<u4") for x in b.column(1).to_pylist()]
            padded = [np.concatenate([r, np.full(seq_len - len(r), pad_id, "<u4")]).astype("<i4") for r in rows]
            yield pa.record_batch([b.column(0), pa.array(padded, pa.list_(pa.int32())), pa.array([len(r) for r in rows], pa.int32()), b.column(2), b.column(3)], names=["sequence_id", "input_ids", "n_tokens", "doc_ids", "doc_offsets"])

    got = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return got.select("sequence_id", F.col("p.ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("doc_offsets")).mapInArrow(run, "sequence_id long, input_ids array<int>, n_tokens int, doc_ids array<long>, doc_offsets array<long>")
