"""Token-id output in Arrow files of equal-length sequences.

Documents are range-partitioned and sorted by id; each partition encodes its texts and writes one
Arrow file whose record batches hold ``fixed_size_list`` columns: ``ids`` (``seq_len`` token ids) and
``mask`` (true for ids, false for the padding of the file's last sequence). Sequences have equal length
and lie next to each other, so token t of a file is at value ``t % (seq_len * batch)`` of batch
``t // (seq_len * batch)``: a reader maps the file and slices, without copying or scanning.
An index table tells for each document its file, offset in it and length; prefix sums over the files'
totals (one number a file, joined by partition) give the offset in the whole corpus.

A file is written under a name of its own for each task attempt and put in place by a rename; only the
attempt whose index rows were committed is ever read. Null texts count as empty (the end id is still
written), repeated ids follow each other by a hash of their text, null ids come first, other columns
are ignored, and an empty table gives no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path, ordered, slices, with_offsets
from .tokens import encoded, encoder

INDEX = "doc_id long, part int, file string, local long, n_tokens long"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class SequenceWriter:
    """Streams token ids into one Arrow file; holds at most one record batch."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, seq_len: int, batch: int) -> None:
        self.seq_len, self.room, self.dtype = seq_len, seq_len * batch, dtype
        value = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(value, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def _flush(self, ids: np.ndarray, mask: np.ndarray) -> None:
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.room:
            whole = np.concatenate(self.held)
            for at in range(0, self.n - self.n % self.room, self.room):
                self._flush(whole[at : at + self.room], np.ones(self.room, bool))
            self.held = [whole[self.n - self.n % self.room :]]
            self.n %= self.room

    def close(self) -> None:
        if self.n:
            whole = np.concatenate(self.held)
            short = -len(whole) % self.seq_len
            self._flush(np.concatenate([whole, np.zeros(short, self.dtype)]), np.concatenate([np.ones(len(whole), bool), np.zeros(short, bool)]))
        self.writer.close()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, seq_len: int = 1024, batch: int = 256, out: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to ``out`` (default: the shared folder); returns the index table, already written:
    doc_id, part, file, local, n_tokens."""
    out = out or new_path(docs.sparkSession, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        name, local = f"part-{part:06d}-{uuid.uuid4().hex}.arrow", 0
        fs, folder = _open(out)
        for b, ids, n in encoded(batches, tokenizer, 1):
            if writer is None:
                fs.create_dir(folder, recursive=True)
                sink = fs.open_output_stream(f"{folder}/_{name}")
                writer = SequenceWriter(sink, encoder(tokenizer).dtype, seq_len, batch)
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            writer.add(ids)
            at = np.cumsum([local, *n])
            local = int(at[-1])
            yield pa.record_batch([b.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array([f"{out}/{name}"] * len(n), pa.string()), pa.array(at[:-1], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "part", "file", "local", "n_tokens"])
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(f"{folder}/_{name}", f"{folder}/{name}")

    rows = ordered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text")
    return materialise(rows.mapInArrow(run, INDEX), "token-index")


class SequenceFile:
    """Random access to a token file: ``tokens(at, n)`` touches only the batches that hold them."""

    def __init__(self, path: str) -> None:
        fs, name = _open(path)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(name) if local else fs.open_input_file(name)
        self.reader = pa.ipc.open_file(self.source)
        first = self.reader.get_batch(0) if self.reader.num_record_batches else None
        self.room = first.num_rows * first.column(0).type.list_size if first else 1
        self.seq_len = first.column(0).type.list_size if first else 0

    def tokens(self, at: int, n: int) -> np.ndarray:
        out = []
        while n > 0:
            k, off = divmod(at, self.room)
            take = min(n, self.room - off)
            batch = self.reader.get_batch(k)
            if not batch.column(1).flatten().slice(off, take).true_count == take:
                raise ValueError("padding inside a document")
            out.append(batch.column(0).flatten().slice(off, take).to_numpy())
            at, n = at + take, n - take
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint32)

    def close(self) -> None:
        self.source.close()


def read_tokens(index: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    and, if asked for, the ids as little-endian 32-bit bytes. Each file is opened once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = "", None
        for b in slices(batches, 1024):
            files, local, n = (b.column(i).to_pylist() for i in (2, 3, 4))
            crc, raw = [], []
            for f, at, k in zip(files, local, n):
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, SequenceFile(f)
                ids = file.tokens(at, k).astype("<u4")
                crc.append(zlib.crc32(ids))
                raw.append(ids.tobytes() if with_ids else None)
            cols = [b.column(0), pc.add(b.column(5), b.column(3)), b.column(4), pa.array(crc, pa.int64())]
            yield pa.record_batch(cols + [pa.array(raw, pa.binary())] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])
        if file is not None:
            file.close()

    placed = with_offsets(index, "part", "n_tokens").select(*[c.split()[0] for c in INDEX.split(", ")], "__before")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
