"""Document fingerprints: canonical exact digests.

A text is made canonical (Unicode NFKC, case folded, runs of white space to one space, ends trimmed) and
hashed to 128 bits by xxh3. Texts with one digest form a bucket; inside a bucket the canonical bytes
are compared, by collecting the distinct ones: a partial aggregate before any shuffle, so that a
bucket with a third of all rows sends one text per task. Where there is one, all are equal; otherwise (a collision)
fingerprints of that digest are widened by the canonical text's SHA-256 after a dash. Two fingerprints are equal
if and only if the canonical texts are (of colliding ones: if their SHA-256 is, too).

Null texts count as empty; empty texts share the digest of "". Repeated rows have equal fingerprints, rows without an
id come first (their order: a hash of the text), other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ordered, slices, small

#: Bits of a digest; fewer only in tests, to make texts collide.
BITS = 128
#: Colliding digests that are told apart one by one; beyond (no real case), all fingerprints are widened.
MOST_WIDE = 10_000


def canonical(text: str | None) -> str:
    text = unicodedata.normalize("NFKC", text or "")
    return " ".join(unicodedata.normalize("NFKC", text.casefold()).split())


def digest(canon: str, bits: int = BITS) -> str:
    return f"{xxhash.xxh3_128_intdigest(canon.encode('utf-8', 'surrogatepass')) >> (128 - bits):0{bits // 4}x}"


class Digester:
    """Fingerprints of canonical texts; ``wide``: digests that several texts share (None: all)."""

    def __init__(self, bits: int, wide: frozenset[str] | None = frozenset()) -> None:
        self.bits, self.wide = bits, wide

    def __call__(self, canon: str) -> str:
        d = digest(canon, self.bits)
        return f"{d}-{hashlib.sha256(canon.encode('utf-8', 'surrogatepass')).hexdigest()}" if self.wide is None or d in self.wide else d


def collisions(docs: DataFrame, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """digest of each bucket that holds different canonical texts: empty but for collisions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            canon = [canonical(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([pa.array([digest(c, bits) for c in canon], pa.string()), pa.array([c.encode("utf-8", "surrogatepass") for c in canon], pa.binary())], names=["digest", "canon"])

    rows = docs.select(F.lit(0).alias("x"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "digest string, canon binary")
    texts = rows.groupBy("digest").agg(F.size(F.collect_set("canon")).alias("n"))  # the set has one member but for collisions
    return materialise(texts.where("n > 1").select("digest"), "digest-collisions")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(text: str, nxt: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + nxt[:k] if k else text


def _row(print_of: Digester, doc: int | None, text: str, canon: str, nxt: str, nxt_canon: str) -> tuple:
    edited = _edit(text, nxt)
    ec = canonical(edited)
    return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_of(canon), print_of(ec), float(ec == canon), float(nxt_canon == canon)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Fingerprints of each text and of the text with its last quarter taken from the next document.

    Documents are range-partitioned by id; each partition knows the next document of all its rows but
    the last. Of each partition the first and last document are kept aside, and these two rows a
    partition are joined in a second, small step. The last document's next is the first.
    """
    clash = collisions(docs, text_col, bits).limit(MOST_WIDE + 1).collect()
    print_of = Digester(bits, frozenset(r[0] for r in clash) if len(clash) <= MOST_WIDE else None)
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 10
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, [*kinds, pa.int32(), pa.bool_(), pa.string()])], names=[*names, "part", "first", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                canon = canonical(text)
                if held is None:
                    rows.append((doc, *[None] * 6, part, True, text))
                else:
                    rows.append((*_row(print_of, *held, text, canon), None, None, None))
                held = doc, text, canon
            yield batch(rows)
        if held is not None:
            yield batch([(held[0], *[None] * 6, part, False, held[1])])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8):
            rows = [_row(print_of, d, t, canonical(t), n, canonical(n)) for d, t, n in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    rows = ordered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text")
    made = materialise(rows.mapInArrow(run, OUT + ", part int, first boolean, text string"), "fingerprints")
    parts = [r[0] for r in made.where("first").select("part").orderBy("part").collect()]  # a number a partition
    follows = {p: parts[(i + 1) % len(parts)] for i, p in enumerate(parts)}
    pairs = docs.sparkSession.createDataFrame([*follows.items()] or [(-1, -1)], "part int, next int")
    last = made.where("not first").select("part", "doc_id", F.col("text").alias("t"))
    first = made.where("first").select(F.col("part").alias("next"), F.col("text").alias("n"))
    joined = last.join(small(pairs, len(parts)), "part").join(first, "next").select("doc_id", F.coalesce("t", F.lit("")), F.coalesce("n", F.lit("")))
    return made.where("first is null").select(*names).unionByName(joined.mapInArrow(ends, OUT))
