"""Near-duplicates by DartMinHash signatures.

A document is a set of shingles of five words (fewer for shorter texts), each weighing as often as it occurs; two documents
are as similar as their weighted Jaccard index says (sum of the lesser weights over sum of the greater). Darts are
thrown at the plane over each element: in the strip of weights [0, 1), [1, 2), [2, 4) ... they arrive as a
Poisson process in rank, each at a hashed height and for a hashed coordinate. Those below the element's
weight and below a rank bound (set so that about k ln k + 2k fall into the document's region, whatever
its size) are looked at; the earliest of each coordinate is its signature value. Two documents agree in a
coordinate with probability equal to their similarity, and a signature costs
O(size + k log k).

1. Documents with equal weighted sets form a group by a 128-bit digest (partial aggregates, no skew);
   only one representative of each goes on.
2. Signatures are cut into ``BANDS`` bands of ``ROWS`` coordinates. Representatives that share a band
   form a bucket. Each is compared with the bucket's centre (least hash), not with each other: a
   bucket of m gives m - 1 pairs.
3. Pairs are verified by their exact similarity; links give classes.
4. The rest exactly: buckets that still hold several classes are searched pair by pair, in blocks of
   bounded size that meet two at a time in a task. Overlaps are counted inside the task, which returns
   only the links that join classes, so no bucket is capped and no pair becomes a row.
5. Classes are connected components, labelled by their least doc_id: labels spread along links and
   jump, each round a table in the shared folder.

Joins by a hot key (all members of a bucket or of a class) carry a few numbers a row, and are plain equi-joins without
aggregates on top of the hot side, which adaptive execution splits; aggregates by such keys are partial.

Null texts are empty; all texts without a word form one class. Rows that share a doc_id are one document (of
unlike texts the one with the least digest); rows without a doc_id get no class. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, worker_state

BANDS, ROWS, SHINGLE, SIMILARITY = 24, 6, 5, 0.8
LONG = 64
#: Shingles in a block of step 4, about (8 bytes each).
BLOCK = 1 << 17
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """Hashes of at most ``limit`` words of ``LONG`` characters."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONG:
            self[word] = out
        return out


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and how often each occurs. Words are lower-case, between white space."""
    words = (text or "").lower().split()
    w = np.fromiter(map(worker_state("shingle words", _Hashes).__getitem__, words), _U, len(words))
    if not len(w):
        return w, np.empty(0, np.int64)
    k = min(size, len(w))
    with np.errstate(over="ignore"):
        h = mix64(w[: len(w) - k + 1] + _U(k))
        for i in range(1, k):
            h = mix64(h * _U(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h, return_counts=True)


def dart_minhash(elements: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS, seed: int = 0) -> np.ndarray:
    """``k`` signature values of a weighted set (weights None: 1 each); all 0 for an empty one."""
    if weights is None:
        weights = np.ones(len(elements))
    keep = weights > 0
    elements, weights = elements[keep], weights[keep]
    if not len(elements):
        return np.zeros(k, _U)
    bound = (k * math.log(k) + 2 * k) / float(weights.sum())
    while True:
        ranks, coords, names = _darts(elements, weights, bound, k, seed)
        order = np.argsort(-ranks, kind="stable")  # the earliest is written last
        out, hit = np.zeros(k, _U), np.zeros(k, bool)
        out[coords[order]] = names[order]
        hit[coords] = True
        if hit.all():
            return out
        bound *= 2


def _darts(elements: np.ndarray, weights: np.ndarray, bound: float, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts below the weights and below rank ``bound``: rank, coordinate, name."""
    found, lo, hi, strip = [], 0.0, 1.0, 0
    top = float(weights.max())
    with np.errstate(over="ignore"):
        while lo < top:
            inside = weights > lo
            e, w, wide = elements[inside], weights[inside], hi - lo
            base = mix64(e ^ _U((seed * 0x51ED27 + strip * 0xA24BAED4963EE407 + 1) & (2**64 - 1)))
            rank, j = np.zeros(len(e)), 0
            n = int(bound * wide + 4 * math.sqrt(bound * wide)) + 1
            while len(e):
                number = np.arange(j, j + n, dtype=_U) + _U(1)
                a = mix64(base[:, None] + number[None, :] * _U(0x9E3779B97F4A7C15))
                gaps = -np.log(((a >> _U(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / wide
                at = np.cumsum(gaps, axis=1) + rank[:, None]
                ok = at <= bound
                name = a[ok]
                b = mix64(name + _U(0xD1B54A32D192ED03))
                if wide == 1.0 and w.min() >= hi:
                    keep = slice(None)
                else:
                    height = lo + wide * ((b >> _U(40)).astype(np.float64) / 16777216.0)
                    keep = height < np.broadcast_to(w[:, None], ok.shape)[ok]
                found.append((at[ok][keep], ((b & _U(0xFFFFFFFF)) % _U(k)).astype(np.int64)[keep], name[keep]))
                more = at[:, -1] <= bound
                e, w, base, rank, j = e[more], w[more], base[more], at[more, -1], j + n
                n = max(8, n // 2)
            lo, hi, strip = hi, hi * 2, strip + 1
    return tuple(np.concatenate(x) for x in zip(*found))


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band, the band's number hashed in."""
    rows = signature.reshape(bands, -1)
    with np.errstate(over="ignore"):
        h = mix64(np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
        for i in range(rows.shape[1]):
            h = mix64(h * _U(0xBF58476D1CE4E5B9) + rows[:, i])
    return h.view(np.int64)


#: A weighted set: sorted distinct hashes, and their weights.
Weighted = tuple[np.ndarray, np.ndarray]


def jaccard(a: Weighted, b: Weighted) -> float:
    """Weighted similarity; 1 for two empty sets."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    (small, w), (large, v) = (a, b) if len(a[0]) < len(b[0]) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    same = large[at] == small
    both = int(np.minimum(w[same], v[at[same]]).sum())
    return both / (int(w.sum()) + int(v.sum()) - both)


def packed(s: Weighted) -> tuple[bytes, bytes]:
    """A weighted set as bytes; no weights where all are 1."""
    return s[0].tobytes(), s[1].astype("<i4").tobytes() if (s[1] != 1).any() else b""


def unpacked(hashes: bytes, times: bytes) -> Weighted:
    s = np.frombuffer(hashes, _U)
    return s, np.frombuffer(times, "<i4").astype(np.int64) if times else np.ones(len(s), np.int64)


def set_digest(s: Weighted) -> bytes:
    return xxhash.xxh3_128_digest(b"".join(packed(s)))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the weighted set), n (distinct shingles), keys (of the bands); empty texts have no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            digest, n, keys = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                digest.append(set_digest(s))
                n.append(len(s[0]))
                keys.append(band_keys(dart_minhash(s[0], s[1].astype(float))) if len(s[0]) else np.empty(0, np.int64))
            yield pa.record_batch([b.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, digest binary, n int, keys array<bigint>")


def one_text_an_id(signed: DataFrame) -> DataFrame:
    """``signed`` with the rows of the least digest of each doc_id."""
    ids = signed.groupBy(F.col("doc_id").alias("id")).agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    clash = materialise(ids.where("least <> most").select("id", "least"), "unlike-texts")
    if clash.isEmpty():
        return signed
    return signed.join(clash, F.col("doc_id") == F.col("id"), "left").where("least is null or digest = least").drop("id", "least")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, set, times (see ``packed``) of the documents in ``ids`` (column doc_id), one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [shingles(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*[(set_digest(s), *packed(s)) for s in got]))
            yield pa.record_batch([b.column(0), *[pa.array(c, pa.binary()) for c in cols]], names=["doc_id", "digest", "set", "times"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = rows.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, digest binary, set binary, times binary")
    return made.groupBy("doc_id").agg(F.min(F.struct("digest", "set", "times")).alias("x")).select("doc_id", "x.set", "x.times")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose exact similarity reaches ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = [b.column(i).to_pylist() for i in range(2, 6)]
            ok = pa.array([jaccard(unpacked(p, v), unpacked(q, w)) >= similarity for p, v, q, w in zip(*cols)], pa.bool_())
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(ok)

    left, right = sets.toDF("a", "set_a", "times_a"), sets.toDF("b", "set_b", "times_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "times_a", "set_b", "times_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node it is linked with, through others too) of all nodes in ``links`` (a, b)."""
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.toDF("b", "l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "l").alias("low"))
        jump = labels.toDF("low", "far")
        now = low.join(jump, "low", "left").select("node", F.least("low", "far").alias("next"), "label")
        now = materialise(now, "labels")
        labels = now.select("node", F.col("next").alias("label"))
        if now.where("next <> label").isEmpty():
            return labels


def block_links(rep: np.ndarray, label: np.ndarray, part: np.ndarray, weighted: list[Weighted], similarity: float) -> list[tuple[int, int]]:
    """Links that join different classes among the rows of a block, as few as join them all.

    If ``part`` has two values only pairs across them are looked at. Overlaps are counted through the
    rows of each shingle, for all documents outside the largest class.
    """
    m = len(weighted)
    sizes = np.array([int(w.sum()) for _, w in weighted])
    owner, found = np.repeat(np.arange(m), [len(x) for x, _ in weighted]), []
    values, at, often = np.unique(np.concatenate([x for x, _ in weighted]), return_inverse=True, return_counts=True)
    shared = often[at] > 1
    at, owner, weight = at[shared], owner[shared], np.concatenate([w for _, w in weighted])[shared]
    order = np.argsort(at, kind="stable")
    rows, weights = owner[order], weight[order]
    ends = np.cumsum(np.bincount(at, minlength=len(values)))
    split = np.searchsorted(owner, np.arange(m + 1))
    across = part.min() != part.max()
    top = {int(x): int(x) for x in label}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    names, members = np.unique(label, return_counts=True)
    largest = names[int(members.argmax())]
    for i in np.flatnonzero(label != largest):
        mine = at[split[i] : split[i + 1]]
        if not len(mine):
            continue
        many = often[mine]
        place = np.repeat(ends[mine] - np.cumsum(many), many) + np.arange(int(many.sum()))
        both = np.bincount(rows[place], np.minimum(weights[place], np.repeat(weight[split[i] : split[i + 1]], many)), m)
        near = (both >= similarity * (sizes + sizes[i] - both)) & (label != label[i])
        if across:
            near &= part != part[i]
        for j in np.flatnonzero(near):
            x, y = root(int(label[i])), root(int(label[j]))
            if x != y:
                top[max(x, y)] = min(x, y)
                found.append((int(rep[i]), int(rep[j])))
    return found


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links across classes in buckets with several: every pair of such a bucket is looked at, in blocks.

    Buckets with the same members are searched once. A bucket with more than ``block`` shingles is dealt
    to blocks by a hash, and each two blocks meet in a task: memory is bounded, no pair becomes a row.
    """
    now = members.join(labels.toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    keys = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m"), F.sum("n").alias("n"), F.expr("bit_xor(xxhash64(rep))").alias("who")).where("x < y")
    keys = keys.groupBy("who", "m", "n").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = now.join(keys, "key").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "rep", "label", "part").join(sets.toDF("rep", "set", "times"), "rep")

    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, label, part = (table[c].to_numpy() for c in ("rep", "label", "part"))
        got = []
        if len(rep) > 1 and label.min() != label.max():
            got = block_links(rep, label, part, [unpacked(*x) for x in zip(table["set"].to_pylist(), table["times"].to_pylist())], similarity)
        return pa.table([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

    return rows.groupBy("key", "i", "j").applyInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), one row a document."""
    signed = one_text_an_id(materialise(signatures(docs, id_col, text_col), "signatures"))
    reps = materialise(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "representatives")
    rows = reps.select("rep", "n", F.explode("keys").alias("key"))
    centres = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep"), "rep")).alias("c"), F.count("*").alias("m")).where("m > 1")
    members = materialise(rows.join(centres.select("key", F.col("c.rep").alias("centre")), "key"), "bucket-members")
    pairs = members.where("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialise(shingle_sets(docs, ids, id_col, text_col), "shingle-sets")
    links = materialise(verified(pairs, sets, similarity), "star-links")
    labels = components(links)
    more = materialise(_rest(members, labels, sets, similarity), "rest-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    own = signed.select("doc_id", "digest").join(reps.select("digest", "rep"), "digest")
    got = own.join(labels.toDF("rep", "label"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"))
    return got.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
