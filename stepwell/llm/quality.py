"""Quality classifier: a factorisation machine.

Inputs are the words of a text (hashed to ``BUCKETS`` rows, each occurrence weighing 1/n), and structure
statistics of the text (lengths, shares of kinds of characters and words, repetition, line forms). Every
input has a weight and a vector of ``RANK`` numbers; the score adds to the linear terms the dot products
of all pairs of vectors, in time linear in the inputs: half of (square of the sum - sum of the squares).

The model is fitted on the driver on at most ``MAX_ROWS`` labelled documents, chosen by a hash of the id,
a bounded sample that does not grow with the corpus. The fitted numbers (a few MB, fixed by BUCKETS and
RANK) are sent to all tasks; scoring is one pass without shuffles over whole texts.

Null texts are empty and get a score like any text; labels that are null or contradict each other for one id are not
used; of the texts of a repeated id the least is learned from; with fewer than two classes every score is the share of class 1 (0.5 if there is none).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, worker_state

BUCKETS = 1 << 14
RANK = 8
LONG = 64
MAX_ROWS = 3000
STATS = ("log_words", "log_chars", "mean_word", "upper", "digit", "sign", "odd_sign", "space", "non_ascii", "distinct", "caps_words", "signed_words", "bar_words", "mean_line", "repeated_lines", "bang_words", "short_lines", "one")
_SIGN, _ODD = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"#$%&*+<=>@\\^_`{|}~"
_UPPER, _DIGIT, _WIDE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(0xC0, 0x100))


class Buckets(dict):
    """Hash bucket by word, of at most ``limit`` words of ``LONG`` characters at a time."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        out = xxhash.xxh32_intdigest(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        if len(word) <= LONG:
            self[word] = out
        return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words, and the structure statistics (about 0 to 1 each)."""
    text = text or ""
    words, raw = text.split(), text.encode("utf-8", "surrogatepass")
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x]
    share = lambda k, of: k / of if of else 0.0
    count = lambda kind: len(raw) - len(raw.translate(None, kind))
    signs, odd, in_words = count(_SIGN), count(_ODD), sum(map(len, words))
    stats = np.array([
        math.log1p(n) / 10, math.log1p(chars) / 12, share(in_words, n) / 10, share(count(_UPPER), chars), share(count(_DIGIT), chars), share(signs, chars), share(odd, chars), share(chars - in_words, chars), share(count(_WIDE), chars),
        share(len(set(words)), n), share(sum(map(str.isupper, words)), n), share(odd, n), share(text.count("|"), n), min(share(chars, len(lines)) / 400, 3.0), share(len(lines) - len(set(lines)), len(lines)), share(text.count("!!"), n), share(sum(len(x) < 30 for x in lines), len(lines)), 1.0,
    ])
    return np.fromiter(map(worker_state("word buckets", Buckets).__getitem__, words), np.int32, n), stats


class FactorisationMachine:
    """Weights and vectors of words and statistics."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w, self.ws = np.zeros(BUCKETS), np.zeros(len(STATS))
        self.v, self.vs = rng.normal(0, 0.05, (BUCKETS, RANK)), rng.normal(0, 0.05, (len(STATS), RANK))
        self.mean, self.scale = np.zeros(len(STATS)), np.ones(len(STATS))
        self.constant: float | None = None

    def _parts(self, words: np.ndarray, z: np.ndarray) -> tuple[float, np.ndarray]:
        n = max(1, len(words))
        vw = self.v[words]
        s = vw.sum(axis=0) / n + z @ self.vs
        squares = (vw**2).sum(axis=0) / n**2 + (z**2) @ self.vs**2
        return self.bias + self.w[words].sum() / n + z @ self.ws + 0.5 * float((s**2 - squares).sum()), s

    def standard(self, stats: np.ndarray) -> np.ndarray:
        """Standardised statistics, within what training has seen."""
        return np.clip((stats - self.mean) / self.scale, -5, 5)

    def score(self, words: np.ndarray, stats: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        y, _ = self._parts(words, self.standard(stats))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, y))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 25, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> "FactorisationMachine":
        """AdaGrad on the logistic loss, both classes weighing the same."""
        ones = float(labels.mean()) if len(labels) else 0.5
        if ones in (0.0, 1.0) or not len(labels):
            self.constant = ones
            return self
        stats = np.array([s for _, s in rows])
        self.mean, self.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
        self.mean[-1], self.scale[-1] = 0.0, 1.0
        z = self.standard(stats)
        bags = [np.unique(w, return_counts=True) for w, _ in rows]
        gw, gs, gv, gvs, gb = np.full(BUCKETS, 1e-6), np.full(len(STATS), 1e-6), np.full((BUCKETS, RANK), 1e-6), np.full((len(STATS), RANK), 1e-6), 1e-6
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                (ids, counts), zi, y = bags[i], z[i], labels[i]
                n = max(1, int(counts.sum()))
                x = (counts / n)[:, None]
                score, s = self._parts(np.repeat(ids, counts), zi)
                g = (1 / (1 + math.exp(-min(30.0, max(-30.0, score)))) - y) * (0.5 / ones if y else 0.5 / (1 - ones))
                dw, dv = g * x[:, 0], g * (x * s - self.v[ids] * x / n) + decay * self.v[ids]
                ds, dvs = g * zi + decay * self.ws, g * (zi[:, None] * s - self.vs * (zi**2)[:, None]) + decay * self.vs
                gw[ids] += dw**2
                gv[ids] += dv**2
                gs += ds**2
                gvs += dvs**2
                gb += g * g
                self.w[ids] -= rate * dw / np.sqrt(gw[ids])
                self.v[ids] -= rate * dv / np.sqrt(gv[ids])
                self.ws -= rate * ds / np.sqrt(gs)
                self.vs -= rate * dvs / np.sqrt(gvs)
                self.bias -= rate * g / math.sqrt(gb)
        return self


def held_out(doc_id: int | None) -> bool:
    """True for ids that labels are never learned from."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> FactorisationMachine:
    """Fit on at most ``max_rows`` labelled rows whose crc32(id) mod 5 is not 0."""
    ids = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    ids = ids.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").drop("top")
    ids = ids.where(F.crc32(F.col("i").cast("string")) % 5 != 0).orderBy(F.xxhash64("i"), "i").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "i")
    texts = texts.groupBy("i", "y").agg(F.min("text").alias("text"))  # of an id with several texts, the least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [features(t) for t in b.column(1).to_pylist()]
            packed = [w.astype("<u2").tobytes() for w, _ in got]
            yield pa.record_batch([b.column(0), b.column(2).cast(pa.int32()), pa.array(packed, pa.binary()), pa.array([s.tolist() for _, s in got], pa.list_(pa.float64()))], names=["i", "y", "words", "stats"])

    rows = texts.select("i", "text", "y").mapInArrow(run, "i long, y int, words binary, stats array<double>").toLocalIterator()
    got = sorted(((r[0], r[1], np.frombuffer(bytes(r[2]), "<u2").astype(np.int32), np.array(r[3])) for r in rows), key=lambda r: r[0])
    return FactorisationMachine().fit([(r[2], r[3]) for r in got], np.array([r[1] for r in got], dtype=float))


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with __score (0 to 1) and __predicted (1 if the score reaches ``threshold``)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]  # inside, columns go by place: any name may come
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [sent.value.score(*features(t)) for t in b.column(at).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(got, pa.float64()), pa.array([int(x >= threshold) for x in got], pa.int32())], names=[*names, "score", "predicted"])

    placed = docs.toDF(*names)
    schema = placed.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    for f in schema.fields:
        f.nullable = True
    return placed.mapInArrow(run, schema).toDF(*docs.columns, "__score", "__predicted")
