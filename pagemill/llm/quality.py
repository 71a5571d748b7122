"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a calibrated probability.

Each word (and each run of punctuation, and each word shape) falls into one of
BUCKETS by its hash and has a sparse random index vector; its word vector is the
sum of the index vectors of its neighbours over the whole corpus. The table of
word vectors has a fixed size, so partitions sum their own and only tables are
added up. A document is the mean and the deviation of its words' vectors.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, as_bytes, batch, byte_runs, mix64, slices, stored

BUCKETS, DIMS, NONZERO = 8192, 32, 2
#: Words on each side that count as neighbours.
REACH = 2
#: Labelled rows that the network is fitted on at most, in a seeded order of their ids.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, SEED = 32, 60, 11
THRESHOLD = 0.7
#: Bytes of text that are worked on at once; what a task holds beside an Arrow batch depends on this alone.
_SLICE = 256 << 10
_BLOCK = 256
_SHAPES = 8
_BASE = 0xA0761D6478BD642F
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E6C63D0876A9A35))
_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_KIND = np.where(_WORD, 1, np.where(np.arange(256) <= 32, 0, 2)).astype(np.int8)
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The dimensions and signs of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMS, (BUCKETS + _SHAPES, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS + _SHAPES, NONZERO))


@lru_cache
def _powers(base: int, size: int) -> np.ndarray:
    x = np.full(size, base, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


def _parts(texts: list[bytes | None]):
    """The texts as lists of (text number, piece) of about _SLICE bytes; longer texts are cut at white space.

    Only a word that fills a whole slice is cut itself.
    """
    part, held = [], 0
    for i, text in enumerate(texts):
        text, at = text or b"", 0
        while at < len(text):
            stop = min(len(text), at + _SLICE)
            if stop < len(text):
                stop = max(text.rfind(b" ", at, stop), text.rfind(b"\n", at, stop)) + 1 or stop
            part.append((i, text[at:stop]))
            held += stop - at + 1
            at = stop
            if held >= _SLICE // 2:
                yield part
                part, held = [], 0
    if part:
        yield part


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, shape bucket) of each token of some texts, in order."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[data]
    edge = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1], True])
    first, last = edge[:-1], edge[1:]
    real = kind[first] > 0
    first, last = first[real], last[real]
    room = max(2 * _SLICE, len(data))
    total = np.r_[np.uint64(0), np.add.accumulate(_BYTES[data] * _powers(_BASE, room)[: len(data)])]
    h = mix64((total[last] - total[first]) * _powers(_INVERSE, room)[first] + (last - first).astype(np.uint64))
    bucket = (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    count = lambda table: np.r_[0, np.cumsum(table[data])]
    upper, lower, digit = (c[last] - c[first] for c in map(count, (_UPPER, _LOWER, _DIGIT)))
    size = last - first
    shape = np.select([kind[first] == 2, digit > 0, (upper > 1) & (lower == 0), (upper == 1) & _UPPER[data[first]], upper > 1, lower > 0], [0 + (size > 1), 2, 3, 4, 5, 6], 7)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(ends, first, "right"), bucket, BUCKETS + shape


def _context(batches):
    """A partition's table of word vectors, in blocks of buckets."""
    import pyspark

    schema = arrow_schema("block int, part int, vectors binary")
    dims, signs = index_vectors()
    rows = BUCKETS + _SHAPES
    table = np.zeros(rows * DIMS)
    for (texts,) in slices(batches, "text", size=_SLICE):
        last, tails = -1, [np.empty(0, np.int64)] * 2
        for part in _parts(texts):
            doc, bucket, shape = tokens([piece for _, piece in part])
            doc = np.array([i for i, _ in part])[doc]
            if not len(doc):
                continue
            if doc[0] != last:
                tails = [t[:0] for t in tails]
            # the last words of a text's former piece stand before this one's
            known = len(tails[0])
            whole = np.r_[np.full(known, last), doc]
            last = int(doc[-1])
            # words meet words, shapes meet shapes
            for which, ids in enumerate((bucket, shape)):
                own = np.r_[tails[which], ids]
                for step in range(1, REACH + 1):
                    near = whole[step:] == whole[:-step]
                    near[: max(0, known - step)] = False
                    left, right = own[:-step][near], own[step:][near]
                    for a, b in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            table += np.bincount(a * DIMS + dims[b, k], signs[b, k], rows * DIMS)
                tails[which] = own[-REACH:][whole[-REACH:] == last]
    table = table.astype(np.int64).reshape(rows, DIMS)
    part = pyspark.TaskContext.get().partitionId()
    for k in range(0, rows, _BLOCK):
        yield batch(schema, [k // _BLOCK], [part], [table[k : k + _BLOCK].tobytes()])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors of all texts, of unit length (BUCKETS + shapes rows, whatever the corpus' size)."""

    def add(key, rows):
        import pandas as pd

        total = sum(np.frombuffer(v, np.int64) for v in rows["vectors"])
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "part": [rows["part"].iloc[0]], "vectors": [total.tobytes()]})

    out = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_context, "block int, part int, vectors binary")
    for fan in (64, 1):
        out = out.withColumn("part", F.pmod("part", F.lit(fan))).groupBy("block", "part").applyInPandas(add, "block int, part int, vectors binary")
    table = np.concatenate([np.frombuffer(r.vectors, np.int64).reshape(-1, DIMS) for r in out.orderBy("block").collect()] or [np.zeros((BUCKETS + _SHAPES, DIMS))])
    return (table / np.maximum(1e-9, np.linalg.norm(table, axis=1, keepdims=True))).astype(np.float32)


def pooled(texts: list[bytes | None], vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the vectors of each text's words and of their shapes, and the mean product of neighbours' vectors.

    The last is near one where a text repeats a word on end; zeros for a text
    without tokens. Sums are taken piece by piece, so that a long text holds no
    more than a short one.
    """
    sums, n = np.zeros((len(texts), 5 * DIMS)), np.zeros(len(texts))
    last, tail = -1, None
    for part in _parts(texts):
        doc, bucket, shape = tokens([piece for _, piece in part])
        if not len(doc):
            continue
        doc = np.array([i for i, _ in part])[doc]
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        own = doc[head]
        n[own] += np.diff(np.r_[head, len(doc)])
        for k, ids in enumerate((bucket, shape)):
            v = vectors[ids]
            sums[own, 2 * k * DIMS : (2 * k + 1) * DIMS] += np.add.reduceat(v, head, axis=0)
            sums[own, (2 * k + 1) * DIMS : (2 * k + 2) * DIMS] += np.add.reduceat(v * v, head, axis=0)
            if not k:
                if own[0] == last:
                    sums[last, 4 * DIMS :] += tail * v[0]
                last, tail = int(own[-1]), v[-1].copy()
                v[:-1] *= v[1:]
                v[np.r_[head[1:], len(v)] - 1] = 0
                sums[own, 4 * DIMS :] += np.add.reduceat(v, head, axis=0)
    sums /= np.maximum(n, 1)[:, None]
    for k in (0, 2):
        mean, square = sums[:, k * DIMS : (k + 1) * DIMS], sums[:, (k + 1) * DIMS : (k + 2) * DIMS]
        spread = square - mean * mean
        # what rounding leaves of equal vectors is no deviation
        square[:] = np.sqrt(np.where(spread > 1e-6 * square, spread, 0))
    return sums.astype(np.float32)


class Network:
    """Two layers with tanh between, fitted by Adam on the logistic loss, then divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-4
        x = (x - self.shift) / self.scale
        hold = rng.random(len(x)) < 0.2 if len(x) >= 50 else np.zeros(len(x), bool)
        fit_x, fit_y = x[~hold], y[~hold].astype(float)
        d = x.shape[1]
        w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(fit_x))
            for s in range(0, len(order), 256):
                rows = order[s : s + 256]
                a = fit_x[rows]
                h = np.tanh(a @ w[0] + w[1])
                e = (_sigmoid(h @ w[2] + w[3]) - fit_y[rows]) / len(rows)
                back = np.outer(e, w[2]) * (1 - h * h)
                grad = [a.T @ back + 1e-4 * w[0], back.sum(0), h.T @ e + 1e-4 * w[2], np.array([e.sum()])]
                step += 1
                for i, g in enumerate(grad):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if hold.any():
            z, t = self.logits(x[hold]), y[hold]
            loss = lambda c: np.logaddexp(0, np.where(t > 0, -z, z) / c).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits((x - self.shift) / self.scale) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> tuple[np.ndarray, Network | float]:
    """Word vectors of the corpus (``docs`` unless given) and a network fitted on its labelled rows that aren't held out.

    Of several labels of a document the mean counts, rounded up from 0.5; null
    ids and labels are left out. With labels of one kind only, or none, there is
    no network and every score is the same: their mean, or 0.5.
    """
    vectors = word_vectors(docs if corpus is None else corpus)
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    y = y.where(~held_out()).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(stored(y, "labels")), "doc_id").select("text", "doc_id", "y")

    def run(batches):
        schema = arrow_schema("doc_id long, y int, x binary")
        for texts, ids, ys in slices(batches, "text", "doc_id", "y", size=_SLICE):
            x = pooled(texts, vectors)
            yield batch(schema, ids, ys, [r.tobytes() for r in x])

    # rows that share a labelled id may be more than the labels: the bound is on rows
    got = rows.mapInArrow(run, "doc_id long, y int, x binary").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "x").limit(TRAIN_ROWS).collect()
    got = sorted(got, key=lambda r: (r.doc_id, bytes(r.x)))
    y = np.array([r.y for r in got])
    if len(np.unique(y)) < 2:
        return vectors, float(y.mean()) if len(y) else 0.5
    return vectors, Network(np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(len(got), -1).astype(float), y)


def scored(docs: DataFrame, model: tuple[np.ndarray, Network | float], score: str = "score") -> DataFrame:
    """The rows of ``docs`` with a column ``score``: the probability of label 1, from the text alone.

    Null and empty texts get the score of a document without words. An own
    column of that name is replaced. Whole texts are read, whatever their length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        vectors, network = sent.value
        for whole in batches:
            for b in byte_runs(whole, at, _SLICE):
                texts = as_bytes(b.column(at))
                s = np.full(len(texts), network) if isinstance(network, float) else network.score(pooled(texts, vectors))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. An empty table gives an empty result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(rows, fitted(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
