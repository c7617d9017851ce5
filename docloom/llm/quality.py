"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's tokens are its runs of letters, digits and other signs; a token has a form (lower-cased bytes) and a shape
(kind, case, length class, whether it repeats the token before). Features are hashed uni- and bigrams of forms and
uni- to trigrams of shapes, weighted by relative frequency; a score is the sparse dot product with the weights.

Training takes at most TRAIN_ROWS labelled documents, those with the smallest hash of doc_id (a documented bound: the
weights are BUCKETS numbers and stop changing long before), of texts up to TRAIN_TEXT bytes and in that order up to
TRAIN_BYTES together. They are read by a broadcast join of their ids, so texts aren't shuffled; one task makes
FTRL-proximal passes over them. Scoring covers every document, whole.

Defined results: null text is empty; a text without tokens has only the bias; without usable labels, or with one class
only, every score follows the prior. A document with several labels takes the largest; ids may be of any type. Repeated rows give equal rows;
of other columns only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from docloom.llm.shared import held_out, packed, slices, table

BUCKETS = 1 << 18
TRAIN_ROWS = 8000
TRAIN_TEXT, TRAIN_BYTES = 1 << 20, 128 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
SCALE = 24.0
THRESHOLD = 0.3
MODULUS = 5

#: Kind of each byte: 0 space, 1 small letter or byte of a longer character, 2 capital, 3 digit, 4 other sign.
_KIND = np.full(256, 4, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[0x61:0x7B] = 1
_KIND[0x80:] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3
_RUN = np.array([0, 1, 1, 2, 3], np.uint8)  # letters of either case make one run
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every feature of the texts, grouped by text, and the number of each text's features."""
    data, starts, ends = packed(texts, b"", b" ")
    kind = _KIND[data]
    run = _RUN[kind]
    edge = np.flatnonzero(np.diff(run, prepend=0, append=0))
    first = edge[run[np.minimum(edge, len(run) - 1)] > 0]
    first = first[first < len(run)]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    stop = edge[np.searchsorted(edge, first, side="right")]
    place = (np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data)))) if first[0] == 0 else np.arange(len(data)) - np.concatenate((np.zeros(first[0], np.int64), np.repeat(first, np.diff(np.append(first, len(data)))))))
    powers = _mix(np.arange(1, 65, dtype=np.uint64) * _M1)
    value = _mix((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _M3) * powers[place & 63]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    form = _mix(total[stop] - total[first])
    size = stop - first
    capitals = np.concatenate(([0], np.cumsum(kind == 2)))
    upper = (capitals[stop] - capitals[first]) * 2 > size
    doc = np.searchsorted(ends, first, side="right")
    new = np.diff(doc, prepend=-1) != 0
    same = np.append(False, form[1:] == form[:-1]) & ~new
    same2 = np.append([False, False], form[2:] == form[:-2])[: len(form)] & ~new & ~np.append(True, new[:-1])
    kinds = run[first].astype(np.uint64)
    signs = np.where(kinds == 3, data[first], 0).astype(np.uint64)
    shape = kinds | upper.astype(np.uint64) << np.uint64(2) | (same | same2).astype(np.uint64) << np.uint64(3) | np.minimum(size, 15).astype(np.uint64) // np.uint64(4) << np.uint64(4) | signs << np.uint64(8)
    shape = _mix(shape + _M1)
    before = lambda x: np.where(new, np.uint64(7), np.append(np.uint64(7), x[:-1]))
    s1 = before(shape)
    s2 = before(s1)
    found = np.stack([form, _mix(before(form) * _M1 + form), shape, _mix(s1 * _M3 + shape), _mix((s2 * _M1 ^ s1) * _M3 + shape)], axis=1)
    return (found.ravel() & np.uint64(BUCKETS - 1)).astype(np.int64), np.bincount(doc, minlength=len(texts)) * found.shape[1]


class Model:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        at, sizes = features(texts)
        total = np.concatenate((np.zeros(1), np.cumsum(self.weights[at], dtype=np.float64)))
        ends = np.cumsum(sizes)
        dot = (total[ends] - total[ends - sizes]) * SCALE / np.maximum(sizes, 1)
        return 1 / (1 + np.exp(-np.clip(dot + self.bias, -30, 30)))


def ftrl(texts: list[bytes], labels: list[int]) -> Model:
    """FTRL-proximal with per-coordinate rates and L1, in the order given."""
    if not labels or min(labels) == max(labels):
        prior = (sum(labels) + 0.5) / (len(labels) + 1)
        return Model(np.zeros(BUCKETS), float(np.log(prior / (1 - prior))))
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rows = []
    for at in range(0, len(texts), 256):
        code, sizes = features(texts[at : at + 256])
        for part in np.split(code, np.cumsum(sizes)[:-1]):
            own, count = np.unique(part, return_counts=True)
            rows.append((np.append(own, BUCKETS).astype(np.int32), np.append(count * SCALE / max(1, len(part)), 1.0).astype(np.float32)))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for (own, x), y in zip(rows, labels, strict=True):
            zi, ni = z[own], n[own]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            z[own] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[own] = ni + g * g
    w = weights(z, n)
    return Model(w[:-1], float(w[-1]))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id and quality (0 or 1); rows with another or no quality are left out."""
    order = F.xxhash64("doc_id")
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(order, "doc_id").limit(TRAIN_ROWS)
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(r["doc_id"], r["quality"], r["text"] or "") for b in batches for r in b.to_pylist()}, key=lambda r: (hash_order(r[0]), r))
        model = ftrl([r[2].encode() for r in rows], [r[1] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], ["weights", "bias"])

    sizes = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).where(F.col("size") <= TRAIN_TEXT).join(F.broadcast(chosen), "doc_id")
    most = sizes.groupBy("doc_id", "quality").agg(F.sum("size").alias("size"))  # TRAIN_ROWS rows at most
    fits = most.withColumn("total", F.sum("size").over(Window.orderBy(order, "doc_id"))).where(F.col("total") <= TRAIN_BYTES).select("doc_id", "quality")
    sample = documents.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_TEXT).join(F.broadcast(fits), "doc_id")
    found = sample.repartition(1).mapInArrow(fit, "weights binary, bias double").first()
    return ftrl([], []) if found is None else Model(np.frombuffer(found["weights"], np.float32), found["bias"])


def hash_order(doc_id: object) -> int:
    """An order of training that doesn't follow doc_id."""
    return xxh3_64_intdigest(str(doc_id))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            p = model.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels.where(~held_out(F.col("doc_id"), MODULUS)))
    return score(documents, model).select("doc_id", held_out(F.col("doc_id"), MODULUS).alias("held_out"), "score", "predicted")
