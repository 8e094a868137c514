"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of its byte 2-, 3- and 4-grams, hashed to
``DIMS`` places, and of word n-grams (2 to ``RUNS`` + 1) of one repeated word. Each indicator is scaled by the
log ratio of its smoothed shares in the two classes; a linear hinge-loss model
is fitted to them by dual coordinate descent, and its margin is mapped to a
probability by a logistic fit on labelled rows that the descent did not see.

The fit uses at most ``SAMPLE`` labelled rows, those of the smallest hash of
their id (repeated rows once), and of these as many, in the order of the hash, as
have ``PLACES`` features together, which is what bounds the driver where texts are long. Scores
cover all rows and whole texts.

Defined cases: a null text is empty, and an empty text is scored as one without
features; rows without an id are scored, never learned from and not held out;
repeated rows have equal scores, a row each; ids may be of any type; ids with several labels take the largest; labels of unknown documents
and null labels are not used; if the sample has one class or none, every score
is that class's smoothed share, or a half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.plans.scratch import bounded_batches, release, stage_table

BITS = 18
DIMS = 1 << BITS
SAMPLE = 5_000
PLACES = 64_000_000  # 256 MB on the driver
EPOCHS = 12
PART = 1 << 20
C = 0.05
RUNS = 12
_flags = np.zeros(DIMS + RUNS, dtype=bool)


def features(text: str | None) -> np.ndarray:
    """Sorted places of the features a text has."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    flags = _flags
    for start in range(0, len(raw), PART):
        b = np.frombuffer(raw[start : start + PART + 3], dtype=np.uint8).astype(np.uint32)
        gram = b
        for n in (2, 3, 4):
            if len(b) < n:
                break
            gram = (gram[:-1] << np.uint32(8)) | b[n - 1 :]
            flags[(gram * np.uint32(2654435761) + np.uint32(n * 0x3C6EF372)) >> np.uint32(32 - BITS)] = True
    words = raw.split()
    same = bytes(map(eq, words, words[1:]))
    for n in range(1, RUNS + 1):
        if b"\1" * n not in same:
            break
        flags[DIMS + n - 1] = True
    found = np.flatnonzero(flags).astype(np.int32)
    flags[found] = False
    return found


@dataclass
class Model:
    weights: np.ndarray  # of a plain indicator, ratio included
    bias: float
    slope: float
    offset: float

    def score(self, text: str | None) -> float:
        margin = float(self.weights[features(text)].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    ratio = []
    for label in (1, 0):
        counts = np.ones(DIMS + RUNS)
        for r, y in zip(rows, labels, strict=True):
            if y == label:
                counts[r] += 1
        ratio.append(np.log(counts / counts.sum()))
    return ratio[0] - ratio[1]


def descend(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, c: float = C, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the bias is one more feature of value 1."""
    weights, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    values = [ratio[r] for r in rows]
    norms = np.array([float(v @ v) + 1 for v in values])
    # the rarer class weighs more, so that both weigh the same in all
    cost = c * np.where(signs > 0, len(signs) / (2 * max(1, (signs > 0).sum())), len(signs) / (2 * max(1, (signs < 0).sum())))
    order = np.random.default_rng(5)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]) / cost[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights * ratio, bias


def calibrate(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic fit of the labels on the margins, by Newton's method, lightly damped."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    slope, offset = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        w = p * (1 - p)
        h = np.array([[(w * margins * margins).sum(), (w * margins).sum()], [(w * margins).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(slope, 1e-3)), float(offset)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    labels = np.asarray(labels, dtype=np.int64)
    if not 0 < labels.sum() < len(labels):
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(DIMS + RUNS), 0.0, 1.0, float(np.log(share / (1 - share))))
    aside = np.arange(len(labels)) % 5 == 4
    if not (0 < labels[~aside].sum() < (~aside).sum() and 0 < labels[aside].sum() < aside.sum()):
        aside[:] = False
    kept = [r for r, a in zip(rows, aside, strict=True) if not a]
    ratio = log_ratios(kept, labels[~aside])
    weights, bias = descend(kept, np.where(labels[~aside] == 1, 1.0, -1.0), ratio)
    probe = [r for r, a in zip(rows, aside, strict=True) if a or not aside.any()]
    margins = np.array([weights[r].sum() + bias for r in probe])
    return Model(weights, bias, *calibrate(margins, labels[aside] if aside.any() else labels))


def remainder(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string")) % mod


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, places: int = PLACES) -> Model:
    """Fit on labelled rows whose id has a crc32 of other than 1 modulo 3."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [features(t).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["doc_id", "label", "places"])

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    rows = texts.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", "_hash"]).select("doc_id", F.col("_quality").cast("int"), "_text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    staged = stage_table(rows.mapInArrow(run, f"doc_id {kind}, label int, places binary"), "labelled-features")
    made = staged.withColumn("_place", F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("places").alias("own")))
    left, last = 4 * places, None
    for row in made.select("_place", F.length("places").alias("size")).orderBy("_place").limit(sample).collect():
        left -= row["size"]
        if left < 0 and last:
            break
        last = row["_place"]
    got = []
    if last:
        upto = F.struct(F.lit(last["h"]).alias("h"), F.lit(last["doc_id"]).cast(kind).alias("doc_id"), F.lit(last["own"]).alias("own"))
        got = sorted((r["doc_id"], r["label"], bytes(r["places"])) for r in made.filter(F.col("_place") <= upto).select("doc_id", "label", "places").collect())
    release(staged)
    return fit([np.frombuffer(p, dtype=np.int32) for _, _, p in got], np.array([y for _, y, _ in got]))


def add_scores(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = [m.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select(doc_id, text).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that the model does not reject, with their columns."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) >= 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
