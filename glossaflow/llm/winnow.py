"""Document fingerprints by winnowing.

Every run of ``K`` code points is hashed by a rolling polynomial; in every
window of ``W`` hashes the smallest is chosen, the rightmost where several are
equal, and kept with its position. Any two texts that share ``K + W - 1`` code
points in a row share a chosen hash. The likeness of two fingerprints is the
share of distinct hashes they have in common.

Defined cases: a null or empty text has an empty fingerprint; a text of fewer
than ``K`` code points has one hash, of all of it; a text with fewer than ``W``
hashes is one window; the likeness of two empty fingerprints is 1, of an empty
and another 0; a lone document is its own next one; rows of one id, and rows
without an id, follow each other by a hash of their texts, then the texts; ids
that are no integers come in their own order, and are returned as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.columns import is_integral, numbers_of
from glossaflow.plans.scratch import bounded_batches

K, W = 20, 30
PART = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWEST = np.iinfo(np.int64).min


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """Hashes of all runs of k code points, by doubling: a run of 2n joins two of n."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(codes):
        return codes
    k = min(k, len(codes))
    out, have, block, span, power = None, 0, codes, 1, _BASE
    with np.errstate(over="ignore"):
        left = k
        while left:
            if left & 1:
                n = len(codes) - have - span + 1
                out = block[:n].copy() if out is None else out[:n] * power + block[have : have + n]
                have += span
            left >>= 1
            if left:
                block = block[:-span] * power + block[span:]
                span, power = span * 2, power * power
        return _mix(out)


def choose(hashes: np.ndarray, w: int = W) -> np.ndarray:
    """Positions of the smallest hash of every window, rightmost if equal."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    w = min(w, n)
    at = np.arange(n)
    span = 1
    while span < w:
        step = min(span, w - span)
        left, right = at[:-step], at[step:]
        at = np.where(hashes[right] <= hashes[left], right, left)
        span += step
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def fingerprint(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Chosen 32-bit hashes and their positions, in order of position.

    Texts of any length are taken a part at a time, each part with the code
    points that the windows starting in it reach.
    """
    text = text or ""
    hashes, places = [], []
    for start in range(0, max(1, len(text) - K - W + 2), PART):
        h = gram_hashes(text[start : start + PART + K + W - 2])
        at = choose(h)
        hashes.append((h[at] >> np.uint64(32)).astype(np.uint32))
        places.append(at + start)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], places


def shown(fp: tuple[np.ndarray, np.ndarray]) -> str:
    return ",".join(map("%08x:%d".__mod__, zip(fp[0].tolist(), fp[1].tolist(), strict=True)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first code points of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shown(fingerprint(t)) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fingerprint string")


def compare_with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", groups: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses.

    The next document is the next row by id (null ids first), then hash of the
    text, then text; after the last comes the first. Rows are dealt to ranges
    of this order, each with the first rows of the following range as guests,
    so every document meets its successor inside one task and the texts move
    once. An id that many rows have is split by the hash. Two numbers a range
    are all that reaches the driver.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if not is_integral(docs, doc_id):
        keys = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
        order = numbers_of(keys.select("key"), "n")
        numbered = keys.join(order, keys["key"].eqNullSafe(order["key"])).select(F.when(keys["key"].isNotNull(), F.col("n")).alias("n"), "text")
        out = compare_with_next(numbered, "text", "n", groups)
        back = order.filter("key IS NOT NULL").select(F.col("n").alias("doc_id"), F.col("key"))
        return out.join(back, "doc_id", "left").select(F.col("key").alias("doc_id"), *out.columns[1:])
    n = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = F.coalesce("doc_id", F.lit(_LOWEST))  # as a column of its own kind, since pandas has no whole numbers beside nulls
    place = ids.select("doc_id", F.xxhash64("text").alias("h"))
    borders = _borders(place, n)

    def range_of(i: pd.Series, h: pd.Series) -> np.ndarray:
        i, h = i.to_numpy(np.int64), h.to_numpy(np.int64)
        out = np.searchsorted(borders[:, 0], i, side="left")
        stop = np.searchsorted(borders[:, 0], i, side="right")
        for k in np.flatnonzero(stop > out).tolist():  # rows of a border's own id
            out[k] += np.searchsorted(borders[out[k] : stop[k], 1], h[k], side="right")
        return out.astype(np.int32)

    @F.pandas_udf("int")
    def group(i: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(range_of(i, h))

    key = F.struct(known.alias("i"), "h")
    found = place.withColumn("g", group(known, "h")).groupBy("g").agg(F.min(key).alias("first")).orderBy("g").collect()
    host = {tuple(r["first"]): found[k - 1]["g"] for k, r in enumerate(found)}  # the first of all is the last range's guest

    @F.pandas_udf("int")
    def guest_of(i: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([host.get(x, -1) for x in zip(i.tolist(), h.tolist(), strict=True)], dtype=np.int32)

    placed = ids.withColumn("h", F.xxhash64("text"))
    placed = placed.withColumn("own", group(known, "h")).withColumn("other", guest_of(known, "h"))
    home = F.struct(F.col("own").alias("g"), F.lit(0).alias("guest"))
    visit = F.struct(F.col("other").alias("g"), F.lit(1).alias("guest"))
    placed = placed.select("doc_id", "h", "text", F.explode(F.when(F.col("other") >= 0, F.array(home, visit)).otherwise(F.array(home))).alias("at"))
    placed = placed.select("doc_id", "text", "at.guest", "at.g", "h")
    dealt = placed.repartitionById(len(borders) + 1, "g").sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), "h", "text").drop("g", "h")

    return dealt.mapInArrow(_compare, OUT)


def _borders(place: DataFrame, n: int) -> np.ndarray:
    """Rows (id, hash) that begin ranges of about equal size; of an id that fills several ranges, evenly spaced hashes."""
    nulls, rows = place.agg(F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    for_nulls = round(n * nulls / rows) if rows else 0
    m = max(1, n - for_nulls)
    cuts = [_LOWEST] * for_nulls + sorted(map(int, place.stat.approxQuantile("doc_id", [k / m for k in range(1, m)], 0.25 / m)))
    values, times = np.unique(np.array(cuts, dtype=np.int64), return_counts=True)
    out = []
    for i, t in zip(values.tolist(), times.tolist(), strict=True):
        # Once only: the range begins with the id. More often: its rows fill ranges of their own.
        out += [(i, _LOWEST + k * ((1 << 64) // t)) for k in range(t)]
    return np.array([x for x in out if x != (_LOWEST, _LOWEST)], dtype=np.int64).reshape(-1, 2)


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for b in batches:
        rows = []
        for i, t, guest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if held is None and guest:
                continue  # a guest after the first, or of a range without rows
            fp = fingerprint(t)
            if held is not None:
                old_id, old, old_fp = held
                new = edited(old, t)
                new_fp = fingerprint(new)
                sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((old_id, len(old), sha, shown(old_fp), shown(new_fp), likeness(old_fp[0], new_fp[0]), likeness(old_fp[0], fp[0])))
            held = None if guest else (i, t, fp)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = [x.split()[0] for x in OUT.split(", ")]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
