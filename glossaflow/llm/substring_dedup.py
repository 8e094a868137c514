"""Removal of long word sequences that occur earlier, by fixed-block anchors.

A window of ``2 * BLOCK`` words holds a whole block of its document, a block
being ``BLOCK`` words that start at a multiple of ``BLOCK``. So:

1. the non-overlapping blocks, a tenth of the windows, are the index, and every
   rolling window of ``BLOCK`` words probes it: both are dealt by hash, and meet
   in one pass over each bucket. A block whose hash is probed twice or more
   (its own window is one) is an anchor and returns to its document;
2. an anchor is extended to the windows around it that hold it. These are
   compared by whole 128-bit digests, the first of each by document and start
   stays, and the others join to the maximal repeats that are removed.

What is dealt by hash is first made distinct within a task, so a passage that
very many documents share costs one entry a task, and no pairs are made. Hashes
travel as packed arrays by bucket. There are as many buckets as keep
``BUCKET_BYTES`` of text to each, several to a shuffle partition where its share
is larger, so what a worker holds doesn't grow with the input. Texts move in two
joins by id.

Defined cases: null and empty texts have no words; a text of fewer words than a
window loses nothing; rows without an id come after all others; of rows that
share an id, the one whose text has the smaller hash comes first, and exact
repeats of a row are one document that keeps its words in each; ids that are no
integers come in their own order; other columns pass through, but for those
named n_words, n_removed or kept_text in any case, which the results replace.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.columns import apart, numbered
from glossaflow.plans.scratch import bounded_batches, stage_table

BLOCK = 10
BUCKET_BYTES = 16 << 20
HELD = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class _Spans:
    """A text's words joined by single spaces, and where each starts and stops."""

    def __init__(self, text: str | None):
        words = words_of(text)
        self.n, self.whole = len(words), b" ".join(words)
        self.stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=self.n) + 1) - 1
        self.starts = np.concatenate(([0], self.stops[:-1] + 1)) if self.n else self.stops

    def cut(self, at: np.ndarray, size: int) -> Iterator[bytes]:
        whole = self.whole
        return (whole[a:b] for a, b in zip(self.starts[at].tolist(), self.stops[at + size - 1].tolist(), strict=True))

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        return np.array(list(map(xxhash.xxh3_64_intdigest, self.cut(at, size))), dtype=np.uint64)

    def digests(self, at: np.ndarray, size: int) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.cut(at, size))), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def _pack(a: np.ndarray) -> bytes:
    """Differences, byte plane by byte plane: small steps leave runs of zeros to the codec."""
    steps = np.diff(np.asarray(a, dtype="<i8"), prepend=np.int64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _batch(names: str, kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names.split())


def _buckets(sorted_buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    if len(sorted_buckets):
        cuts = np.flatnonzero(np.diff(sorted_buckets)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_buckets)], strict=True):
            yield int(sorted_buckets[a]), slice(a, b)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Even shares of the upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of one first column after the other; rows come ordered by it."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != now:
                if rows:
                    yield now, rows
                now, rows = row[0], []
            rows.append(row)
    if rows:
        yield now, rows


def _dealt(df: DataFrame, column: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionById(n, F.pmod(F.col(column), F.lit(n)).cast("int")).sortWithinPartitions(column)


def _bucket_count(docs: DataFrame) -> int:
    """Buckets of about ``BUCKET_BYTES`` of text, the same number in each shuffle partition."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return partitions * max(1, math.ceil(size / (partitions * BUCKET_BYTES)))


def _anchors(docs: DataFrame, buckets: int, block: int) -> DataFrame:
    """(doc_id, blocks): numbers of the blocks whose hash some other rolling window has too."""
    kinds = [pa.int32(), *[pa.binary()] * 5]
    names, schema = "bucket once twice low ids numbers", "bucket int, once binary, twice binary, low binary, ids binary, numbers binary"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[tuple]) -> pa.RecordBatch:
            h, begins, ids = zip(*held, strict=True)
            values, counts = np.unique(np.concatenate(h), return_counts=True)
            bucket, low = _bucket(values, buckets), values.astype(np.uint32)
            rows = {k: [k, low[s].tobytes(), low[s][counts[s] > 1].tobytes(), b"", b"", b""] for k, s in _buckets(bucket)}
            blocks = np.concatenate([x[b] for x, b in zip(h, begins, strict=True)])
            ids = np.repeat(np.array(ids, np.int64), [len(b) for b in begins])
            numbers = np.concatenate(begins) // block
            bucket, low = _bucket(blocks, buckets), blocks.astype(np.uint32)
            o = np.argsort(bucket, kind="stable")
            bucket, low, ids, numbers = bucket[o], low[o], ids[o], numbers[o]
            for k, s in _buckets(bucket):
                rows[k][3:] = low[s].tobytes(), _pack(ids[s]), _pack(numbers[s])
            return _batch(names, kinds, list(rows.values()))

        held, count = [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = _Spans(t)
                if spans.n >= 2 * block:
                    h = spans.hashes(np.arange(spans.n - block + 1), block)
                    held.append((h, np.arange(0, len(h), block), i))
                    count += len(h)
                    if count >= HELD:
                        yield emit(held)
                        held, count = [], 0
        if held:
            yield emit(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            values = np.frombuffer(b"".join(x for r in rows for x in r[1:3]), dtype=np.uint32)
            values, counts = np.unique(values, return_counts=True)
            shared = values[counts > 1]
            if not len(shared):
                continue
            for _, _, _, low, ids, numbers in rows:
                if low:
                    low = np.frombuffer(low, dtype=np.uint32)
                    yes = shared[np.minimum(np.searchsorted(shared, low), len(shared) - 1)] == low
                    if yes.any():
                        yield pa.RecordBatch.from_arrays([pa.array(_unpack(ids)[yes]), pa.array(_unpack(numbers)[yes].astype(np.int32))], names=["doc_id", "number"])

    probes = docs.select("doc_id", "text").mapInArrow(probe, schema)
    hits = _dealt(probes, "bucket").mapInArrow(meet, "doc_id bigint, number int")
    return hits.groupBy("doc_id").agg(F.collect_list("number").alias("blocks"))


def _repeats(docs: DataFrame, anchors: DataFrame, buckets: int, block: int) -> DataFrame:
    """(doc_id, cuts): starts and ends of the words to remove, one after the other."""
    size = 2 * block
    kinds = [pa.int32(), *[pa.binary()] * 4]
    names, schema = "part high low ids starts", "part int, high binary, low binary, ids binary, starts binary"

    def gone(ids: np.ndarray, starts: np.ndarray) -> list[tuple]:
        """Removed windows by group of documents; their parts are below zero."""
        part = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
        o = np.lexsort((starts, ids, part))
        part, ids, starts = part[o], ids[o], starts[o]
        return [(-1 - k, b"", b"", _pack(ids[s]), _pack(starts[s])) for k, s in _buckets(part)]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[tuple]) -> pa.RecordBatch:
            held.sort(key=lambda x: x[1])  # from here on, equal digests are in the order of document and start
            d, starts = np.concatenate([x[0] for x in held]), np.concatenate([x[2] for x in held])
            ids = np.repeat(np.array([x[1] for x in held], np.int64), [len(x[2]) for x in held])
            o = np.lexsort((d[:, 1], d[:, 0]))
            s = d[o]
            first = np.concatenate(([True], (s[1:] != s[:-1]).any(axis=1)))
            rows = gone(ids[o[~first]], starts[o[~first]])
            at = np.sort(o[first])
            bucket = _bucket(d[at, 0], buckets)
            o = np.argsort(bucket, kind="stable")
            bucket, at = bucket[o], at[o]
            high, low, ids, starts = d[at, 0], d[at, 1], ids[at], starts[at]
            rows += [(k, high[s].tobytes(), low[s].tobytes(), _pack(ids[s]), _pack(starts[s])) for k, s in _buckets(bucket)]
            return _batch(names, kinds, rows)

        held, count = [], 0
        for b in batches:
            for i, t, numbers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans = _Spans(t)
                near = np.zeros(spans.n + 2 * block + 1, dtype=np.int64)
                at = np.array(numbers, dtype=np.int64) * block
                np.add.at(near, np.maximum(at - block, 0), 1)
                np.add.at(near, at + 1, -1)
                at = np.flatnonzero(np.cumsum(near)[: max(0, spans.n - size + 1)])
                if len(at):
                    held.append((spans.digests(at, size), i, at))
                    count += len(at)
                    if count >= HELD // 4:
                        yield emit(held)
                        held, count = [], 0
        if held:
            yield emit(held)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for k, rows in _by_bucket(batches):
            if k < 0:
                yield _batch(names, kinds, rows)
                continue
            high, low = (np.frombuffer(b"".join(r[c] for r in rows), dtype=np.uint64) for c in (1, 2))
            ids, starts = (np.concatenate([_unpack(r[c]) for r in rows]) for c in (3, 4))
            o = np.lexsort((low, high))
            new = np.concatenate(([True], (high[o[1:]] != high[o[:-1]]) | (low[o[1:]] != low[o[:-1]])))
            group = np.cumsum(new) - 1
            several = np.bincount(group)[group] > 1
            o, group = o[several], group[several]
            o, group = o[(by := np.lexsort((starts[o], ids[o], group)))], group[by]
            later = np.concatenate(([False], group[1:] == group[:-1])) if len(o) else several[:0]
            held.append((ids[o[later]], starts[o[later]]))
            count += len(held[-1][0])
            if count >= HELD // 4:
                yield _batch(names, kinds, gone(*(np.concatenate(c) for c in zip(*held, strict=True))))
                held, count = [], 0
        if count:
            yield _batch(names, kinds, gone(*(np.concatenate(c) for c in zip(*held, strict=True))))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            ids, starts = (np.concatenate([_unpack(r[c]) for r in rows]) for c in (3, 4))
            o = np.lexsort((starts, ids))
            ids, starts = ids[o], starts[o]
            out = []
            for i, s in _buckets(ids):
                at = starts[s]
                new = np.concatenate(([True], at[1:] > at[:-1] + size))
                stops = np.concatenate((at[:-1][new[1:]], at[-1:])) + size
                out.append((i, np.stack((at[new], stops), axis=1).ravel().tolist()))
            yield _batch("doc_id cuts", [pa.int64(), pa.list_(pa.int32())], out)

    found = docs.join(anchors, "doc_id").select("doc_id", "text", "blocks").mapInArrow(windows, schema)
    settled = _dealt(found, "part").mapInArrow(settle, schema)
    return _dealt(settled, "part").mapInArrow(collect, "doc_id bigint, cuts array<int>")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Columns of ``docs`` but the text, and n_words, n_removed, kept_text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    new = ("n_words", "n_removed", "kept_text")
    others = [c for c in docs.columns if c != text and c.lower() not in new]
    docs, order, plain = numbered(docs.select(*others, text), doc_id, text)
    (cut,) = apart(docs, "cuts")
    buckets = _bucket_count(plain)
    anchors = stage_table(_anchors(plain, buckets, block), "anchors")
    cuts = stage_table(_repeats(plain, anchors, buckets, block), "cuts").withColumnsRenamed({"doc_id": order, "cuts": cut})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, cut in zip(b.column(len(others)).to_pylist(), b.column(len(others) + 1).to_pylist(), strict=True):
                words = words_of(t)
                total = len(words)
                for start, stop in reversed(list(zip(cut[::2], cut[1::2], strict=True)) if cut else []):
                    del words[start:stop]
                rows.append((total, total - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
            added = _batch(" ".join(new), [pa.int64(), pa.int64(), pa.string()], rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], *added.columns], names=[*others, *new])

    kept = docs.join(cuts, order, "left").select(*others, text, cut)
    schema = kept.select(*others).schema
    for name, kind in zip(new, ("long", "long", "string"), strict=True):
        schema = schema.add(name, kind)
    return kept.mapInArrow(apply, schema)
