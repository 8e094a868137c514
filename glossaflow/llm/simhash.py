"""SimHash near-duplicates by pivot distance tables.

Texts become 64-bit fingerprints; equal ones are one row from then on. For each
distinct fingerprint the Hamming distances to ``PIVOTS`` reference fingerprints
are computed once, and go with it wherever it is dealt. Two fingerprints within ``BITS`` bits differ by at most
``BITS`` in every such distance: candidates are ordered by the first distance
and met only within that difference, discarded by the greatest difference over
the others, and the survivors verified bit by bit.

So that no task meets all fingerprints, candidates share a block: of four
16-bit blocks at most three can hold a differing bit, so one is equal; of the
other 48 bits, cut in four again, one part is equal too. That gives 16 keys of
28 bits and loses no link. Where many share a key, their other 36 bits are cut
the same way inside the task. Inside a key only links that join two parts of it
are returned, so a group of near copies costs as many links as it has texts.

Defined cases: texts of one or two words have one shingle, of all words; texts
without words and null texts have the fingerprint zero and are linked like any
other; rows without an id are linked but name no component; repeated rows have
one row each; ids may be of any type that has an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glossaflow.llm.columns import apart
from glossaflow.plans.components import components
from glossaflow.plans.scratch import bounded_batches, stage_table

BITS = 3
PIVOTS = 16
SHINGLE = 3
SEED = 42
REFINE = 4096
HELD = 1 << 19
_pivots = np.random.default_rng(64).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    whole = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(whole, SEED)
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[: n - 1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), stops[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 255):  # sums of 255 bits fit a byte
        bits = np.unpackbits(h[a : a + 255].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint as a signed long)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp bigint")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """A row of Hamming distances to the reference fingerprints for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ _pivots).astype(np.uint8)


def with_pivots(distinct: DataFrame) -> DataFrame:
    """(fp, pivots) of rows (fp): the distances, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pivot_table(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["fp", "pivots"])

    return distinct.select("fp").mapInArrow(run, "fp bigint, pivots binary")


class _Forest:
    """Union-find over positions, with whole-array look-ups."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            over = self.up[self.up]
            if np.array_equal(over, self.up):
                return over
            self.up = over

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins pairs one after the other; True where a pair joined two trees."""
        roots = self.roots()
        out = np.zeros(len(a), dtype=bool)
        for k in np.flatnonzero(roots[a] != roots[b]).tolist():
            x, y = int(a[k]), int(b[k])
            while self.up[x] != x:
                x = int(self.up[x])
            while self.up[y] != y:
                y = int(self.up[y])
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out[k] = True
        return out


def links_within(keys: np.ndarray, fps: np.ndarray, pivots: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between fingerprints of equal keys; pivots: a row each of ``pivot_table``."""
    order = np.lexsort((pivots[:, 0], keys))
    keys, fps, table = keys[order], fps[order], pivots[order].astype(np.int16).T
    first, table = table[0], table[1:]
    forest = _Forest(len(fps))
    a, b = [], []
    at = np.arange(len(fps))
    for step in range(1, len(fps)):
        at = at[at + step < len(fps)]
        # Ordered by the first distance, whoever is out of reach here stays out of reach.
        at = at[(keys[at] == keys[at + step]) & (first[at + step] - first[at] <= bits)]
        if not len(at):
            break
        near = at[np.abs(table[:, at] - table[:, at + step]).max(axis=0) <= bits]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= bits]
        new = near[forest.join(near, near + step)]
        a.append(fps[new])
        b.append(fps[new + step])
    none = fps[:0]
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _refined(fps: np.ndarray, pivots: np.ndarray, free: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside a large group whose members may differ in the bits ``free`` only."""
    if len(fps) <= REFINE or len(free) < 4 * 4:
        return links_within(np.zeros(len(fps), dtype=np.int64), fps, pivots, bits)
    a, b = [], []
    for k in range(4):
        part = free[k * len(free) // 4 : (k + 1) * len(free) // 4]
        rest = [i for i in free if i not in part]
        mask = np.uint64(sum(1 << i for i in part))
        values = fps & mask
        order = np.argsort(values, kind="stable")
        cuts = np.flatnonzero(np.diff(values[order])) + 1
        small = []
        for group in np.split(order, cuts):
            if len(group) > REFINE:
                x, y = _refined(fps[group], pivots[group], rest, bits)
                a.append(x)
                b.append(y)
            elif len(group) > 1:
                small.append(group)
        if small:
            picked = np.concatenate(small)
            x, y = links_within(values[picked].view(np.int64), fps[picked], pivots[picked], bits)
            a.append(x)
            b.append(y)
    none = fps[:0]
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


#: key number -> (mask, bits left free): one 16-bit block and a quarter of the other 48 bits.
def _tables() -> list[tuple[int, list[int]]]:
    out = []
    for j in range(4):
        block = list(range(16 * j, 16 * j + 16))
        others = [i for i in range(64) if i not in block]
        for k in range(4):
            fixed = block + others[12 * k : 12 * k + 12]
            out.append((sum(1 << i for i in fixed), [i for i in others if i not in fixed]))
    return out


TABLES = _tables()


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (table, masked, fp, pivots) ordered by the first two; whole groups at a time."""

    def solve(t: np.ndarray, m: np.ndarray, f: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        edge = np.concatenate(([True], (t[1:] != t[:-1]) | (m[1:] != m[:-1])))
        group = np.cumsum(edge) - 1
        size = np.bincount(group)
        a, b = [], []
        small = (size[group] > 1) & (size[group] <= REFINE)
        if small.any():
            x, y = links_within(group[small], f[small], d[small])
            a, b = [x], [y]
        for g in np.flatnonzero(size > REFINE).tolist():
            rows = group == g
            x, y = _refined(f[rows], d[rows], TABLES[int(t[rows][0])][1], BITS)
            a.append(x)
            b.append(y)
        none = f[:0]
        a, b = (np.concatenate(a), np.concatenate(b)) if a else (none, none)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pivots = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, PIVOTS)
        held.append([*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), pivots])
        count += batch.num_rows
        if count >= HELD:
            t, m, f, d = (np.concatenate(c) for c in zip(*held, strict=True))
            last = int(np.flatnonzero((t == t[-1]) & (m == m[-1]))[0])
            if last:
                yield solve(t[:last], m[:last], f[:last].view(np.uint64), d[:last])
            held, count = [[t[last:], m[last:], f[last:], d[last:]]], (len(t) - last) // 2
    if held:
        t, m, f, d = (np.concatenate(c) for c in zip(*held, strict=True))
        yield solve(t, m, f.view(np.uint64), d)


def links(table: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp, pivots) that keep all components."""
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    spots = F.array(*[F.struct(F.lit(i).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("m")) for i, (m, _) in enumerate(TABLES)])
    rows = table.select("fp", "pivots", F.explode(spots).alias("s")).select("s.t", "s.m", "fp", "pivots")
    dealt = rows.repartition("t", "m").sortWithinPartitions("t", "m")
    return dealt.mapInArrow(_link_groups, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest id reachable)."""
    fps = stage_table(fingerprints(docs, text, doc_id, shingle), "fingerprints")
    distinct = stage_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    tied = components(links(stage_table(with_pivots(distinct), "pivot-table")))
    known = distinct.join(tied, distinct["fp"] == tied["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = stage_table(known, "rooted")
    least = stage_table(known.groupBy("root").agg(F.min("least").alias("component_id")), "least-ids")
    named = stage_table(known.select("fp", "root").join(least, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """The document of the smallest id of each group, with its columns.

    The ids to drop, fewer than those to keep, are what the texts are joined
    with. Of rows that repeat the smallest id one stays. Rows without an id go
    if their group has an id, and all stay if it has none.
    """
    gone, print_ = apart(docs, "drop", "fp")
    groups = stage_table(near_groups(docs, text, doc_id, shingle), "groups")
    facts = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") != F.col("component_id")).alias("drop"))
    facts = stage_table(facts, "group-facts")
    drop = stage_table(facts.filter("drop").select(F.col("doc_id").alias(gone)), "dropped")
    out = docs.join(drop, F.col(doc_id) == F.col(gone), "left_anti")
    if facts.filter("doc_id IS NOT NULL AND NOT drop AND n > 1").limit(1).count():
        out = out.dropDuplicates([doc_id])
    if not facts.filter("doc_id IS NULL").count():
        return out
    nameless = groups.filter("doc_id IS NULL AND component_id IS NULL").select(F.col("fp").alias(print_)).distinct()
    without = docs.filter(F.col(doc_id).isNull())
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, shingle) for t in b.column(columns.index(text)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], names=[*columns, print_])

    marked = without.mapInArrow(run, StructType([*docs.schema.fields, StructField(print_, LongType())]))
    return out.filter(F.col(doc_id).isNotNull()).unionByName(marked.join(nameless, print_, "left_semi").select(*columns))
