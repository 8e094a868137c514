"""Benchmark decontamination by greedy string tiling.

Runs of ``SEED`` words that a document shares with a benchmark item are the
seeds. Where there are any, greedy string tiling covers both texts with their
longest common runs, each word used once, so that passages in another order
count as much as whole ones; runs are found by running Karp-Rabin hashes at a
falling search length and confirmed word by word. Whether there is a common run
of a length is one look-up of all hashes of that length, so the longest is found
by halving, and time and memory stay in proportion to the text however often
its words repeat. A document is contaminated by an item of whose words the tiles
cover ``COVERAGE`` or more.

Items are a stated query set. They are taken in blocks of about ``BLOCK_BYTES``
of text, so that what goes to the executors is bounded, and every document meets
every block.

Defined cases: words are lower-cased and ASCII punctuation separates them; an
item of fewer than ``SEED`` words is its own seed; items without words match
nothing; null texts are empty; repeated items and documents each have rows; ids
of both may be of any type.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.plans.scratch import bounded_batches

SEED = 5
COVERAGE = 0.5
BLOCK_BYTES = 12 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_APART).split()


class _Runs:
    """Karp-Rabin hashes of the runs of any length of one text, and its free words."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.free = ids, ids > 0
        n = len(ids)
        with np.errstate(over="ignore"):
            self.powers = np.ones(n + 1, np.uint64)
            np.multiply.accumulate(np.full(n, _BASE), out=self.powers[1:]) if n else None
            # A word's number alone would let equal sums of powers meet.
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mixed * self.powers[:n], out=self.sums[1:])

    def mark(self, at: int, n: int) -> None:
        self.free[at : at + n] = False

    def starts(self, n: int) -> np.ndarray:
        """Where runs of n free words start."""
        if n > len(self.ids):
            return np.empty(0, np.int64)
        taken = np.concatenate(([0], np.cumsum(~self.free)))
        return np.flatnonzero(taken[n:] == taken[:-n])

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the runs at these places, carried to the same power of the base."""
        with np.errstate(over="ignore"):
            return (self.sums[at + n] - self.sums[at]) * self.powers[len(self.ids) - at]


def _common(doc: _Runs, item: _Runs, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts in doc, their hashes, starts in item, their hashes) of the runs of n words that both have."""
    here, there = doc.starts(n), item.starts(n)
    with np.errstate(over="ignore"):
        a, b = doc.hashes(here, n) * item.powers[-1], item.hashes(there, n) * doc.powers[-1]
    b_only = np.unique(b)
    if not len(b_only) or not len(a):
        return here[:0], a[:0], there[:0], b[:0]
    spot = np.minimum(np.searchsorted(b_only, a), len(b_only) - 1)
    found = b_only[spot] == a
    here, a = here[found], a[found]
    kept = np.isin(b, a)
    return here, a, there[kept], b[kept]


def _longest(doc: _Runs, item: _Runs, least: int, most: int) -> int:
    """The length of the longest common run, 0 if it is below ``least``."""
    if not len(_common(doc, item, least)[0]):
        return 0
    low, high = least, most
    while low < high:  # whoever shares a run shares all shorter parts of it
        half = (low + high + 1) // 2
        low, high = (half, high) if len(_common(doc, item, half)[0]) else (low, half - 1)
    return low


def tile(doc: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length): always a longest common run of
    free words, of equal ones that of the first place in doc, then in item."""
    d, i = _Runs(np.asarray(doc, np.int64)), _Runs(np.asarray(item, np.int64))
    tiles: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))
    while most >= least:
        n = _longest(d, i, least, most)
        if not n:
            break
        here, a, there, b = _common(d, i, n)
        places: dict[int, list[int]] = defaultdict(list)
        for value, start in zip(b.tolist(), there.tolist(), strict=True):
            places[value].append(start)
        stop = 0
        for at, value in zip(here.tolist(), a.tolist(), strict=True):
            if at < stop or value not in places:
                continue
            places[value] = [s for s in places[value] if i.free[s : s + n].all()]
            same = next((s for s in places[value] if np.array_equal(d.ids[at : at + n], i.ids[s : s + n])), None)
            if same is not None:
                tiles.append((at, same, n))
                d.mark(at, n)
                i.mark(same, n)
                stop = at + n
            elif not places[value]:
                del places[value]
                if not places:
                    break
        most = n - 1
    return tiles


class Items:
    """A block of benchmark items with its seeds."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        seeds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                n = min(SEED, len(ids))
                for value in self._grams(np.array(ids, dtype=np.uint64), n).tolist():
                    seeds[n][value].add(len(self.items))
                self.items.append((item_id, ids))
        self.seeds = {n: (np.array(sorted(s), dtype=np.uint64), s) for n, s in seeds.items()}

    @staticmethod
    def _grams(ids: np.ndarray, n: int) -> np.ndarray:
        if len(ids) < n:
            return ids[:0]
        out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(out)]
        return out ^ (out >> np.uint64(29))

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item id, coverage, tiles, longest tile) of items that contaminate a text."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], dtype=np.uint64)
        shared: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)  # item: places of its seeds, which items share
        for n, (values, owners) in self.seeds.items():
            grams = self._grams(ids, n)
            if not len(grams):
                continue
            spot = np.searchsorted(values, grams)
            spot[spot == len(values)] = 0
            at = np.flatnonzero(values[spot] == grams)
            at = at[np.argsort(spot[at], kind="stable")]
            for places in np.split(at, np.flatnonzero(np.diff(spot[at])) + 1):
                for k in owners[int(grams[places[0]])] if len(places) else ():
                    shared[k].append((places, n))
        out = []
        for k, seeds in shared.items():
            item_id, item = self.items[k]
            tiles = tile(self._inside(ids, seeds), item, min(SEED, len(item)))
            covered = sum(n for _, _, n in tiles) / len(item)
            if covered >= COVERAGE:
                out.append((item_id, covered, len(tiles), max(n for _, _, n in tiles)))
        return sorted(out)

    @staticmethod
    def _inside(ids: np.ndarray, seeds: list[tuple[np.ndarray, int]]) -> np.ndarray:
        """The words inside seeds, since no other can be in a tile, with a zero between stretches."""
        cover = np.zeros(len(ids) + 1, np.int64)
        for places, n in seeds:
            np.add.at(cover, places, 1)
            np.add.at(cover, places + n, -1)
        inside = np.cumsum(cover[:-1]) > 0
        first = inside & ~np.concatenate(([False], inside[:-1]))
        at = np.flatnonzero(inside)
        return np.insert(ids[at].astype(np.int64), np.flatnonzero(first[at])[1:], 0)


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """Blocks of items, one at a time on the driver."""
    rows = benchmark.select("item_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield Items(sorted(((r["item_id"], r["text"]) for r in dealt.filter(F.col("block") == k).collect()), key=repr))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document and item that contaminates it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, doc_id), (benchmark, "item_id")))
    item_type = benchmark.select("item_id").limit(0).toArrow().schema.field(0).type

    def over(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in shared.value.matches(t)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (b.schema.field(0).type, item_type, pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "coverage", "n_tiles", "longest"])

        return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, coverage double, n_tiles int, longest int")

    out = None
    for block in item_blocks(benchmark):
        found = over(spark.sparkContext.broadcast(block))
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no item contaminates, with their columns."""
    spark = docs.sparkSession
    bounded_batches(spark)
    at = docs.columns.index(text)

    def over(df: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.matches(t) for t in b.column(at).to_pylist()], pa.bool_()))

        return df.mapInArrow(run, df.schema)

    for block in item_blocks(benchmark):
        docs = over(docs, spark.sparkContext.broadcast(block))
    return docs
