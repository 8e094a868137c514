"""Ranked lexical search by variable-block-max WAND.

1. One pass over the texts counts the terms that the items ask for; what it
   leaves is a small table (id, length, terms, frequencies), staged once, of
   which the number of documents, their length and the document frequencies
   are sums.
2. A task reads that table as it lies and makes shards of ``SHARD_ROWS``
   documents or ``SHARD_POSTINGS`` postings, whichever is first. In a shard the
   postings of each term, in the order of document ids, are cut into blocks of
   varying length by dynamic programming: of all ways to cut, the one of the
   least sum of bound errors (the block's greatest impact less the impact, over
   its postings) plus a fixed cost a block.
3. Each item is searched in each shard. The block borders of its terms divide
   the documents into stretches, whose bound is the sum of the block maxima that
   reach into them. Stretches of the greatest bounds come first; the score of
   the k-th document so far is the threshold, and no block is read whose
   stretches all lie below it. In the stretches left, only documents are scored
   whose own lists' block maxima reach the threshold (the pivot's condition).
   Nothing that could be among the k best is skipped, ties included.
4. The k best of all shards are ranked in two steps, first in salted parts, so
   that no task meets all shards' rows of an item.

No text and no posting is shuffled. Shards don't grow with the input, and
neither does what a task holds. Items come in blocks of ``ITEM_CHARS``
characters, each a pass over the texts.

Defined cases: null and empty texts, and those without terms, are no documents
and ask for nothing; each row of documents is a document, so repeated rows rank
one after the other; documents without an id come after others of their score;
each distinct (id, text) of items is an item, with an id of any type or none;
a term that no document has adds nothing; only scores above 0 are returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from glossaflow.plans.scratch import bounded_batches, stage_table

BEST = 20
ITEM_CHARS = 16_000_000
SHARD_ROWS, SHARD_POSTINGS = 1 << 16, 1 << 22
GRAIN = 8  # block borders lie at multiples of so many postings
LONGEST = 32  # grains in a block at most
FIXED = 64  # a block costs as much as an error of so many mean impacts
FIRST = 64  # stretches of the first round; each further one has eight times as many
SALTS = 64
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_norms(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    if len(n) and 25 * int(n.max()) * documents >= 1 << 63:
        return np.array([75 + 25 * int(x) * documents // total for x in n], np.int64)
    return 75 + 25 * n * documents // total


def impacts(weights: np.ndarray, tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return weights * (1_000_000_000 * tf // (1000 * tf + 12 * norms))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def block_ends(values: np.ndarray, starts: np.ndarray, fixed: float, grain: int = GRAIN, longest: int = LONGEST) -> np.ndarray:
    """Where the blocks of lists end, in ascending order; list i is ``values[starts[i]:starts[i + 1]]``.

    The sum over blocks of (greatest value x length) plus ``fixed`` for each is
    least among all cuts at multiples of ``grain`` with ``longest`` grains a
    block at most; that differs from the sum of bound errors by the sum of all
    values alone. All lists take a step together, the longest first.
    """
    sizes = np.diff(starts)
    counts = -(-sizes // grain)
    lists = np.argsort(-counts, kind="stable")
    lists = lists[counts[lists] > 0]
    if not len(lists):
        return np.empty(0, np.int64)
    counts, sizes, begins = counts[lists], sizes[lists], starts[:-1][lists]
    at = np.concatenate(([0], np.cumsum(counts)))  # grains of the lists in this order
    place = _ranges(np.zeros(len(lists), np.int64), counts)
    grain_start = np.repeat(begins, counts) + place * grain
    grain_size = np.minimum(grain, np.repeat(sizes, counts) - place * grain)
    order = np.argsort(grain_start)
    top = np.empty(len(order))
    # Lists that follow each other fill ``values`` but for those without postings, which have no place.
    top[order] = np.maximum.reduceat(values, grain_start[order])
    cost = np.full((len(lists), longest), np.inf)
    most, held = np.zeros((len(lists), longest)), np.zeros((len(lists), longest))
    best = np.zeros(len(lists))
    back = np.empty(len(order), np.int64)
    alive = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), side="right")
    for j, n in enumerate(alive.tolist()):
        now = at[:n] + j
        cost[:n, 1:], cost[:n, 0] = cost[:n, :-1].copy(), best[:n]
        most[:n, 1:], most[:n, 0] = most[:n, :-1].copy(), 0
        held[:n, 1:], held[:n, 0] = held[:n, :-1].copy(), 0
        np.maximum(most[:n], top[now][:, None], out=most[:n])
        held[:n] += grain_size[now][:, None]
        total = cost[:n] + most[:n] * held[:n]
        pick = total.argmin(axis=1)
        back[now] = pick
        best[:n] = total[np.arange(n), pick] + fixed
    ends, left = [], counts.copy()
    while len(left):
        last = at[: len(counts)] + left - 1
        ends.append(grain_start[last] + grain_size[last])
        left = left - back[last] - 1
        more = left > 0
        left, counts, at = left[more], counts[more], at[:-1][more]
        at = np.concatenate((at, [0]))
    return np.sort(np.concatenate(ends))


@dataclass(frozen=True)
class Shard:
    """Postings by term, then document, with the blocks of each term."""

    doc: np.ndarray
    impact: np.ndarray
    starts: np.ndarray  # of the postings of each term
    block_start: np.ndarray
    block_end: np.ndarray
    block_max: np.ndarray
    blocks_of: np.ndarray  # first block of each term

    @staticmethod
    def of(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int) -> Shard:
        """Postings in the order of documents."""
        order = np.argsort(term, kind="stable")
        doc, term, impact = doc[order], term[order], impact[order]
        starts = np.searchsorted(term, np.arange(terms + 1))
        ends = block_ends(impact, starts, FIXED * float(impact.mean()) if len(impact) else 0.0)
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        greatest = np.maximum.reduceat(impact, begins) if len(ends) else impact
        return Shard(doc, impact, starts, begins, ends, greatest, np.searchsorted(begins, starts))

    def best(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, by falling score, then by document."""
        first, count = self.blocks_of[terms], self.blocks_of[terms + 1] - self.blocks_of[terms]
        block = _ranges(first, count)
        none = np.empty(0, np.int64)
        if not len(block):
            return none, none
        times = np.repeat(times, count)
        begin, end, bound = self.block_start[block], self.block_end[block], self.block_max[block] * times
        low, high = self.doc[begin], self.doc[end - 1] + 1
        borders = np.unique(np.concatenate((low, high)))
        a, b = np.searchsorted(borders, low), np.searchsorted(borders, high)
        steps = np.zeros(len(borders) + 1, np.int64)
        np.add.at(steps, a, bound)
        np.add.at(steps, b, -bound)
        bounds = np.cumsum(steps)[: len(borders) - 1]
        order = np.argsort(-bounds, kind="stable")
        docs, scores, threshold = none, none, 1
        taken, size = 0, FIRST
        while taken < len(order):
            picked = order[taken : taken + size]
            picked = picked[bounds[picked] >= threshold]
            if not len(picked):
                break
            live = np.zeros(len(borders) + 1, np.int64)
            live[picked] = 1
            upto = np.concatenate(([0], np.cumsum(live)))
            read = upto[b] > upto[a]  # blocks that reach into a live stretch; the others stay unread
            sizes = (end - begin)[read]
            at = _ranges(begin[read], sizes)
            doc = self.doc[at]
            inside = live[np.searchsorted(borders, doc, side="right") - 1] == 1
            at, doc = at[inside], doc[inside]
            limit, factor = np.repeat(bound[read], sizes)[inside], np.repeat(times[read], sizes)[inside]
            found, where = np.unique(doc, return_inverse=True)
            own = np.zeros(len(found), np.int64)
            np.add.at(own, where, limit)
            near = own >= threshold
            score = np.zeros(len(found), np.int64)
            scored = near[where]
            np.add.at(score, where[scored], self.impact[at[scored]] * factor[scored])
            docs, scores = np.concatenate((docs, found[near])), np.concatenate((scores, score[near]))
            keep = np.lexsort((docs, -scores))[:k]
            keep = keep[scores[keep] > 0]
            docs, scores = docs[keep], scores[keep]
            if len(docs) == k:
                threshold = max(1, int(scores[-1]))
            taken, size = taken + size, size * 8
        return docs, scores


def _bags(docs: DataFrame, wanted: list[bytes], text: str, doc_id: str) -> DataFrame:
    """(doc_id, n, terms, times): the length of each document and the wanted terms it has, by number; staged."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # ITEM_CHARS at most
    schema = StructType().add("doc_id", docs.schema[doc_id].dataType).add("n", "long").add("terms", ArrayType(IntegerType())).add("times", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        for b in batches:
            n, terms, times = [], [], []
            for t in b.column(1).to_pylist():
                words = terms_of(t)
                found = Counter(map(number.get, words))
                found.pop(None, None)
                n.append(len(words))
                terms.append(list(found))
                times.append(list(found.values()))
            columns = [pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=schema.names)

    counted = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    return stage_table(counted.filter("n > 0"), "bags")


def _order(ids: list) -> list[int]:
    return sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i]))


def _search(bags: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(q, doc_id, score): the k best of each shard; queries: number, terms, times."""
    shared = bags.sparkSession.sparkContext.broadcast((queries, weights))
    schema = StructType().add("q", "long").add("doc_id", bags.schema["doc_id"].dataType).add("score", "long")

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.take(pa.array(_order(table.column("doc_id").to_pylist())))
        column = lambda name: table.column(name).combine_chunks()
        terms, times = column("terms"), column("times")
        size = terms.value_lengths().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(table.num_rows), size)
        term, tf = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (terms, times))
        norms = length_norms(column("n").to_numpy(zero_copy_only=False), documents, total)
        shard = Shard.of(doc, term, impacts(weights[term], tf, norms[doc]), len(weights))
        found = [(q, *shard.best(t, c, k)) for q, t, c in queries]
        q = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
        docs, scores = (np.concatenate([f[c] for f in found]).astype(np.int64) for c in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(q), column("doc_id").take(pa.array(docs)), pa.array(scores)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, postings = [], 0, 0
        for b in batches:
            held.append(b)
            rows, postings = rows + b.num_rows, postings + len(b.column(2).flatten())
            if rows >= SHARD_ROWS or postings >= SHARD_POSTINGS:
                yield from solve(held)
                held, rows, postings = [], 0, 0
        if rows:
            yield from solve(held)

    return bags.filter(F.size("terms") > 0).mapInArrow(run, schema)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each item of rows (q, doc_id, score), with their rank."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= k).drop("salt")


def rank(docs: DataFrame, items: DataFrame, k: int = BEST, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest scores above 0 for each item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    asked = stage_table(asked.withColumn("q", F.monotonically_increasing_id()), "items")
    blocks = 1 + (asked.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS
    out = None
    for j in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == j).select("q", "text").collect()
        counts = [(r["q"], Counter(terms_of(r["text"]))) for r in rows]
        wanted = sorted({t for _, c in counts for t in c})
        number = {t: i for i, t in enumerate(wanted)}
        bags = _bags(docs, wanted, text, doc_id)
        facts = bags.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        weights = np.zeros(len(wanted), np.int64)
        for r in bags.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block's items
            weights[r["term"]] = weight(facts["documents"], r["count"])
        queries = [(q, np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for q, c in counts if c]
        found = _best(_search(bags, queries, weights, facts["documents"], facts["total"], k), k)
        out = found if out is None else out.unionByName(found)
    return out.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
