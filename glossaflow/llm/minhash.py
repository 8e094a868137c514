"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Texts are linked where the sets of their four-word shingles have a Jaccard
similarity of 0.8 or more; groups are the connected components of the links.

1. A sketch has ``SKETCH`` coordinates. In each round every shingle is thrown
   by a hash of its own into one of them with a value, and a coordinate keeps
   the least value of the first round that reached it; round ``SKETCH + i``
   throws all shingles into coordinate i. So every coordinate is filled, after
   one round where a set is large, and two sketches agree in a coordinate with
   the probability of the sets' similarity, concentrated about as if coordinates
   were independent.
2. Four coordinates of 16 bits are a band, of which ``BANDS`` are kept. A pair of
   similarity 0.8 shares none with a probability of 0.5904^28, 4 in 10^7; more
   similar ones sooner share.
3. Sets that are equal are one node from the start. Under a band, a hub is the
   least of its nodes, found by aggregation; each node meets the hub with which
   it shares most bands, and the pair is verified on the full sets. What this
   links is one group; bands that still hold several groups choose another hub,
   in up to ``ROUNDS`` rounds, so that a large group of near copies costs a
   comparison or a few for each text.
4. What is left, texts of different groups under a band, meets in full, dealt by
   pairs of chunks. There whole sketches, a byte a coordinate, are made again for
   these texts alone and decide which pairs are verified: those that agree in
   ``LEAST`` coordinates or more, which is over five deviations below what 0.8
   has. A pair leaves the one task alone that holds the first band it shares.

No task holds all texts of a band, and no pair within a group is made but these.

Defined cases: texts of fewer words have one shingle, of all words; texts
without words and null texts have none and are linked with nothing; rows
without an id come after all others, are linked, and name a component of null
if it has no other rows; rows of one id and text are one document, with a row
each; ids may be of any type that has an order. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.columns import numbered
from glossaflow.llm.near_copies import shingles
from glossaflow.llm.sketches import LEAST, SKETCH, agreement, sketch
from glossaflow.plans.components import components
from glossaflow.plans.scratch import bounded_batches, release, stage_table

SHINGLE = 4
BANDS = 28  # of four coordinates
ROUNDS = 6
CHUNK = 1024
FILTER_BITS = 24
_marks = np.random.default_rng(7).integers(-(1 << 62), 1 << 62, BANDS)


def _sketched(plain: DataFrame, shingle: int) -> DataFrame:
    """(number, n, high, low, bands) of rows (doc_id, text): size, digest and bands of each set."""
    schema = "number bigint, n bigint, high bigint, low bigint, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, rows = [], [], []
            for t in b.column(1).to_pylist():
                _, h = shingles(t, shingle)
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                rows.append(sketch(h)[: 4 * BANDS].view(np.int64) if len(h) else None)
            digests = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            columns = [pa.array(sizes, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(rows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["number", "n", "high", "low", "bands"])

    return plain.select("doc_id", "text").mapInArrow(run, schema)


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(a, b, h) of rows (a, b, text); rows of one b lie together, and its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, np.int64)
        for batch in batches:
            sets = []
            for b, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b != last:
                    last, held = b, shingles(t, shingle)[1]
                sets.append(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["a", "b", "h"])

    return rows.mapInArrow(run, "a bigint, b bigint, h array<bigint>")


def _likely(plain: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``plain`` whose id may be in ``ids`` (one column): all that are, and few others.

    A bitmap of ``FILTER_BITS`` bits of a hash, whatever the number of ids, so
    that a join after it moves the texts it needs and not the corpus. Only ids
    go to Python.
    """
    spot = F.pmod(F.xxhash64(ids.columns[0]), F.lit(1 << FILTER_BITS))
    words = ids.groupBy(F.floor(spot / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))).alias("bits"))
    found = words.toArrow()
    bits = np.zeros(1 << FILTER_BITS >> 6, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool))

    @F.pandas_udf("boolean")
    def hit(spots: pd.Series) -> pd.Series:
        return pd.Series(shared.value[spots.to_numpy()])

    return plain.filter(hit(F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))))


def _verified(pairs: DataFrame, plain: DataFrame, shingle: int) -> DataFrame:
    """Those of staged pairs (a, b) whose whole sets have a similarity of 0.8 or more, staged.

    The set of b travels with the pair to that of a, which is made once.
    """
    own = _sets(_likely(plain, pairs.select("b")).join(pairs, F.col("doc_id") == F.col("b")).select("a", "b", "text"), shingle)
    hubs = _likely(plain, pairs.select("a")).join(pairs.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi")
    hubs = _sets(hubs.select("doc_id", F.col("doc_id").alias("b"), "text"), shingle).select("a", F.col("h").alias("o"))
    met = own.join(hubs, "a").filter("9 * size(array_intersect(h, o)) >= 4 * (size(h) + size(o))")
    return stage_table(met.select("a", "b"), "verified")


def _nearest(rows: DataFrame) -> DataFrame:
    """(a, b): the hub with which each node b shares most bands, of rows (node, hub); staged."""
    counted = rows.groupBy("node", "hub").agg(F.count("*").alias("bands"))
    best = counted.groupBy("node").agg(F.max(F.struct("bands", "hub")).alias("best"))
    return stage_table(best.select(F.col("best.hub").alias("a"), F.col("node").alias("b")), "pairs")


def _apart(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """Rows (key, node, label) of the bands that hold several groups, staged."""
    labelled = rows.join(tied, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label"))
    labelled = stage_table(labelled, "labelled")
    several = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
    out = stage_table(labelled.join(stage_table(several, "keys-apart"), "key", "left_semi"), "apart")
    release(labelled)
    return out


def _hubs(apart: DataFrame, k: int) -> DataFrame:
    """(node, hub): nodes of another group than the hub that round ``k`` gives their band."""
    hub = F.min(F.struct(F.xxhash64(F.lit(k), "node"), "node", "label")).alias("o")
    met = apart.join(apart.groupBy("key").agg(hub), "key").filter("label <> o.label")
    return met.select("node", F.col("o.node").alias("hub"))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs to verify of rows (key, i, j, side, n, node, label, bands, sketch), ordered by the first three."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        key, i, j, side, n, node, label = (table.column(c).to_numpy() for c in ("key", "i", "j", "side", "n", "node", "label"))
        longs = table.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(n), SKETCH)
        band = int(np.flatnonzero((longs[0] ^ _marks) == key[0])[0])
        names, number, count = np.unique(label, return_inverse=True, return_counts=True)
        most = number == count.argmax()
        a, b = [node[:0]], [node[:0]]
        apart = i[0] != j[0]
        for x in np.flatnonzero(~most).tolist():
            # Rows of the greatest group don't take the lead, so each pair is seen from one end, or from the first of two.
            near = (number != number[x]) & (most | (np.arange(len(n)) > x)) & (5 * n >= 4 * n[x]) & (4 * n <= 5 * n[x])
            near = np.flatnonzero(near & (side != side[x]) if apart else near)
            near = near[agreement(sketches[near], sketches[x]) >= LEAST]
            near = near[(longs[near] == longs[x]).argmax(axis=1) == band] if len(near) else near
            a.append(np.full(len(near), node[x]))
            b.append(node[near])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = [c.to_numpy() for c in batch.columns[:3]]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1 if batch.num_rows else []
        cuts = [0, *list(new), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if start == stop:
                continue
            own = tuple(int(k[start]) for k in keys)
            if held and own != now:
                yield solve(held)
                held = []
            now = own
            held.append(batch.slice(start, stop - start))
    if held:
        yield solve(held)


def _whole_sketches(nodes: DataFrame, plain: DataFrame, shingle: int) -> DataFrame:
    """(node, sketch) of nodes, a byte a coordinate; staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sketch(shingles(t, shingle)[1]).astype(np.uint8).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["node", "sketch"])

    texts = _likely(plain, nodes.select("node")).join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    return stage_table(texts.mapInArrow(run, "node bigint, sketch binary"), "sketches")


def _left(apart: DataFrame, once: DataFrame, plain: DataFrame, shingle: int) -> DataFrame:
    """(a, b): pairs of different groups under a band whose sketches are near enough, once each; staged."""
    bounded_batches(apart.sparkSession)
    sketches = _whole_sketches(apart, plain, shingle)
    chunks = apart.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = apart.join(stage_table(chunks, "chunks"), "key").withColumn("side", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.join(once, "node").join(sketches, "node")
    rows = dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "n", "node", "label", "bands", "sketch")
    out = stage_table(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_meet, "a bigint, b bigint"), "left-pairs")
    release(sketches)
    return out


def near_nodes(once: DataFrame, plain: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, root) of all nodes of staged rows ``once`` (node, n, bands) that are no root themselves."""
    marks = F.array(*[F.lit(int(m)) for m in _marks])  # the same long in two bands is two keys
    spread = once.select("node", F.explode(F.zip_with("bands", marks, lambda long, mark: long.bitwiseXOR(mark))).alias("key"))
    hubs = spread.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub")
    rows = stage_table(spread.join(hubs, "key").select("key", "node", "hub"), "bands")
    pairs = _nearest(rows.filter("node <> hub"))
    links = _verified(pairs, plain, shingle)
    held = [rows, pairs, links]
    left = rows.drop("hub")
    for k in range(ROUNDS):
        left = _apart(left, components(links))
        pairs = _nearest(_hubs(left, k))
        found = _verified(pairs, plain, shingle)
        links = links.unionByName(found)
        held += [left, pairs, found]
        tried, linked = pairs.count(), found.count()
        if 20 * linked < tried or not tried:
            break
    left = _apart(left, components(links))
    held.append(left)
    if left.limit(1).count():
        pairs = _left(left, once, plain, shingle)
        found = _verified(pairs, plain, shingle)
        links = links.unionByName(found)
        held += [pairs, found]
    tied = components(links)
    release(*held)
    return tied


def _facts(docs: DataFrame, order: str, plain: DataFrame, shingle: int) -> DataFrame:
    """(number, n, root) of each document, staged."""
    bounded_batches(docs.sparkSession)
    sketched = stage_table(_sketched(plain, shingle), "sketched")
    alike = stage_table(sketched.filter("n > 0").groupBy("high", "low").agg(F.min("number").alias("node")), "equal-sets")
    once = stage_table(sketched.join(alike.select(F.col("node").alias("number")), "number", "left_semi").select(F.col("number").alias("node"), "n", "bands"), "once")
    tied = near_nodes(once, plain, shingle)
    named = alike.join(tied, "node", "left").select("high", "low", F.coalesce("root", "node").alias("root"))
    named = stage_table(named, "named")
    facts = sketched.select("number", "n", "high", "low").join(named, ["high", "low"], "left")
    facts = stage_table(facts.select("number", "n", F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("number")).alias("root")), "facts")
    release(sketched, alike, once, named)
    return facts


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """A row for each of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable), kept."""
    docs, order, plain = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    facts = _facts(docs, order, plain, shingle).withColumnsRenamed({"number": order, "n": "n_shingles"})
    ids = docs.select("doc_id", order)
    names = ids.distinct().select(F.col(order).alias("root"), F.col("doc_id").alias("component_id"))
    out = ids.join(facts, order).join(names, "root")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """The first document of each group by id, with its columns; of rows of one id and text one stays."""
    columns = docs.columns
    docs, order, plain = numbered(docs, doc_id, text)
    first = _facts(docs, order, plain, shingle).filter("number = root").select(F.col("number").alias(order))
    return docs.join(first, order, "left_semi").dropDuplicates([order]).select(*columns)
