"""SimHash near-duplicates of five-word shingles, decided by exact Jaccard similarity.

Texts are linked where the sets of their five-word shingles have a similarity
of 0.8 or more, and groups are the connected components. Bits alone can't find
such pairs: at 0.8 the fingerprints of op9 differ in about ten of 64 bits, which
no key of equal bits survives. So the steps of ``simhash`` are kept, with
candidates of another kind and a last exact step:

1. candidates share a shingle among the first fifth of each, all shingles being
   in one total order (prefix filter, which loses no pair), and pass the bounds
   on size and place;
2. each text has a 256-bit fingerprint and, computed once, its distances to
   ``PIVOTS`` reference fingerprints. Candidates go if these differ by more than
   ``FAR`` anywhere, then if the fingerprints do. At a similarity of 0.8 the
   fingerprints of ``SMALL`` shingles or more differ in 41 bits or fewer on
   average, with a deviation of 6, so that ``FAR`` is more than six deviations
   away; pairs of fewer shingles aren't judged by bits;
3. survivors are compared by their whole sets.

The order is by how often a shingle occurs in a sample, then by hash. It is
the same for all texts, so the sample changes the cost and never the result.
Of a shingle that several texts share, each text first meets the one before it
and the first; what these join is one group from then on. In up to ``ROUNDS``
rounds, neighbours of different groups in another order meet, as long as one in
twenty of them is linked, and what is left of different groups then meets in
full, dealt by pairs of chunks, so that no task has all texts of a shingle. There
sketches of op11's kind, of two bits a coordinate, discard pairs that agree in
fewer coordinates than five deviations below what 0.8 has, and a pair leaves the
task of the first shingle it shares alone. So many near copies of one text cost
few comparisons. A shingle that by the sample has more than ``CHUNK`` texts is
dealt to several tasks in the first pass too, with its first text in each.

The bounds of steps 2 and of the sketches are such by probability: a pair of
just 0.8 is lost to them with less than one in ten million. All else loses none.

Defined cases: texts of fewer words have one shingle, of all words; texts
without words and null texts are equal; rows without an id are linked but name
no group; ids may be of any type. Sets are of 64-bit hashes, and texts of equal
words are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from glossaflow.llm.columns import apart
from glossaflow.llm.sketches import LEAST_PACKED, packed, packed_agreement, sketch
from glossaflow.plans.components import components
from glossaflow.plans.scratch import bounded_batches, release, stage_table

SHINGLE = 5
SEED = 42
SAMPLED = 16  # one row of so many is counted for the order
OFTEN, OFTEN_AT_MOST = 4, 1 << 16
ROUNDS = 6
FEW = 4  # texts that share a shingle and meet in full at once
CHUNK = 2048
WORDS = 4  # of 64 bits in a fingerprint
PIVOTS = 16
FAR = 80
SMALL = 32
HELD = 1 << 19
EMITTED = 1 << 18
_PAIR = "a bigint, b bigint"
_pivots = np.random.default_rng(256).integers(0, 1 << 64, (PIVOTS, WORDS), dtype=np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """(hash of all words, distinct hashes of the shingles in ascending order)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    whole = b" ".join(words)
    node = xxhash.xxh64_intdigest(whole, SEED)
    node -= (node >> 63) << 64
    if not words:
        return node, np.empty(0, np.int64)
    n = max(1, len(words) - shingle + 1)
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[: n - 1] + 1))
    ends = stops[shingle - 1 :] if len(words) > shingle else stops[-1:]
    digest = xxhash.xxh64_intdigest
    return node, np.unique(np.array([digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64).view(np.int64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingles' hashes, ``WORDS`` of each."""
    ones = np.zeros(64 * WORDS, np.int64)
    with np.errstate(over="ignore"):
        for part in np.array_split(hashes.view(np.uint64), 1 + len(hashes) // 4096):
            wide = part[:, None] * (np.uint64(0x9E3779B97F4A7C15) * np.arange(1, 2 * WORDS, 2, dtype=np.uint64))
            wide = (wide ^ (wide >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            bits = np.unpackbits((wide ^ (wide >> np.uint64(32))).view(np.uint8).reshape(len(part), 8 * WORDS), axis=1, bitorder="little")
            for a in range(0, len(bits), 255):  # sums of 255 bits fit a byte
                ones += np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def pivot_distances(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to the reference ones, 255 at most."""
    return np.minimum(np.bitwise_count(prints[:, None, :] ^ _pivots).sum(axis=2, dtype=np.int64), 255).astype(np.uint8)


def similar(n: np.ndarray, m: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Whether sets of n and m with so many shared have a similarity of 0.8."""
    return 9 * shared >= 4 * (n + m)


def prefix(hashes: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles in the common order, of which similar texts share one."""
    n = len(hashes)
    if not n:
        return hashes
    count = np.zeros(n, dtype=np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
        count = np.where(often[at] == hashes, times[at], 0)
    return hashes[np.lexsort((hashes, count))[: n - (4 * n + 4) // 5 + 1]]


def chunks_of(keys: np.ndarray, often: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
    """To how many tasks each shingle is dealt."""
    out = np.ones(len(keys), dtype=np.int32)
    if len(often):
        at = np.minimum(np.searchsorted(often, keys), len(often) - 1)
        out = np.where(often[at] == keys, 1 + SAMPLED * times[at] // size, 1).astype(np.int32)
    return out


def _often(docs: DataFrame, text: str, doc_id: str) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of sampled rows, in ascending order, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t)[1] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["h"])

    sample = docs.filter(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(SAMPLED)) == 0).select(text)
    counted = sample.mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    found = counted.orderBy(F.desc("n"), "h").limit(OFTEN_AT_MOST).toArrow()
    h, n = found.column("h").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def marked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each of ``docs``: id, raw (hash of the text), node, n (shingles), keys (their prefix),
    chunks (tasks that each key is dealt to), print, pivots."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_often(docs, text, doc_id))  # OFTEN_AT_MOST at most
    size = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        for b in batches:
            nodes, sizes, keys, chunks, prints = [], [], [], [], []
            for t in b.column(2).to_pylist():
                node, h = shingles(t)
                nodes.append(node)
                sizes.append(len(h))
                keys.append(prefix(h, often, times))
                chunks.append(chunks_of(keys[-1], often, times, size))
                prints.append(fingerprint(h))
            prints = np.stack(prints) if prints else np.empty((0, WORDS), np.uint64)
            rows = lambda a: pa.array([x.tobytes() for x in a], pa.binary())
            added = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(chunks, pa.list_(pa.int32())), rows(prints), rows(pivot_distances(prints))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *added], names=[f.name for f in schema.fields])

    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("raw"), F.col(text).alias("text"))
    more = [StructField("node", LongType()), StructField("n", LongType()), StructField("keys", ArrayType(LongType())), StructField("chunks", ArrayType(IntegerType())), StructField("print", BinaryType()), StructField("pivots", BinaryType())]
    schema = StructType([*rows.schema.fields[:2], *more])
    return rows.mapInArrow(run, schema)


def _possible(n: np.ndarray, p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether texts whose first shared shingle stands at these places can be similar."""
    return similar(n[x], n[y], np.minimum(n[x] - p[x], n[y] - p[y]))


def _few_and_first(group: np.ndarray, large: np.ndarray, n: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of small groups; of large ones each row with the one before it and the first."""
    begin = np.concatenate(([0], np.cumsum(np.bincount(group))[:-1]))
    every = np.arange(len(group))
    for x, y in ((every[large], begin[group[large]]), (every[large], every[large] - 1)):
        keep = (x > y) & (y >= begin[group[x]])
        x, y = x[keep], y[keep]
        keep = _possible(n, p, x, y)
        yield x[keep], y[keep]
    at = every[~large]
    for step in range(1, FEW):
        at = at[at + step < len(group)]
        # Ordered by size, whoever is too large here stays too large.
        at = at[(group[at] == group[at + step]) & (5 * n[at] >= 4 * n[at + step])] if len(at) else at
        if not len(at):
            break
        keep = at[_possible(n, p, at, at + step)]
        yield keep, keep + step


MET = "a bigint, b bigint, key bigint, n bigint, p bigint, node bigint"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) among rows (key, chunk, n, p, node) ordered by all but p, whole groups at a time.

    The rows of large groups and of those dealt to several tasks follow, which
    may have to meet again; other groups are chunk -1.
    """
    kinds = pa.schema([(c.split()[0], pa.int64()) for c in MET.split(", ")])

    def rows_of(*columns: np.ndarray) -> pa.RecordBatch:
        empty = pa.nulls(len(columns[0]), pa.int64())
        found = [pa.array(c) for c in columns]
        return pa.RecordBatch.from_arrays([*found, *[empty] * 4] if len(found) == 2 else [empty, empty, *found], schema=kinds)

    def pairs_of(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(held)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))]
        return rows_of(pairs[:, 0], pairs[:, 1])

    def solve(key: np.ndarray, chunk: np.ndarray, n: np.ndarray, p: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])))) - 1
        alone = np.bincount(group)[group] < 2
        if alone.all():
            return
        group, key, chunk, n, p, node = (c[~alone] for c in (group, key, chunk, n, p, node))
        group = np.unique(group, return_inverse=True)[1]
        large = (np.bincount(group)[group] > FEW) | (chunk >= 0)
        held, count = [], 0
        for x, y in _few_and_first(group, large, n, p):
            u, v = node[x], node[y]
            u, v = u[u != v], v[u != v]  # the first of a run is in each of its chunks
            held.append(np.stack((np.minimum(u, v), np.maximum(u, v)), axis=1))
            count += len(u)
            if count >= EMITTED:
                yield pairs_of(held)
                held, count = [], 0
        if count:
            yield pairs_of(held)
        if large.any():
            yield rows_of(key[large], n[large], p[large], node[large])

    held: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        count += batch.num_rows
        if count >= HELD:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = int(np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[0])
            if last:
                yield from solve(*(c[:last] for c in cols))
            held, count = [[c[last:] for c in cols]], (len(cols[0]) - last) // 2
    if held:
        yield from solve(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _candidates(rows: DataFrame) -> DataFrame:
    """What ``_meet`` finds among rows (key, chunk, n, p, node), staged."""
    dealt = rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "n", "node")
    return stage_table(dealt.mapInArrow(_meet, MET), "met")


def _pairs(met: DataFrame) -> DataFrame:
    return met.filter("a IS NOT NULL").select("a", "b").distinct()


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose pivot distances, then fingerprints, are near enough, or that are small."""

    def column(b: pa.RecordBatch, k: int, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=kind).reshape(b.num_rows, -1)

    for b in (b for b in batches if b.num_rows):
        small = b.column(2).to_numpy() < SMALL
        far = np.abs(column(b, 3, np.uint8).astype(np.int16) - column(b, 4, np.uint8)).max(axis=1, initial=0) > FAR
        bits = np.bitwise_count(column(b, 5, np.uint64) ^ column(b, 6, np.uint64)).sum(axis=1, dtype=np.int64)
        yield b.select([0, 1]).filter(pa.array(small | ~far & (bits <= FAR)))


def _verified(pairs: DataFrame, once: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose whole sets have a similarity of 0.8 or more; texts: id, raw, text."""
    bounded_batches(pairs.sparkSession)
    pairs = stage_table(pairs, "candidates")
    side = lambda x: once.selectExpr(f"node AS {x}", f"n AS n{x}", f"pivots AS d{x}", f"print AS f{x}")
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.least("na", "nb"), "da", "db", "fa", "fb")
    left = stage_table(both.mapInArrow(_within, _PAIR), "survivors")
    wanted = left.selectExpr("explode(array(a, b)) AS node").distinct().join(once.select("node", F.col("id").alias("wanted_id"), "raw"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t)[1] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "h"])

    wanted = stage_table(wanted, "wanted")
    met = (texts["raw"] == wanted["raw"]) & texts["id"].eqNullSafe(wanted["wanted_id"])
    found = texts.join(wanted, met).select("node", "text")
    sets = stage_table(found.mapInArrow(run, "node bigint, h array<bigint>").dropDuplicates(["node"]), "sets")
    met = left.join(sets.selectExpr("node AS a", "h AS ha"), "a").join(sets.selectExpr("node AS b", "h AS hb"), "b")
    out = stage_table(met.filter("9 * size(array_intersect(ha, hb)) >= 4 * (size(ha) + size(hb))").select("a", "b"), "verified")
    release(pairs, left, wanted, sets)
    return out


def _apart_rows(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """Rows (key, n, p, node, label) of the shingles that texts of different groups share, staged."""
    labelled = rows.join(tied, "node", "left").select("key", "n", "p", "node", F.coalesce("root", "node").alias("label"))
    labelled = stage_table(labelled.dropDuplicates(["key", "node"]), "labelled")
    keys = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    out = stage_table(labelled.join(stage_table(keys, "keys-apart"), "key", "left_semi"), "rows-apart")
    release(labelled)
    return out


def _neighbours(rows: DataFrame, k: int) -> DataFrame:
    """Pairs of texts of different groups that follow each other under a shingle, in an order of round ``k``."""
    before = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(k), "node"))
    last = F.lag(F.struct("n", "p", "node", "label")).over(before)
    pairs = rows.withColumn("o", last).filter("label <> o.label AND 9 * least(n - p, o.n - o.p) >= 4 * (n + o.n)")
    return pairs.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()


def _last_meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different labels in groups (key, i, j) of rows (key, i, j, side, n, p, node, label, before, sketch), ordered by the first three."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        i, j, side, n, p, node, label = (table.column(c).to_numpy() for c in ("i", "j", "side", "n", "p", "node", "label"))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(n), -1)
        lists = table.column("before").combine_chunks()
        places, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        before = [places[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        _, number, count = np.unique(label, return_inverse=True, return_counts=True)
        most, every = number == count.argmax(), np.arange(len(n))
        a, b = [node[:0]], [node[:0]]
        for x in np.flatnonzero(~most).tolist():
            # Rows of the greatest group don't take the lead, so each pair is seen from one end, or from the first of two.
            near = (number != number[x]) & (most | (every > x)) & similar(n, n[x], np.minimum(n - p, n[x] - p[x]))
            near = np.flatnonzero(near & (side != side[x]) if i[0] != j[0] else near)
            near = near[packed_agreement(sketches[near], sketches[x]) >= LEAST_PACKED]
            first = [y for y in near.tolist() if not len(before[x]) or not len(before[y]) or not np.isin(before[x], before[y]).any()]
            a.append(np.minimum(node[first], node[x]))
            b.append(np.maximum(node[first], node[x]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        names = [c.to_numpy() for c in batch.columns[:3]]
        new = (np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in names])) + 1).tolist() if batch.num_rows else []
        for start, stop in zip([0, *new], [*new, batch.num_rows], strict=True):
            if start < stop:
                own = tuple(int(c[start]) for c in names)
                if held and own != now:
                    yield solve(held)
                    held = []
                now = own
                held.append(batch.slice(start, stop - start))
    if held:
        yield solve(held)


def _meeting_rows(apart_rows: DataFrame, once: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (key, i, j, side, n, p, node, label, before, sketch) for ``_last_meeting``.

    A row goes to many tasks, so it has two bits a coordinate, and of its text's shingles those alone that
    come before its own in the common order and are in ``apart_rows`` too: a pair that shares one of them
    meets there. One that shares an earlier shingle of few texts has met there in full before.
    """
    bounded_batches(apart_rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [packed(sketch(shingles(t)[1])).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["node", "sketch"])

    wanted = stage_table(apart_rows.select("node").distinct().join(once.select("node", F.col("id").alias("wanted_id"), "raw"), "node"), "wanted")
    met = (texts["raw"] == wanted["raw"]) & texts["id"].eqNullSafe(wanted["wanted_id"])
    sketches = stage_table(texts.join(wanted, met).select("node", "text").mapInArrow(run, "node bigint, sketch binary").dropDuplicates(["node"]), "sketches")
    chunks = stage_table(apart_rows.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")), "parts")
    held = apart_rows.groupBy("node").agg(F.collect_list(F.struct("p", "key")).alias("held"))  # a prefix at most
    dealt = apart_rows.join(chunks, "key").withColumn("side", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.join(held, "node").join(sketches, "node")
    before = F.transform(F.filter("held", lambda x: x["p"] < F.col("p")), lambda x: x["key"])
    rows = dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "n", "p", "node", "label", before.alias("before"), "sketch")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _left(apart_rows: DataFrame, once: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): pairs of different groups under a shingle whose sketches are near enough."""
    return _meeting_rows(apart_rows, once, texts).mapInArrow(_last_meeting, _PAIR).distinct()


def near_nodes(once: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of all nodes of staged rows ``once`` that are no root themselves."""
    spread = once.filter("n > 0").select(F.posexplode(F.arrays_zip("keys", "chunks")).alias("p", "k"), "n", "node")
    spread = spread.select(F.col("k.keys").alias("key"), F.col("k.chunks").alias("chunks"), "n", F.col("p").cast("long").alias("p"), "node")
    columns = ["key", "chunk", "n", "p", "node"]
    chunk = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("node"), "chunks")).otherwise(-1).cast("long")
    rows = spread.withColumn("chunk", chunk).select(*columns)
    hot = spread.filter("chunks > 1").groupBy("key").agg(F.max("chunks").alias("chunks"), F.min(F.struct("n", "node", "p")).alias("first"))
    heads = hot.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk"), "first.*")
    met = _candidates(rows.unionByName(heads.select(*columns)))
    near = _verified(_pairs(met), once, texts)
    large = met.filter("key IS NOT NULL").select("key", "n", "p", "node")
    for k in range(ROUNDS):
        apart_rows = _apart_rows(large, components(near))
        pairs = stage_table(_neighbours(apart_rows, k), "neighbours")
        found = _verified(pairs, once, texts)
        near = near.unionByName(found)
        tried, linked = pairs.count(), found.count()
        release(apart_rows, pairs)
        if 20 * linked < tried or not tried:
            break
    apart_rows = _apart_rows(large, components(near))
    if apart_rows.limit(1).count():
        near = near.unionByName(_verified(_left(apart_rows, once, texts), once, texts))
    release(met, apart_rows)
    return components(near)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group, with its columns: that of the smallest id.

    Of different texts of that id one stays, of repeated rows too. Rows without
    an id go if their group has an id, and all stay if it has none.
    """
    raw, drop_id, drop_raw = apart(docs, "raw", "drop_id", "drop_raw")
    rows = stage_table(marked(docs, text, doc_id), "marked")
    once = stage_table(rows.dropDuplicates(["node"]), "once")
    tied = near_nodes(once, docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("raw"), F.col(text).alias("text")))
    facts = rows.groupBy("id", "raw", "node").agg(F.count("*").alias("n"))
    facts = facts.join(tied, "node", "left").select("id", "raw", "node", "n", F.coalesce("root", "node").alias("root"))
    facts = stage_table(facts, "facts")
    release(rows, once)
    first = facts.filter("id IS NOT NULL").groupBy("root").agg(F.min(F.struct("id", "node")).alias("first"))
    # Of one id and node, texts of other spacing are copies too: the least hash stays.
    own = F.struct("id", "node") == F.col("first")
    judged = facts.join(first, "root", "left").withColumn("stays", F.when(F.col("first").isNull(), True).otherwise(F.coalesce(own, F.lit(False))))
    least = judged.filter("stays AND id IS NOT NULL").groupBy("id", "node").agg(F.min("raw").alias("least"))
    judged = judged.join(least, ["id", "node"], "left").withColumn("stays", F.col("stays") & (F.col("least").isNull() | (F.col("least") == F.col("raw"))))
    judged = stage_table(judged.select("id", "raw", "n", "stays"), "judged")
    drop = judged.filter("NOT stays").select(F.col("id").alias(drop_id), F.col("raw").alias(drop_raw))
    keyed = docs.withColumn(raw, F.xxhash64(text))
    out = keyed.join(drop, F.col(doc_id).eqNullSafe(F.col(drop_id)) & (F.col(raw) == F.col(drop_raw)), "left_anti")
    if judged.filter("stays AND id IS NOT NULL AND n > 1").limit(1).count():
        nameless = out.filter(F.col(doc_id).isNull())
        out = out.filter(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, raw]).unionByName(nameless)
    return out.select(*docs.columns)
