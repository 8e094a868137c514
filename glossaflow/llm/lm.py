"""Language-model scores of documents, and a unigram base beside them.

Texts are lower-cased (A-Z) and cut into words at ASCII space, with one end
after the last. The base counts all words of all training rows. The model is
the self-attention model of ``attention`` over subword ids of the words: the
merges of a public rank file, up to the ids that the model has.

1. Words are counted, pre-aggregated in each task. Their subword counts, over
   all training rows, set the model's classes and first output biases.
2. The model is trained on all words of all training rows, once, in rounds. A
   row's hash puts it into a round and a shard of it; how many there are follows
   from the number of words, so neither partitions nor cores change a score. A
   round starts all its shards from the same parameters, a task trains a shard,
   and the shards' parameters are averaged by their numbers of ids. The first
   round is one shard of ``FIRST_WORDS``; a round has four times the shards of
   the one before, of twice the words, the last one what is left.
3. One pass scores each whole text, overlapping windows in batches. Words with
   a share of 1/``FREQUENT`` or more of the tokens, ``FREQUENT`` at most, go to
   the tasks; the others meet their counts in a join, where none can be hot.

Defined cases: null and empty texts are one end; rows without an id are learned
from and not held out; without training rows the base scores 0 per token;
repeated rows count and score as often as they occur, and are in one shard; ids
may be of any type.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from base64 import b64decode
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.llm import attention
from glossaflow.plans.scratch import bounded_batches, stage_table

FREQUENT = 2_000_000
BATCH = 256
FIRST_WORDS = 500_000
KNOWN_WORDS = 400_000
COUNTED = 400_000
SUMS = 16
HELD_IDS = 300_000
MOD, HELD_OUT = 7, 2
END_WORD = b"\n"  # no word holds a space


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, each different one held once, and the row of each word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real).cast(pa.binary()).dictionary_encode(), pc.list_parent_indices(lists).filter(real).to_numpy()


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % MOD, F.lit(-1))


class _Known(dict):
    """Packed ids of words; unknown words are encoded, short ones remembered."""

    def __init__(self, coder: tiktoken.Encoding):
        super().__init__()
        self._encode = coder._encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        ids = array("H", self._encode(b" " + word)).tobytes()
        if len(word) <= 64:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Subwords:
    """Ids of words, each with the space before it."""

    def __init__(self, content: bytes):
        ranks = {t: i for t, i in ((b64decode(a), int(b)) for a, b in map(bytes.split, content.splitlines())) if i < attention.END}
        self.coder = tiktoken.Encoding("subwords", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(self.coder)
        self.length = np.zeros(attention.IDS, np.int64)
        self.length[list(ranks.values())] = list(map(len, ranks))

    def ids(self, words: list[bytes], end: bool = True) -> np.ndarray:
        packed = b"".join(map(self.known.__getitem__, words))
        return np.frombuffer(packed + _END_ID if end else packed, dtype=np.int16)

    def rows(self, words: pa.DictionaryArray, row: np.ndarray, n: int) -> list[np.ndarray]:
        """Ids of each of n rows, and the end, of the words that ``split`` gives; different words are encoded once, in one text."""
        each = words.dictionary
        ids = self.coder.encode_to_numpy("".join(" " + w for w in each.cast(pa.string()).to_numpy(zero_copy_only=False)), disallowed_special=())
        spans = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(pc.binary_length(each).to_numpy() + 1)) + 1  # an id ends with each word
        offsets = np.concatenate(([0], 2 * spans)).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(np.int16))]).take(words.indices)
        ids, stops = np.frombuffer(packed.buffers()[2] or b"", np.int16), np.concatenate(([0], np.cumsum(pc.binary_length(packed).to_numpy() // 2)))
        cuts = stops[np.searchsorted(row, np.arange(n + 1))]
        end = np.frombuffer(_END_ID, np.int16)
        return [np.concatenate((ids[a:b], end)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_END_ID = np.uint16(attention.END).tobytes()
_subwords: dict[str, Subwords] = {}


def _coder(content: bytes) -> Subwords:
    key = hashlib.sha256(content).hexdigest()
    if key not in _subwords:
        _subwords.clear()
        _subwords[key] = Subwords(content)
    return _subwords[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c): how often each word, and the end, occurs in ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], names=["word", "c"])

        counts: Counter = Counter()
        for b in batches:
            words, _ = split(b.column(0))
            times = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)).tolist()
            for w, c in zip(words.dictionary.to_numpy(zero_copy_only=False).tolist(), times, strict=True):
                counts[w] += c
            counts[END_WORD] += b.num_rows
            if len(counts) > COUNTED:
                yield rows(counts)
                counts = Counter()
        if counts:
            yield rows(counts)

    return docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, ranks) -> np.ndarray:
    """Counts of the model's ids over all counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total = _coder(ranks.value), np.zeros(attention.IDS)
        for b in batches:
            ids = [_END_ID if w == END_WORD else coder.known[w] for w in b.column(0).to_pylist()]
            times = np.repeat(b.column(1).to_numpy(), [len(x) // 2 for x in ids])
            total += np.bincount(np.frombuffer(b"".join(ids), dtype=np.uint16), weights=times, minlength=attention.IDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(attention.IDS)), pa.array(total)], names=["id", "n"])

    out = np.zeros(attention.IDS)
    for r in counts.select("word", "c").mapInArrow(run, "id bigint, n double").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def plan_rounds(words: int, first: int = FIRST_WORDS) -> list[tuple[float, float, int]]:
    """(begin, end, shards) of each round; begin and end are shares of all rows' hashes."""
    rounds, done, k = [], 0, 0
    while done < words or not rounds:
        size = first * 2**k
        most = size * 4**k
        now = min(most, words - done)
        last = done + now >= words
        rounds.append((done / max(1, words), 1.0 if last else (done + now) / words, 4**k if now == most else max(1, math.ceil(now / size))))
        done, k = done + now, k + 1
    return rounds


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of parameters times weights, and of weights, in the order of the rows (shard, weight, flat)."""
    total, weight, first = None, 0.0, 0
    for b in batches:
        for shard, w, flat in zip(*(c.to_pylist() for c in b.columns), strict=True):
            part = np.frombuffer(flat, dtype=np.float64)
            total, first = (part.copy(), shard) if total is None else (total + part, first)
            weight += w
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([weight]), pa.array([total.tobytes()], pa.binary())], names=["shard", "weight", "flat"])


def learned(batches: Iterator[pa.RecordBatch], first: attention.Model, coder: Subwords) -> Iterator[pa.RecordBatch]:
    """(shard, weight, flat): for each shard the ids trained on, and parameters times ids, after
    one pass over all words of its rows (shard, text), which come one shard after the other."""
    names = ["shard", "weight", "flat"]
    now, trainer, seen = None, attention.Trainer(first), 0
    held: list[np.ndarray] = []
    size = 0

    def learn() -> int:
        windows, targets, _ = attention.blocks(held)
        order = np.random.default_rng(len(windows)).permutation(len(windows))
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            trainer.step(windows[at], targets[at])
        return int((targets >= 0).sum())

    def result() -> pa.RecordBatch:
        flat = trainer.model.flat().astype(np.float64) * seen
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([float(seen)]), pa.array([flat.tobytes()], pa.binary())], names=names)

    for b in batches:
        for shard, ids in zip(b.column(0).to_pylist(), coder.rows(*split(b.column(1)), b.num_rows), strict=True):
            if now is not None and shard != now:
                seen += learn() if held else 0
                yield result()
                trainer, seen, held, size = attention.Trainer(first), 0, [], 0
            now = shard
            held.append(ids)
            size += len(ids)
            if size >= HELD_IDS:
                seen += learn()
                held, size = [], 0
    if now is not None:
        seen += learn() if held else 0
        yield result()


def _round(rows: DataFrame, shards: int, model: attention.Model, ranks) -> attention.Model:
    """The average of models trained on the shards of rows (h, text), each from ``model`` on."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return learned(batches, shared.value, _coder(ranks.value))

    schema = "shard bigint, weight double, flat binary"
    dealt = rows.select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "text", "h")
    dealt = dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "h").select("shard", "text")
    parts = dealt.mapInArrow(run, schema).repartitionById(SUMS, (F.col("shard") % SUMS).cast("int")).sortWithinPartitions("shard")
    found = sorted(stage_table(parts.mapInArrow(_sums, schema), "parameters").collect())  # SUMS rows of fixed size
    weight = sum(r["weight"] for r in found)
    if not weight:
        return model
    return model.with_flat(sum(np.frombuffer(r["flat"], dtype=np.float64) for r in found) / weight)


def train(docs: DataFrame, counts: np.ndarray, words: int, ranks) -> attention.Model:
    """A model trained on all rows (h, text), h being a hash of the row, of so many words."""
    model = attention.start(counts)
    rounds = plan_rounds(words)
    place = (F.col("h").cast("double") / F.lit(2.0**64)) + 0.5
    before = docs
    if len(rounds) > 1:  # all rounds but the last hold about an eighth: they are read from a table of their own
        before = stage_table(docs.filter(place < rounds[-1][0]), "first-rounds")
    for k, (begin, end, shards) in enumerate(rounds):
        rows = (docs if k == len(rounds) - 1 else before).filter((place >= begin) & ((place < end) | F.lit(end >= 1)))
        model = _round(rows, shards, model, ranks)
    return model


def _scored(docs: DataFrame, model: attention.Model, frequent: dict[bytes, int], ranks) -> DataFrame:
    """A row per document with its model score, sums over frequent words, and the other words."""
    shared = docs.sparkSession.sparkContext.broadcast((model, {w: float(np.log10(c + 1)) for w, c in frequent.items()}))
    names = "doc_id rid n_tokens n_known part score words times"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rid bigint, n_tokens bigint, n_known bigint, part double, score double, words array<binary>, times array<int>"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, logs = shared.value
        coder, scorer = _coder(ranks.value), attention.Scorer(net)
        row = TaskContext.get().partitionId() << 40  # what a task writes is kept once, so its number and a row's are an id
        for b in batches:
            words, at = split(b.column(1))
            sequences, size, scores = [], 0, []
            for ids in coder.rows(words, at, b.num_rows):
                sequences.append(ids)
                size += len(ids)
                if size >= HELD_IDS:
                    scores.extend(scorer.scores(sequences).tolist())
                    sequences, size = [], 0
            scores.extend(scorer.scores(sequences).tolist())
            # No logarithm of a count plus one is zero: that marks the words that are not frequent.
            each, end = words.dictionary.to_numpy(zero_copy_only=False).tolist(), logs.get(END_WORD, 0.0)
            got = np.array([logs.get(w, 0.0) for w in each])[words.indices.to_numpy()] if each else np.zeros(0)
            n = np.bincount(at, minlength=b.num_rows) + 1
            known = np.bincount(at[got > 0], minlength=b.num_rows) + (end > 0)
            part = np.bincount(at, weights=got, minlength=b.num_rows) + end
            rest = [Counter() if end else Counter([END_WORD]) for _ in range(b.num_rows)]
            rare = np.flatnonzero(got == 0)
            for r, w in zip(at[rare].tolist(), words.indices.to_numpy()[rare].tolist(), strict=True):
                rest[r][each[w]] += 1
            cols = [np.arange(row, row + b.num_rows), n, known, part, scores, [list(r.keys()) for r in rest], [list(r.values()) for r in rest]]
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names.split())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def score_documents(docs: DataFrame, content: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(content)  # the rank file, of fixed size
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    learned = plain.filter(remainder(F.col("doc_id")) != HELD_OUT).select("text", F.xxhash64("doc_id", "text").alias("h"))

    counts = stage_table(word_counts(learned), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(totals["n"]), int(totals["v"])
    # At most FREQUENT words can have c * FREQUENT >= n.
    often = (F.col("c") * FREQUENT >= n) & (F.octet_length("word") <= 64)
    frequent = {bytes(r["word"]): r["c"] for r in counts.filter(often).toLocalIterator()}
    model = train(learned, subword_counts(counts, ranks), n, ranks)

    scored = stage_table(_scored(plain, model, frequent, ranks), "scored")
    rest = scored.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = rest.join(counts, "word").groupBy("rid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("sum"))
    total = F.col("part") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return scored.join(met, "rid", "left").select(
        "doc_id", (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), total.alias("base_score"), "score",
    )
