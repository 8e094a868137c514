"""Segments: numbering, chunks, previous context, greedy batches and merging."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from glossaflow.functions.masking import chunks_column
from glossaflow.functions.text import TOKEN, seq_id
from glossaflow.plans.scratch import stage_table


def numbered(df: DataFrame, book: list[str], order: list[Column | str], prefix: str, width: int, name: str = "id") -> DataFrame:
    """Dense ids per book in the given order; a book, like an archive, is bounded, and is one task's."""
    n = F.row_number().over(Window.partitionBy(*book).orderBy(*order))
    return df.withColumn("_n", n).withColumn(name, seq_id(prefix, "_n", width)).drop("_n")


def numbered_in_stretches(df: DataFrame, book: list[str], order: list[str], prefix: str, width: int, name: str = "id") -> DataFrame:
    """The ids of ``numbered`` for books of any size, such as a few that hold all rows.

    Rows are dealt in order to even stretches and take their places from there;
    what a stretch must know is how many rows of a book came before it, a
    number for each book in each stretch.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *book, *order).sortWithinPartitions(*book, *order)
    placed = stage_table(dealt.withColumn("_pos", F.monotonically_increasing_id()), "numbered-rows")
    placed = placed.withColumn("_stretch", F.shiftright("_pos", 33))
    counts = placed.groupBy("_stretch", *book).agg(F.min("_pos").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*book).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = stage_table(counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_rows"), "stretch-counts")
    same = reduce(Column.__and__, [placed[c].eqNullSafe(counts[c]) for c in ["_stretch", *book]])
    number = F.col("_pos") - F.col("_first") + F.col("_before") + 1
    return placed.join(counts, same).select(*[placed[c] for c in df.columns], seq_id(prefix, number, width).alias(name))


def task_union(nodes: DataFrame, toc: DataFrame, book: list[str]) -> DataFrame:
    """Node tasks and table-of-contents tasks in order of their index, per book."""
    both = nodes.withColumn("branch", F.lit(0)).unionByName(toc.withColumn("branch", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*book).orderBy("branch", "order_index"))
    return both.withColumn("order_index", n).drop("branch")


def build_segments(tasks: DataFrame, book: list[str], max_chars: int = 1200, previous_chars: int = 300) -> DataFrame:
    """A row per chunk of each task, with the tail of the chunk before it as context.

    A text of N code points gives its chunks in one pass; ids and context need
    the order within a book only, so books are the unit of partitioning.
    ``previous_chars`` of 0 gives the whole previous chunk.
    """
    cut = tasks.select("*", F.posexplode(chunks_column(F.col("source_text"), max_chars)).alias("chunk_index", "chunk"))
    order = Window.partitionBy(*book).orderBy("order_index", "chunk_index")
    before = F.lag("chunk").over(order)
    tail = F.right(before, F.lit(previous_chars)) if previous_chars else before
    return (
        cut.withColumn("segment_id", seq_id("S", F.row_number().over(order), 9))
        .withColumn("context_prev_source", F.coalesce(tail, F.lit("")))
        .withColumn("context_prev_translated", F.lit(""))
        .withColumn("placeholders", F.regexp_extract_all("chunk", F.lit(TOKEN), F.lit(0)))
        .withColumn("source_text", F.col("chunk"))
        .drop("chunk")
    )


def previous_context(df: DataFrame, book: list[str], order: list[str], text: str, n: int) -> DataFrame:
    before = F.lag(text).over(Window.partitionBy(*book).orderBy(*order))
    return df.withColumn("context_prev_source", F.coalesce(F.right(before, F.lit(n)) if n else before, F.lit("")))


class _Fill:
    """The open batch of a book: its number, rows and characters."""

    def __init__(self, max_chars: int, max_rows: int, number: int = 0, rows: int = 0, size: int = 0):
        self.max_chars, self.max_rows = max_chars, max_rows
        self.number, self.rows, self.size = number, rows, size

    def add(self, n: int) -> int:
        if self.rows and (self.rows >= self.max_rows or self.size + n > self.max_chars):
            self.number, self.rows, self.size = self.number + 1, 0, 0
        self.rows, self.size = self.rows + 1, self.size + n
        return self.number


def greedy_batches(df: DataFrame, book: str, order: str, chars: str, max_chars: int = 8000, max_rows: int = 20) -> DataFrame:
    """Adds batch_no: rows fill a batch until it would pass a limit; long rows stand alone.

    Where a batch begins depends on all before it in its book, yet what a
    stretch of rows must know of them is only how many of the last ``max_rows``
    rows are in the open batch. Rows are dealt in order to even stretches, which
    may split a book of any length. Each stretch works out where it ends for
    every such number; these short tables are chained on the driver, a few
    numbers a stretch, and each stretch is numbered from its true start.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, book, order).sortWithinPartitions(book, order)
    placed = stage_table(dealt.withColumn("_pos", F.monotonically_increasing_id()), "batch-rows")

    def stretches(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(n, F.shiftright("_pos", 33).cast("int")).sortWithinPartitions("_pos")

    narrow = placed.select("_pos", F.col(book).cast("string").alias("_book"), F.coalesce(F.col(chars).cast("long"), F.lit(0)).alias("_n"))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First and last book of a stretch, and the last rows of the last one."""
        first, now, tail, whole, part = None, None, [], True, None
        for b in batches:
            for pos, k, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part is None:
                    part, first, now = pos >> 33, k, k
                elif k != now:
                    now, tail, whole = k, [], False
                tail = [*tail[1 - max_rows :], size] if max_rows > 1 else [size]
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": now, "tail": tail, "whole": whole}], pa.schema([("part", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("tail", pa.list_(pa.int64())), ("whole", pa.bool_())]))

    ends = sorted(stretches(narrow).mapInArrow(tails, "part long, first string, last string, tail array<long>, whole boolean").collect(), key=lambda r: r["part"])
    before: dict[int, list[int]] = {}  # the rows before a stretch that goes on with their book
    held: tuple[str | None, list[int]] | None = None
    for r in ends:
        if held is not None and r["first"] == held[0]:
            before[r["part"]] = held[1]
        tail = [*(held[1] if held is not None and r["whole"] and r["first"] == held[0] else []), *r["tail"]]
        held = (r["last"], tail[-max_rows:])

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each number of open rows at the start (0: a new book): what is open at the end."""
        fills: dict[int, _Fill] | None = None
        now, fresh, part = None, False, None
        for b in batches:
            for pos, k, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if fills is None:
                    part, now = pos >> 33, k
                    prior = before.get(part, [])
                    fills = {m: _Fill(max_chars, max_rows, 0, m, sum(prior[len(prior) - m :])) for m in (range(1, len(prior) + 1) if prior else [0])}
                elif k != now:
                    now, fresh, fills = k, True, {0: _Fill(max_chars, max_rows)}
                for fill in {id(f): f for f in fills.values()}.values():
                    fill.add(size)
                if len(fills) > 1:  # fills that agree from here on become one
                    same: dict[tuple[int, int, int], _Fill] = {}
                    fills = {m: same.setdefault((f.number, f.rows, f.size), f) for m, f in fills.items()}
        rows = [{"part": part, "open": m, "fresh": fresh, "number": f.number, "rows": f.rows, "size": f.size} for m, f in (fills or {}).items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int64()), ("open", pa.int32()), ("fresh", pa.bool_()), ("number", pa.int32()), ("rows", pa.int32()), ("size", pa.int64())]))

    chained = {(r["part"], r["open"]): r for r in stretches(narrow).mapInArrow(exits, "part long, open int, fresh boolean, number int, rows int, size long").collect()}
    starts: dict[int, tuple[int, int, int]] = {}  # number, rows and size of the batch open at the start
    state = (0, 0, 0)
    for r in ends:
        part = r["part"]
        starts[part] = state if part in before else (0, 0, 0)
        end = chained[(part, 0)] if not starts[part][1] or (part, 0) in chained else chained[(part, starts[part][1])]
        base = 0 if end["fresh"] else starts[part][0]
        state = (base + end["number"], end["rows"], end["size"])

    schema = StructType([*df.schema.fields, StructField("batch_no", IntegerType())])
    names, at = df.columns, [df.columns.index(c) for c in (book, chars)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fill, seen = None, None, False
        for b in batches:
            out = []
            for pos, k, size in zip(b.column(len(names)).to_pylist(), b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist(), strict=True):
                if not seen:
                    seen, now, fill = True, k, _Fill(max_chars, max_rows, *starts[pos >> 33])
                elif k != now:
                    now, fill = k, _Fill(max_chars, max_rows)
                out.append(fill.add(int(size or 0)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, pa.int32())], names=schema.names)

    return stretches(placed.select(*names, "_pos")).mapInArrow(fold, schema)


def merge_chunks(segments: DataFrame, texts: DataFrame, node: list[str], segment: list[str]) -> DataFrame:
    """Chunk texts joined again per node in order; a missing text is empty."""
    parts = segments.join(texts, segment, "left").groupBy(*node)
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"))
    return parts.select(*node, F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def with_texts(tasks: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that have a translation, each once, however many rows of texts it has."""
    return tasks.join(texts.select(*keys), keys, "left_semi")
