"""Translation memory and the tables of a run: keyed look-ups, upserts, logs.

Parquet tables can't be merged in place or overwritten while they are read, so
a keyed table is a folder of parts, and each part is written once: an upsert
adds its rows alone, and a reader takes the newest row of each key over the
parts that were complete when it began. Writers don't meet, since a part has a
name of its own.

Parts have levels. More than ``PARTS`` of one level are merged into one of the
next, so a row is written once for each level, of which there are as many as the
logarithm of the table. What a merge replaces stays until the next one, for
readers that still hold it.

The files of a part lie in buckets by the upper bits of the key's hash, more at
higher levels, are sorted by the hash and carry Parquet's statistics and Bloom
filters of it. So a look-up of a batch's keys opens the buckets, row groups and
pages that can hold them, and what it reads follows the batch, not the table.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.functions import text as T
from glossaflow.operators.result_log import ResultLog
from glossaflow.sources import store

KEY = ["segment_id", "source_hash", "config_hash"]
SCHEMA = "segment_id string, source_hash string, config_hash string, draft_text string, revise_text string, provider string, updated_at timestamp"
SEGMENT_SCHEMA = "segment_id string, file_path string, node_selector string, order_index int, source_hash string, updated_at timestamp"
RUN_SCHEMA = "run_id string, started_at timestamp, input_epub string, output_epub string, provider string, config_hash string"
ERROR_SCHEMA = "id string, run_id string, segment_id string, stage string, message string, created_at timestamp"
PARTS = 8  # of a level
BITS = 12  # of the hash deal rows to tasks and to the buckets of the highest levels; each level below has 3 fewer
LITERALS = 2_000  # so many keys of a look-up are written into the plan
IN_FILTER = "spark.sql.parquet.pushdown.inFilterThreshold"
PLACE = 20  # digits
HELD = "_HELD"  # marks a part whose rows a later part holds too


def latest(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The last row of each key; aggregated before the shuffle, so a hot key is cheap."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str] = KEY, newest: str = "updated_at") -> DataFrame:
    """Rows replace table rows of their key; among themselves the newest wins."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return latest(both, keys, ["_new", newest]).drop("_new")


def probe(segments: DataFrame, memory: DataFrame, prefer_revise: bool = True) -> DataFrame:
    """Segments with their cached text, if any, and what to do with each: state.

    A hit that is unchanged text is suspicious and goes again, like a miss.
    """
    cached = F.when(F.col("draft_text") != "", F.col("draft_text"))
    if prefer_revise:
        cached = F.when(F.col("revise_text") != "", F.col("revise_text")).otherwise(cached)
    out = segments.join(memory.select(*KEY, "draft_text", "revise_text"), KEY, "left").withColumn("cached", cached)
    state = F.when(F.col("cached").isNull(), "pending").when(T.needs_retry("source_text", "cached"), "suspicious").otherwise("cached")
    return out.withColumn("state", state).drop("draft_text", "revise_text")


def _bits(level: int) -> int:
    return min(3 * (level + 1), BITS)


class KeyedTable:
    """A table at ``path`` with one row for each key, of parts that are written once."""

    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMA, keys: list[str] = KEY, newest: str = "updated_at"):
        self.spark, self.path, self.schema, self.keys, self.newest = spark, path.rstrip("/"), schema, keys, newest

    def _at(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def parts(self) -> list[str]:
        """Complete parts that no other part holds, oldest first."""
        fs, root = self._at()
        if not fs.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(root))
        return [n for n in names if fs.exists(self._at(f"{n}/_SUCCESS")[1]) and not fs.exists(self._at(f"{n}/{HELD}")[1])]

    @staticmethod
    def level(part: str) -> int:
        return int(part.split("-")[1])

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _stored(self, parts: list[str], only: Callable[[DataFrame, int], DataFrame] = lambda rows, level: rows) -> DataFrame:
        """The newest row of each key over parts, of the rows that ``only`` leaves of each level."""
        if not parts:
            return self._empty()
        out = None
        for level in sorted({self.level(n) for n in parts}):
            files = [f"{self.path}/{n}" for n in parts if self.level(n) == level]
            found = self.spark.read.schema(f"{self.schema}, key_hash bigint, part string, bucket int").option("basePath", self.path).parquet(*files)
            rows = only(found, level).withColumn("_part", F.left("part", F.lit(PLACE))).drop("key_hash", "bucket", "part")
            out = rows if out is None else out.unionByName(rows)
        return (latest(out, self.keys, ["_part", self.newest]) if len(parts) > 1 else out).drop("_part").select(*self._empty().columns)

    def read(self) -> DataFrame:
        return self._stored(self.parts())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys that ``keys`` has (and of none that shares no hash with them)."""
        hashes = keys.select(F.xxhash64(*self.keys).alias("key_hash")).distinct()
        few = [r["key_hash"] for r in hashes.limit(LITERALS + 1).collect()]
        if len(few) > LITERALS:
            # Many keys are most of the table's blocks: rows of others go before they are shuffled for the newest.
            return self._stored(self.parts(), lambda rows, level: rows.join(hashes, "key_hash", "left_semi"))
        if not few:
            return self._empty()
        if int(self.spark.conf.get(IN_FILTER)) < LITERALS:  # else Parquet sees the least and the greatest hash alone
            self.spark.conf.set(IN_FILTER, str(LITERALS))

        def only(rows: DataFrame, level: int) -> DataFrame:
            buckets = sorted({(h & (1 << 64) - 1) >> 64 - _bits(level) for h in few})
            return rows.filter(F.col("bucket").isin(buckets) & F.col("key_hash").isin(few))

        return self._stored(self.parts(), only)

    def _write(self, rows: DataFrame, place: str, level: int) -> None:
        """A part of rows of distinct keys; ``place`` is its time among the parts."""
        top = lambda bits: F.shiftrightunsigned("key_hash", 64 - bits).cast("int")
        rows = rows.withColumn("key_hash", F.xxhash64(*self.keys)).withColumn("bucket", top(_bits(level)))
        # The first level has few buckets, which the tasks share; of the others each bucket is one task's, and one file.
        rows = rows.repartition("bucket" if level else top(BITS)).sortWithinPartitions("bucket", "key_hash")
        writer = rows.write.option("parquet.bloom.filter.enabled#key_hash", "true").partitionBy("bucket")
        writer.parquet(f"{self.path}/part={place}-{level:02d}-{uuid.uuid4().hex[:8]}")

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace older rows of their key; among themselves the newest wins."""
        self._write(latest(rows.select(*self._empty().columns), self.keys, [self.newest]), f"{time.time_ns():0{PLACE}d}", 0)
        level = 0
        while len(full := [n for n in self.parts() if self.level(n) == level]) > PARTS:
            self._merge(full, level + 1)
            level += 1

    def compact(self) -> None:
        """One part of all there are."""
        parts = self.parts()
        if len(parts) > 1:
            self._merge(parts, 1 + max(map(self.level, parts)))

    def _merge(self, parts: list[str], level: int) -> None:
        """One part of those, which stands where the last of them stood; what the last merge had replaced goes."""
        fs, root = self._at()
        gone = [s.getPath() for s in fs.listStatus(root) if fs.exists(self._at(f"{s.getPath().getName()}/{HELD}")[1])]
        self._write(self._stored(parts), parts[-1].removeprefix("part=")[:PLACE], level)
        for n in parts:
            fs.create(self._at(f"{n}/{HELD}")[1]).close()
        for path in gone:
            fs.delete(path, True)


def append(df: DataFrame, path: str) -> None:
    """Run records and errors are only ever added."""
    df.write.mode("append").parquet(path)


def segment_rows(segments: DataFrame) -> DataFrame:
    """What is kept of each segment: where it stands, and the hash of its source."""
    return segments.select("segment_id", "file_path", "node_selector", F.col("order_index").cast("int").alias("order_index"), "source_hash", F.current_timestamp().alias("updated_at"))


def run_record(spark: SparkSession, run_id: str, source: str, target: str, provider: str, config_hash: str) -> DataFrame:
    row = [(run_id, source, target, provider, config_hash)]
    return spark.createDataFrame(row, "run_id string, input_epub string, output_epub string, provider string, config_hash string").withColumn("started_at", F.current_timestamp())


def error_rows(failed: DataFrame, run_id: str, stage: str) -> DataFrame:
    """(segment_id, message) as error records with ids of their own."""
    return failed.select(F.expr("uuid()").alias("id"), F.lit(run_id).alias("run_id"), "segment_id", F.lit(stage).alias("stage"), "message", F.current_timestamp().alias("created_at"))


class Workspace:
    """The tables of runs side by side in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.translations = KeyedTable(spark, f"{self.path}/translations")
        self.segments = KeyedTable(spark, f"{self.path}/segments", SEGMENT_SCHEMA, ["segment_id"])

    def log(self, run_id: str) -> ResultLog | None:
        """Where a run's answered batches go; none in a store that tasks can't write to by themselves, where waves alone are kept."""
        path = f"{self.path}/log/{run_id}"
        return ResultLog(path) if store.known(path) else None

    def recover(self, run_id: str = "*") -> int:
        """Takes what logs of a run, or of all, hold into the memory; the number of batches."""
        log = self.log(run_id)
        found = log.files() if log else []
        if found:
            self.translations.upsert(self.spark.read.schema(SCHEMA).parquet(*found))
            ResultLog.drop(found)
        return len(found)

    def begin(self, run_id: str, source: str, target: str, provider: str, config_hash: str) -> None:
        append(run_record(self.spark, run_id, source, target, provider, config_hash), f"{self.path}/runs")

    def fail(self, failed: DataFrame, run_id: str, stage: str) -> None:
        append(error_rows(failed, run_id, stage), f"{self.path}/errors")
