"""Resumed translation as a stream.

Each micro-batch looks its keys up in the translation memory, which reads what
can hold them, translates what is missing, and upserts the results. The checkpoint says what was seen, the keyed upsert makes
a repeated micro-batch harmless, so a restart goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossaflow.functions import text as T
from glossaflow.operators.memory import KEY, KeyedTable, probe
from glossaflow.operators.segments import greedy_batches
from glossaflow.operators.translate import translate
from glossaflow.plans.scratch import stage_table, staged_here


def translate_missing(segments: DataFrame, memory: DataFrame | KeyedTable, config_hash: str, provider="mock", max_chars: int = 8000, max_rows: int = 20) -> DataFrame:
    """Memory rows for segments (book, order_index, segment_id, source_text) that it lacks."""
    keyed = segments.withColumns({"source_hash": T.text_hash("source_text"), "config_hash": F.lit(config_hash)})
    if isinstance(memory, KeyedTable):
        keyed = stage_table(keyed, "keyed")
        memory = memory.lookup(keyed.select(*KEY))
    todo = probe(keyed, memory).filter("state <> 'cached'").withColumn("chars", F.length("source_text"))
    batched = greedy_batches(todo.select("book", "order_index", "segment_id", "source_text", "chars"), "book", "order_index", "chars", max_chars, max_rows)
    batched = batched.withColumns({"batch_key": F.concat_ws("/", "book", F.col("batch_no").cast("string")), "hits": F.lit("[]")})
    done = translate(batched, provider).filter("error IS NULL")
    keys = keyed.select("segment_id", "source_hash", "config_hash")
    return done.join(keys, "segment_id").withColumn("updated_at", F.current_timestamp()).select(*KEY, "draft_text", "revise_text", "provider", "updated_at")


def resume(segments: DataFrame, table: KeyedTable, config_hash: str, checkpoint: str, provider="mock", after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Starts a query that handles what is there in micro-batches, then stops."""

    def each(batch: DataFrame, epoch: int) -> None:
        with staged_here():  # a stream may run for long; each micro-batch leaves nothing
            table.upsert(translate_missing(batch, table, config_hash, provider))
        if after:
            after(epoch)

    return segments.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
