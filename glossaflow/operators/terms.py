"""Termbase: normalisation, hits in texts, consistency, mining and filling.

Texts are matched with terms by an inverted index of one entry a term: its
anchor, the run of ``GRAM`` code points in it that is rarest in a few texts. A
text is scanned once, whatever the number of terms; what it holds around anchors
meets the terms in an equality join, where the term itself is verified.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.functions import text as T
from glossaflow.functions.masking import phrases_column
from glossaflow.plans.scratch import bounded_batches, stage_table

TERM = "source string, target string, force boolean, note string"
GRAM = 4
ANCHORS = 4_000_000  # of a pass over the texts; 16 bytes each are sent to every worker
TRIED = 512  # texts that say how rare a gram is


def accepted(terms: DataFrame) -> DataFrame:
    """Stripped terms with formatted targets; those without a CJK left part go.

    The longest source comes first in ``rank`` order, ties as they came.
    """
    source = T.strip("source")
    target = T.format_term(F.col("source"), F.coalesce("target", F.lit("")))
    out = terms.withColumns({"target": target, "source": source})
    return out.filter((F.col("source") != "") & (F.col("target") != "") & T.has_cjk_left("source", "target"))


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k code points, by their place."""
    n = max(0, len(codes) - k + 1)
    h = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n].astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _own_grams(texts: pd.Series) -> pd.Series:
    """The grams of terms; a term that is shorter has itself."""
    return pd.Series([[{"gram": int(g), "at": i} for i, g in enumerate(grams(c, min(GRAM, len(c))))] for c in map(_codes, texts)], dtype=object)


def _distinct_grams(texts: pd.Series) -> pd.Series:
    return pd.Series([np.unique(np.concatenate([grams(c, k) for k in range(1, GRAM + 1)])) for c in map(_codes, texts)], dtype=object)


def anchors(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, gram, at): each lower-cased source once, with its rarest gram and its place; staged.

    ``texts`` (one column) has a bounded number of rows; which they are changes the cost of a search alone.
    """
    words = terms.select(F.lower("source").alias("word")).filter("word <> ''").distinct()
    held = words.select("word", F.explode(F.pandas_udf(_own_grams, "array<struct<gram:bigint,at:int>>")("word")).alias("g")).select("word", "g.gram", "g.at")
    (text,) = texts.columns
    seen = texts.filter(F.col(text).isNotNull()).select(F.explode(F.pandas_udf(_distinct_grams, "array<bigint>")(F.lower(text))).alias("gram")).groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "at", "gram")).alias("a")
    return stage_table(held.join(seen, "gram", "left").groupBy("word").agg(rarest).select("word", "a.gram", "a.at"), "anchors")


def _near(text: Column, table: pd.DataFrame) -> Column:
    """array<struct<gram, near>>: the anchors that a text has, with what stands around them, as far as terms reach.

    table: gram, sorted; k; before and after, the reach of its terms.
    """
    @F.pandas_udf("array<struct<gram:bigint,near:array<struct<text:string,at:int>>>>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, before, after = (shared.value[c].to_numpy() for c in ("gram", "before", "after"))
        sizes = sorted(set(shared.value["k"]))
        for s in texts:
            out = []
            for t in s:
                found: dict[int, set[tuple[str, int]]] = {}
                codes = _codes(t) if t and len(known) else None
                for k in sizes if codes is not None else ():
                    h = grams(codes, k)
                    spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    for i in np.flatnonzero(known[spot] == h).tolist():
                        first = max(0, i - before[spot[i]])
                        found.setdefault(int(h[i]), set()).add((t[first : i + after[spot[i]]], int(i - first)))
                out.append([{"gram": g, "near": [{"text": w, "at": a} for w, a in sorted(near)]} for g, near in found.items()])
            yield pd.Series(out, dtype=object)

    shared = SparkSession.active().sparkContext.broadcast(table)
    return find(F.lower(text))


def term_hits(rows: DataFrame, terms: DataFrame, text: str = "source_text") -> DataFrame:
    """Rows joined with each term whose source their text contains, in any case."""
    bounded_batches(rows.sparkSession, 128, 1 << 20)  # a text has many grams
    index = anchors(terms, rows.select(text).limit(TRIED))
    reach = F.max(F.char_length("word") - F.col("at"))
    table = index.groupBy("gram").agg(F.max("at").alias("before"), reach.alias("after"), F.max(F.least(F.char_length("word"), F.lit(GRAM))).alias("k"))
    passes = max(1, -(-table.count() // ANCHORS))
    spots = F.lit(None)
    for n in range(passes):
        part = table.filter(F.pmod(F.xxhash64("gram"), F.lit(passes)) == n).orderBy("gram").toPandas()
        spots = _near(F.col(text), part) if n == 0 else F.concat(spots, _near(F.col(text), part))
    met = rows.withColumn("_spot", F.explode(spots)).withColumn("_gram", F.col("_spot.gram")).join(index.select(F.col("gram").alias("_gram"), F.col("word").alias("_word"), F.col("at").alias("_at")), "_gram")
    stands = F.exists("_spot.near", lambda w: (w["at"] >= F.col("_at")) & (F.substr(w["text"], w["at"] - F.col("_at") + 1, F.char_length("_word")) == F.col("_word")))
    return met.filter(stands).drop("_spot", "_gram", "_at").join(terms.withColumn("_word", F.lower("source")), "_word").drop("_word")


def batch_hits(hits: DataFrame, batch: list[str]) -> DataFrame:
    """One row per batch and source->target pair: its last force and note, at its first place."""
    return hits.groupBy(*batch, "source", "target").agg(
        F.min(F.struct("order_index", "term_rank")).alias("first_seen"),
        F.max_by(F.struct("force", "note"), F.struct("order_index", "term_rank")).alias("last"),
    ).select(*batch, "source", "target", "last.force", "last.note", "first_seen")


def inconsistent(rows: DataFrame, terms: DataFrame, text: str = "source_text", translated: str = "translated") -> DataFrame:
    """Rows whose text has a forced term whose target their translation lacks."""
    hits = term_hits(rows, terms.filter("force"), text)
    return hits.filter(~F.contains(F.coalesce(F.col(translated), F.lit("")), F.col("target")))


def candidates(texts: DataFrame, text: str = "text", single: bool = False) -> DataFrame:
    """(phrase, freq) over all texts of two code points or more."""
    body = T.strip(text)
    nodes = texts.filter(F.length(body) >= 2)
    return nodes.select(F.explode(phrases_column(body, single)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("freq"))


def top_candidates(found: DataFrame, min_freq: int = 2, max_terms: int = 300) -> DataFrame:
    """The most frequent phrases, longer ones first among equals, then by code points."""
    often = found.filter(F.col("freq") >= max(1, min_freq))
    return often.orderBy(F.desc("freq"), F.desc(F.length("phrase")), "phrase").limit(max(1, max_terms))


def new_terms(selected: DataFrame, existing: DataFrame) -> DataFrame:
    """Selected phrases that no existing term has as its source, as empty terms."""
    fresh = selected.join(existing.select(F.col("source").alias("phrase")), "phrase", "left_anti")
    note = F.concat(F.lit("auto-generated; freq="), F.col("freq").cast("string"))
    return fresh.select(F.col("phrase").alias("source"), F.lit("").alias("target"), F.lit(False).alias("force"), note.alias("note"))


def termbase_union(existing: DataFrame, generated: DataFrame) -> DataFrame:
    return existing.withColumn("branch", F.lit(0)).unionByName(generated.withColumn("branch", F.lit(1)))


def to_fill(terms: DataFrame) -> DataFrame:
    return terms.filter(~T.is_blank("source") & T.is_blank(F.coalesce("target", F.lit(""))))


def fill_targets(terms: DataFrame, replies: DataFrame) -> DataFrame:
    """Terms with the targets of replies (source, reply), and what became of each: outcome."""
    joined = terms.join(replies, "source", "left")
    empty = ~T.is_blank("source") & T.is_blank(F.coalesce("target", F.lit("")))
    answered = empty & ~T.is_blank(F.coalesce("reply", F.lit("")))
    formatted = T.format_term("source", F.coalesce("reply", F.lit("")))
    good = T.has_cjk_left("source", formatted)
    outcome = F.when(answered & good, "filled").when(answered, "rejected").otherwise("kept")
    target = F.when(answered & good, formatted).when(answered, "").otherwise(F.coalesce("target", F.lit("")))
    return joined.withColumns({"target": target, "outcome": outcome}).drop("reply")


def normalise_targets(terms: DataFrame) -> DataFrame:
    """Formatted targets; those without a CJK left part become empty and count as cleared."""
    has = ~T.is_blank("source") & ~T.is_blank(F.coalesce("target", F.lit("")))
    formatted = T.format_term("source", F.coalesce("target", F.lit("")))
    good = T.has_cjk_left("source", formatted)
    target = F.when(has & good, formatted).when(has, "").otherwise(F.coalesce("target", F.lit("")))
    return terms.withColumns({"target": target, "cleared": has & ~good})


def term_segments(terms: DataFrame, order: str) -> DataFrame:
    """Terms as segments to translate, numbered in order; a termbase is one small book."""
    from glossaflow.operators.segments import numbered

    rows = numbered(terms.withColumn("file_path", F.lit("termbase")), ["file_path"], [order], "TERM_", 6, "segment_id")
    source = T.strip("source")
    return rows.select("source", "segment_id", F.col("segment_id").alias("node_task_id"), F.lit(0).alias("chunk_index"), F.lit("paragraph").alias("segment_type"), "file_path", source.alias("node_selector"), source.alias("source_text"))


def fingerprint(terms: list[dict], version: str) -> str:
    """Compact JSON of the terms in a fixed order; part of every cache key."""
    keys = ("source", "target", "force", "note")
    rows = sorted(({k: t[k] for k in keys} for t in terms), key=lambda t: [t[k] for k in keys])
    return json.dumps({"version_id": version, "terms": rows}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def read_terms(payload: dict) -> list[dict]:
    """Terms of a loaded file that have a source and a target, with defaults filled in."""
    return [
        {"source": str(t["source"]), "target": str(t["target"]), "force": bool(t.get("force", False)), "note": str(t.get("note", ""))}
        for t in payload.get("terms", [])
        if t.get("source") and t.get("target")
    ]
