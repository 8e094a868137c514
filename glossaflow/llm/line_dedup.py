"""Removal of lines that many documents share, with built-in functions only.

Lines are normalised and hashed to 128 bits, each document counts once per
hash, and hashes found in ``min_docs`` documents or more lose their lines in
every document. The hashes are written once, with 128 bits a row and line, and
serve the count and the drop. What is left is joined again in the order of position.

Defined cases: a null or empty text is one empty line; keys of fewer than
``min_chars`` code points are never dropped; a text whose lines all go becomes
empty; each row counts as a document, so repeated rows count as often as they
occur; rows with a null id are kept and treated like others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.columns import apart
from glossaflow.plans.scratch import stage_table

NEW = ("n_lines", "n_dropped", "kept_text")
SPACES = " \t\n\x0b\f\r"


def bare_line(line: Column) -> Column:
    """Stripped at both ends; the strip itself runs only where an end has a space."""
    ends = [end for s in SPACES for end in (line.startswith(s), line.endswith(s))]
    return F.when(reduce(Column.__or__, ends), F.btrim(line, F.lit(SPACES))).otherwise(line)


def folded(line: Column) -> Column:
    """A form that two lines share if and only if they differ in the case of A-Z alone.

    Other lines than ASCII are lower-cased byte for byte, as Latin-1. That maps
    some lead bytes of UTF-8 to others, but the number of bytes that follow
    still tells which one it was, so no two characters become one.
    """
    ascii_only = F.octet_length(line) == F.length(line)
    return F.lower(F.when(ascii_only, line).otherwise(F.decode(line.cast("binary"), "ISO-8859-1")))


def line_hashes(lines: Column, min_chars: int) -> Column:
    """128-bit hashes of the keys of lines, null for keys that are too short."""
    keys = F.transform(F.transform(lines, bare_line), lambda x: F.when(F.length(x) >= min_chars, folded(x)))
    return F.transform(keys, lambda k: F.when(k.isNotNull(), F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(7), k).alias("b"))))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` plus n_lines, n_dropped and kept_text, which replace columns so named in any case."""
    body = F.coalesce(F.col(text), F.lit(""))
    r1, r2, drop = apart(docs, "r1", "r2", "drop")
    row = [F.xxhash64(F.lit(1), F.col(doc_id), body).alias(r1), F.xxhash64(F.lit(2), body, F.col(doc_id)).alias(r2)]
    hashed = stage_table(docs.select(*row, line_hashes(F.split(body, "\n"), min_chars).alias("hashes")), "line-hashes")

    seen = hashed.select(F.explode(F.array_distinct("hashes")).alias("h")).filter("h is not null")
    common = stage_table(seen.groupBy("h.a", "h.b").count().filter(F.col("count") >= min_docs).select("a", "b"), "common-lines")

    lines = hashed.select(r1, r2, F.posexplode("hashes").alias("pos", "h")).filter("h is not null").select(r1, r2, "pos", "h.a", "h.b")
    drops = lines.join(common, ["a", "b"]).groupBy(r1, r2).agg(F.collect_set("pos").alias(drop))

    out = docs.select("*", *row).join(drops, [r1, r2], "left")
    parts = F.split(body, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop))
    return out.select(
        *[out[c] for c in docs.columns if c.lower() not in NEW],
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col(drop).isNull(), body).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")).alias("kept_text"),
    )
