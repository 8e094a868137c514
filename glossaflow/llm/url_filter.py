"""URL filter rules by expression expansion and hash-prefix joins.

A url is cut into host and path. Each url is expanded into every host suffix
and every path prefix that some rule could equal; the digests of these
expressions meet the digests of the rules on their first four bytes, the full
digests confirm, and the longest confirmed rule decides.

Defined cases: a null url or one without ``://`` has an empty host and path and
fits no rule; two rules with the same host and path count once, ``block`` over
``allow``; repeated pages keep one row each; other columns pass through, but for those
named host, path, rule or verdict, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.columns import apart
from glossaflow.plans.scratch import stage_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8
RULE_SCHEMA = "rule_host string, rule_path string, rule_verdict string"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to each row of ``pages``.

    Only urls that differ in host or in the part of the path that rules can see
    are expanded, so a hot host costs one expansion per distinct short path.
    """
    rules = rules.select(F.coalesce("rule_host", F.lit("")).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "rule_verdict")
    shape = rules.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")
    ).first()
    host, path = url_parts(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    if not shape["labels"]:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels, lengths = shape["labels"], shape["lengths"]

    short, rule, verdict = apart(out, "cut", "rule", "verdict")
    cut = out.withColumn(short, F.left("path", F.lit(max(lengths))))
    urls = cut.filter("host <> ''").select("host", F.col(short).alias("_cut")).distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("_cut") >= n, F.left("_cut", F.lit(n))) for n in lengths]), lambda p: p.isNotNull())
    tried = urls.withColumn("_suffix", F.explode(suffixes)).withColumn("_prefix", F.explode(prefixes))
    tried = tried.withColumn("_digest", F.sha2(F.concat("_suffix", "_prefix"), 256)).withColumn("_key", F.left("_digest", F.lit(PREFIX_HEX)))

    known = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    known = known.select(
        F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict", F.length("rule_host").alias("_host_len"),
        F.sha2(F.concat("rule_host", "rule_path"), 256).alias("_rule_digest"),
    ).withColumn("_key", F.left("_rule_digest", F.lit(PREFIX_HEX)))
    best = (
        tried.join(known, "_key").filter("_digest = _rule_digest")
        .groupBy("host", "_cut")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "_host_len", "rule", "rule_verdict")).alias("_best"))
    )
    # Staged, the verdicts have a known size: small ones are sent out, and for
    # large ones a hot host's pages can be split in the join.
    best = stage_table(best.select("host", F.col("_cut").alias(short), F.col("_best.rule").alias(rule), F.col("_best.rule_verdict").alias(verdict)), "url-verdicts")
    return cut.join(best, ["host", short], "left").select(
        *[c for c in out.columns if c.lower() not in ("rule", "verdict")], F.col(rule).alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict")
    )
