"""Quality rules. Each returns issues: segment_id, severity, issue_type, message, meta."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.functions import text as T
from glossaflow.operators.terms import inconsistent

COLUMNS = ["segment_id", "severity", "issue_type", "message", "meta"]


def issue(rows: DataFrame, kind: str, message: Column, segment: Column | None = None, meta: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        (none if segment is None else segment.cast("string")).alias("segment_id"), F.lit("error").alias("severity"), F.lit(kind).alias("issue_type"),
        message.alias("message"), (none if meta is None else meta).alias("meta"),
    )


def _translated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("translated", F.coalesce("translated", F.lit("")))


# The messages and types of issues, here and below.
def empty_translation(rows: DataFrame) -> DataFrame:
    rows = _translated(rows).filter(T.is_blank("translated"))
    return issue(rows, "empty_translation", F.lit("译文为空"), F.col("segment_id"))


def token_counts_json(c: Column) -> Column:
    """Tokens with their counts, in order of first sight."""
    found = T.tokens(c)
    count = lambda t: F.size(F.filter(found, lambda x: x == t))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_distinct(found), lambda t: F.concat(F.lit('"'), t, F.lit('": '), count(t).cast("string"))), ", "), F.lit("}"))


def _mismatch() -> tuple[Column, Column]:
    """Message and meta of texts whose tokens differ."""
    src, dst = token_counts_json(F.col("source_text")), token_counts_json(F.col("translated"))
    meta = F.concat(F.lit('{"source": '), src, F.lit(', "translated": '), dst, F.lit("}"))
    return F.concat(F.lit("占位符不一致：源="), src, F.lit(" 译="), dst), meta


def placeholder_mismatch(rows: DataFrame) -> DataFrame:
    rows = _translated(rows).filter(~T.is_blank("translated") & T.token_mismatch("source_text", "translated"))
    message, meta = _mismatch()
    return issue(rows, "placeholder_mismatch", message, F.col("segment_id"), meta)


def same_as_source(rows: DataFrame) -> DataFrame:
    rows = _translated(rows).withColumn("_why", T.unchanged_message("source_text", "translated"))
    return issue(rows.filter(~T.is_blank("translated") & F.col("_why").isNotNull()), "same_as_source", F.col("_why"), F.col("segment_id"))


def term_inconsistency(rows: DataFrame, terms: DataFrame) -> DataFrame:
    found = inconsistent(_translated(rows), terms)
    return issue(found, "term_inconsistency", F.concat(F.lit("强制术语未遵守: "), "source", F.lit(" -> "), "target"), F.col("segment_id"))


def segment_issues(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The four checks of segments and their translations, in one pass over them but for forced terms."""
    none = F.lit(None).cast("string")

    def found(order: int, kind: str, message: Column, meta: Column = none) -> Column:
        return F.struct(F.lit("error").alias("severity"), F.lit(kind).alias("issue_type"), message.alias("message"), meta.alias("meta"), F.lit(order).alias("check_order"))

    rows = _translated(rows)
    judged = rows.withColumns({"_blank": T.is_blank("translated"), "_differ": T.token_mismatch("source_text", "translated"), "_why": T.unchanged_message("source_text", "translated")})
    full = ~F.col("_blank")
    issues = F.array(
        F.when(F.col("_blank"), found(0, "empty_translation", F.lit("译文为空"))),
        F.when(full & F.col("_differ"), found(1, "placeholder_mismatch", *_mismatch())),
        F.when(full & F.col("_why").isNotNull(), found(2, "same_as_source", F.col("_why"))),
    )
    own = judged.select(F.col("segment_id").cast("string").alias("segment_id"), F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("i"))
    own = own.select("segment_id", "i.severity", "i.issue_type", "i.message", "i.meta", "i.check_order")
    return own.unionByName(term_inconsistency(rows, terms).select(*COLUMNS).withColumn("check_order", F.lit(3)))


def poetry_line_mismatch(tasks: DataFrame, translations: DataFrame) -> DataFrame:
    """tasks: node_task_id, poetry_line_count; translations: node_task_id, text."""
    got = T.line_count("text")
    rows = translations.join(tasks.filter("poetry_line_count IS NOT NULL"), "node_task_id").filter(got != F.col("poetry_line_count"))
    message = F.concat(F.lit("诗歌行数变化: expected="), F.col("poetry_line_count").cast("string"), F.lit(", got="), got.cast("string"))
    return issue(rows, "poetry_line_mismatch", message, meta=F.to_json(F.struct(F.col("node_task_id").cast("string").alias("node_task_id"))))


def parse_failures(files: DataFrame) -> DataFrame:
    """files: file_path, parse_error (null where it parses)."""
    rows = files.filter("parse_error IS NOT NULL")
    return issue(rows, "html_parse_fail", F.concat("file_path", F.lit(": "), "parse_error"))


def broken_links(links: DataFrame, files: DataFrame, anchors: DataFrame, book: str | None = None) -> DataFrame:
    """Links whose file is unknown, else whose fragment is.

    links: file_path, href; files: file_path; anchors: file_path, anchor. Links
    without a fragment and external ones are never checked. ``book`` is a column
    of all three, if they hold files of several: paths are those inside a book.
    """
    within = [book] if book else []
    inner = links.filter((F.col("href") != "") & ~T.is_external("href"))
    inner = inner.withColumns({"target_file": T.link_target("file_path", "href"), "fragment": T.link_fragment("href")}).filter("fragment <> ''")
    known = files.select(*within, F.col("file_path").alias("target_file")).distinct().withColumn("_known", F.lit(True))
    held = anchors.select(*within, F.col("file_path").alias("target_file"), F.col("anchor").alias("fragment")).distinct().withColumn("_held", F.lit(True))
    checked = inner.join(known, [*within, "target_file"], "left").join(held, [*within, "target_file", "fragment"], "left")
    lost = checked.filter("_held IS NULL")
    what = F.when(F.col("_known").isNull(), "href target file missing: ").otherwise("href fragment missing: ")
    return issue(lost, "link_break", F.concat(what, "href", F.lit(" from "), F.concat_ws("!", *within, "file_path")))


def toc_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after: book, hrefs (ordered array)."""
    rows = before.join(after.withColumnRenamed("hrefs", "_now"), "book", "left")
    empty = F.array().cast("array<string>")
    return issue(rows.filter(F.coalesce("hrefs", empty) != F.coalesce("_now", empty)), "toc_href_mismatch", F.lit("TOC href changed unexpectedly"))


def attribute_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after: file_path, signatures (ordered array)."""
    empty = F.array().cast("array<string>")
    rows = before.join(after.withColumnRenamed("signatures", "_now"), "file_path", "left")
    was, now = F.coalesce("signatures", empty), F.coalesce("_now", empty)
    meta = F.to_json(F.struct(F.size(was).alias("before_count"), F.size(now).alias("after_count")))
    return issue(rows.filter(was != now), "attribute_changed", F.concat(F.lit("Watched attributes changed in "), "file_path"), meta=meta)


def runtime_failure(failed: DataFrame) -> DataFrame:
    return issue(failed, "runtime_fail", F.col("message"), F.col("segment_id"))


def all_issues(*checks: DataFrame) -> DataFrame:
    """Issues of all checks, in the order of the checks; those that have an order of their own come first in it."""
    numbered = [c if "check_order" in c.columns else c.select(*COLUMNS).withColumn("check_order", F.lit(i + 4)) for i, c in enumerate(checks)]
    return reduce(DataFrame.unionByName, numbered)


def with_details(issues: DataFrame) -> DataFrame:
    """Issues with their details as a VARIANT in place of text; null where there are none."""
    return issues.withColumn("details", F.try_parse_json("meta")).drop("meta")


def type_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count("*").alias("n"))


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warn").alias("warn_count"))


def gate(issues: DataFrame, total_segments: Column | int, ratio: float = 0.005, least: int = 20) -> DataFrame:
    """One row: the counts, the bound of warnings, and whether the gate is passed."""
    return gated(severity_counts(issues), total_segments, ratio, least)


def gated(counts: DataFrame, total_segments: Column | int, ratio: float = 0.005, least: int = 20) -> DataFrame:
    """The same from a row of error_count and warn_count."""
    total = F.lit(total_segments) if isinstance(total_segments, int) else total_segments
    cap = F.greatest(F.floor(total * F.lit(ratio)), F.lit(least)).cast("long")
    return counts.withColumn("warn_cap", cap).withColumn("passed", (F.col("error_count") == 0) & (F.col("warn_count") <= F.col("warn_cap")))


def report(issues: DataFrame, total_segments: int) -> DataFrame:
    """JSON lines (part, line): the counts, then each issue.

    The translated count is the number of segments. Lines instead of one
    document let any number of issues be written side by side.
    """
    counts = severity_counts(issues).select(F.struct(F.lit(total_segments).alias("total_segments"), F.lit(total_segments).alias("translated_segments"), "error_count", "warn_count").alias("row"))
    head = counts.select(F.lit(0).alias("part"), F.to_json("row").alias("line"))
    rows = issues.select(F.lit(1).alias("part"), F.to_json(F.struct("segment_id", "severity", F.col("issue_type").alias("type"), "message", "meta"), {"ignoreNullFields": "false"}).alias("line"))
    return head.unionByName(rows)


def summary(issues: DataFrame, total_segments: int) -> str:
    """Markdown; the few issue types come to the driver, most frequent first."""
    c = severity_counts(issues).first()
    first = issues.groupBy("issue_type").agg(F.count("*").alias("n"), F.min("check_order").alias("o")).orderBy(F.desc("n"), "o", "issue_type").collect()
    lines = ["# QA Summary", "", f"- total_segments: {total_segments}", f"- error_count: {c['error_count']}", f"- warn_count: {c['warn_count']}", "", "## Top Issue Types"]
    return "\n".join([*lines, *[f"- {r['issue_type']}: {r['n']}" for r in first]])
