"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossaflow.llm.url_filter import RULE_SCHEMA, apply_rules

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = apply_rules(pages, spark.createDataFrame(URL_RULES, RULE_SCHEMA))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossaflow.llm.winnow import compare_with_next

    return compare_with_next(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers

    from glossaflow.llm.bpe import encode_digests

    with open(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        content = f.read()
    return encode_digests(_table(spark, sf_dir, "documents"), content, public_tokenizers.PATTERN)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossaflow.llm.line_dedup import drop_common_lines

    out = drop_common_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossaflow.llm.pii import BASE, spans_of

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    out = spans_of(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossaflow.llm.quality import add_scores, train

    docs = _table(spark, sf_dir, "documents")
    return add_scores(docs, train(docs, _table(spark, sf_dir, "labels")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers

    from glossaflow.llm.lm import score_documents

    with open(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        content = f.read()
    return score_documents(_table(spark, sf_dir, "documents"), content)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossaflow.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossaflow.llm.simhash import near_groups

    groups = near_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossaflow.llm.substring_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossaflow.llm.minhash import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossaflow.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossaflow.llm.lexical import rank

    return rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_url_filters, op2_fingerprints, op3_byte_bpe, op4_line_dedup, op5_quality, op6_pii, op7_lm_scoring, op8_decontamination, op9_simhash,
    op10_substring_dedup, op11_minhash, op12_whitening, op13_ranked_search,
)
QUERIES = {f.__name__: f for f in _ALL}
