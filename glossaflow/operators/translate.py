"""Provider calls over batches, with retries of rows that come back unfit.

A provider is a Python object with ``translate(rows, hits)`` and
``revise(rows, drafts, hits)``; it gets a batch of segments and returns id ->
text. Batches are groups of rows, so the cluster's cores bound the calls that
run at a time. Lost tasks call again, as any retry of a call does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby
from operator import itemgetter
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.functions import text as T
from glossaflow.functions.batches import BATCH_BYTES, BATCH_ROWS, record_batches, values_of
from glossaflow.operators import chat
from glossaflow.operators.result_log import ResultLog
from glossaflow.plans.config import Settings
from glossaflow.plans.scratch import bounded_batches

RESULT = "segment_id string, draft_text string, revise_text string, provider string, calls int, error string"
REPLY = "results array<struct<id:string,translated_text:string>>"
EXTRA_ROUNDS = 2


class Provider(Protocol):
    def translate(self, rows: list[dict], hits: list[dict]) -> dict[str, str]: ...

    def revise(self, rows: list[dict], drafts: dict[str, str], hits: list[dict]) -> dict[str, str]: ...


class MockProvider:
    """Puts a mark before each text; revises nothing."""

    def translate(self, rows: list[dict], hits: list[dict]) -> dict[str, str]:
        return {r["segment_id"]: f"[中]{r['source_text']}" for r in rows}

    def revise(self, rows: list[dict], drafts: dict[str, str], hits: list[dict]) -> dict[str, str]:
        return drafts


class MockReviser(MockProvider):
    """Puts another mark before each draft: a second stand-in, to tell the steps of a plan apart."""

    def revise(self, rows: list[dict], drafts: dict[str, str], hits: list[dict]) -> dict[str, str]:
        return {i: f"[校]{text}" for i, text in drafts.items()}


class MixedProvider:
    """Drafts by one provider, revisions by another, or by none."""

    def __init__(self, draft: Provider, revise: Provider | None):
        self.draft, self.reviser = draft, revise
        self.name = "+".join(type(p).__name__ for p in (draft, revise) if p)

    def translate(self, rows: list[dict], hits: list[dict]) -> dict[str, str]:
        return self.draft.translate(rows, hits)

    def revise(self, rows: list[dict], drafts: dict[str, str], hits: list[dict]) -> dict[str, str]:
        return self.reviser.revise(rows, drafts, hits) if self.reviser else drafts


Build = Callable[[str, Settings], Provider]
PROVIDERS: dict[str, Build] = {"mock": lambda model, settings: MockProvider(), "mock-reviser": lambda model, settings: MockReviser()}
PROVIDERS |= {name: partial(chat.service_provider, name) for name in chat.SERVICES}

# What the steps of the mixed provider and of the pure translator are where nothing is said.
MIXED, STEPS = "mixed", {"mixed": ("openai", "deepseek"), "dashscope-mt": ("dashscope-mt", "none")}


@dataclass(frozen=True)
class Step:
    provider: str
    model: str = ""


@dataclass(frozen=True)
class Plan:
    """Who drafts, and who revises, if anyone."""

    draft: Step = Step("mock")
    revise: Step | None = None

    def values(self) -> dict:
        return {step: None if who is None else f"{who.provider}:{who.model}" for step, who in (("draft", self.draft), ("revise", self.revise))}

    def maker(self, settings: Settings | None = None) -> Callable[[], Provider]:
        """What makes the provider inside a task; unknown names fail here, before any call."""
        settings = settings or Settings()
        steps = [step for step in (self.draft, self.revise) if step]
        for step in steps:
            if step.provider not in PROVIDERS:
                raise ValueError(f"unknown provider: {step.provider}")
        # Keys are looked up here: a missing one fails before any call, and executors need no environment of their own.
        keys = {step.provider: {"key": chat.key_of(step.provider)} for step in steps if step.provider in chat.SERVICES}
        builds = [partial(PROVIDERS[step.provider], step.model, settings, **keys.get(step.provider, {})) for step in steps]

        def make() -> Provider:
            made = [build() for build in builds]
            return made[0] if self.revise and self.draft == self.revise else MixedProvider(*made) if self.revise else MixedProvider(made[0], None)

        return make


def plan(provider: str = "mock", model: str = "", draft: str | None = None, revise: str | None = None, draft_model: str | None = None, revise_model: str | None = None) -> Plan:
    """Steps from a provider's name and what is said of each step.

    ``mixed`` names no provider itself: both steps have their own. Of any other
    the draft is its own, whatever the draft settings say; ``mock`` revises its
    own drafts, and ``none`` leaves revision out.
    """
    usual = STEPS.get(provider, (provider, provider))
    mixed = provider == MIXED
    first = Step(draft or usual[0], draft_model or model) if mixed else Step(provider, model)
    second = "none" if provider == "mock" else revise or usual[1]
    return Plan(first, None if second == "none" else Step(second, revise_model or model))


def post_edit(drafts: dict[str, str]) -> dict[str, str]:
    """Place for edits of drafts; none by default."""
    return drafts


def mock_translation(c: Column | str) -> Column:
    """What the mock provider returns, as an expression."""
    return F.concat(F.lit("[中]"), F.col(c) if isinstance(c, str) else c)


_TOKEN = re.compile(T.TOKEN)
_KANA = re.compile(T.KANA)
_LATIN = re.compile(T.LATIN)


def _same_tokens(a: str, b: str) -> bool:
    return sorted(_TOKEN.findall(a)) == sorted(_TOKEN.findall(b))


def _fit(source: str, text: str) -> bool:
    """Whether a text needs no further round: its tokens whole, and translated."""
    if not _same_tokens(source, text):
        return False
    bare = source.strip()
    probe = _TOKEN.sub("", bare).strip()
    unchanged = bare and bare == text.strip() and probe
    return not (unchanged and (_KANA.search(probe) or len(probe) >= 40 and len(_LATIN.findall(probe)) >= 20))


def _choice(source: str, revised: str, draft: str) -> str:
    for text in (revised, draft):
        if text and _same_tokens(source, text):
            return text
    text = revised or draft
    left = _TOKEN.findall(text)
    missing = []
    for token in _TOKEN.findall(source):
        if token in left:
            left.remove(token)
        else:
            missing.append(token)
    missing.sort(key=_TOKEN.findall(source).index)
    return " ".join(x for x in (text.strip(), "".join(missing)) if x) if missing else text


def run_batch(provider: Provider, rows: list[dict], hits: list[dict]) -> tuple[dict[str, str], dict[str, str], int]:
    """Drafts, chosen texts and the number of rounds; unfit rows go twice more."""
    drafts = post_edit(provider.translate(rows, hits))
    revised = provider.revise(rows, drafts, hits)
    texts = {r["segment_id"]: _choice(r["source_text"], revised.get(r["segment_id"], ""), drafts.get(r["segment_id"], "")) for r in rows}
    drafts = dict(drafts)
    rounds = 1
    todo = [r for r in rows if not _fit(r["source_text"], texts[r["segment_id"]])]
    while todo and rounds <= EXTRA_ROUNDS:
        rounds += 1
        try:
            again = post_edit(provider.translate(todo, hits))
            better = provider.revise(todo, again, hits)
        except Exception:  # a failed extra round leaves what there is
            continue
        for r in list(todo):
            i = r["segment_id"]
            text = _choice(r["source_text"], better.get(i, ""), again.get(i, ""))
            if text.strip() and _fit(r["source_text"], text):
                drafts[i], texts[i] = again.get(i, drafts.get(i, "")), text
                todo.remove(r)
    return drafts, texts, rounds


def translate(batches: DataFrame, provider: str | Plan | Callable[[], Provider] = "mock", in_flight: int | None = None, log: ResultLog | None = None) -> DataFrame:
    """Results for segments of batches (batch_key, segment_id, source_text, hits).

    With a ``log``, each answered batch is committed to it at once; then the
    batches have source_hash and config_hash too.

    ``in_flight`` bounds the batches that are out at a time: they are dealt to
    so many partitions, and a task has one call open.
    """
    make = provider if callable(provider) else (plan(provider) if isinstance(provider, str) else provider).maker()

    columns = ["batch_key", "segment_id", "source_text", "hits", *["source_hash", "config_hash"] * bool(log)]

    def call(batch_key, batch: list[dict]) -> list[tuple]:
        engine = make()
        name = getattr(engine, "name", None) or type(engine).__name__
        rows = [{"segment_id": r["segment_id"], "source_text": r["source_text"]} for r in batch]
        hits = json.loads(batch[0]["hits"] or "[]")
        try:
            drafts, texts, rounds = run_batch(engine, rows, hits)
            out = [(r["segment_id"], drafts.get(r["segment_id"]), texts[r["segment_id"]], name, rounds, None) for r in rows]
            if log:
                keys = [{c: r[c] for c in ("segment_id", "source_hash", "config_hash")} for r in batch]
                log.commit(str(batch_key), [{**k, "draft_text": drafts.get(k["segment_id"]), "revise_text": texts[k["segment_id"]], "provider": name} for k in keys])
        except Exception as e:
            out = [(r["segment_id"], None, None, name, 1, f"Batch translation failed: {e}") for r in rows]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of segments as they follow each other in sorted rows; one is held at a time."""
        groups = groupby(values_of(batches), key=itemgetter(0))
        yield from record_batches((row for key, rows in groups for row in call(key, [dict(zip(columns, r, strict=True)) for r in rows])), RESULT)

    bounded_batches(batches.sparkSession, BATCH_ROWS, BATCH_BYTES)
    rows = batches.select(*columns)
    rows = rows.repartition(in_flight, "batch_key") if in_flight else rows.repartition("batch_key")
    return rows.sortWithinPartitions("batch_key").mapInArrow(run, RESULT)


def repair(segments: DataFrame, provider: str | Plan | Callable[[], Provider] = "mock", in_flight: int | None = None, log: ResultLog | None = None) -> DataFrame:
    """A second pass over segments (segment_id, source_text, translated) that need it, each by itself."""
    bad = segments.filter(T.needs_repair("source_text", F.coalesce("translated", F.lit(""))))
    return translate(bad.withColumns({"batch_key": F.col("segment_id"), "hits": F.lit("[]")}), provider, in_flight, log)


def batch_payload(segments: DataFrame, style: str, revise: bool = False) -> DataFrame:
    """(batch_key, payload): the JSON request of each batch of segments.

    segments: batch_key, segment_id, order_index, segment_type, source_text,
    draft_text, placeholders, hits. A batch holds a bounded number of rows.
    """
    keep = F.struct(F.col("placeholders").alias("do_not_translate"))
    if revise:
        keep = F.struct(F.col("placeholders").alias("do_not_change_placeholders"), F.lit(True).alias("do_not_change_numbers"))
        row = F.struct(F.col("segment_id").alias("id"), F.col("source_text").alias("source"), F.coalesce("draft_text", F.lit("")).alias("draft"), keep.alias("constraints"))
    else:
        row = F.struct(F.col("segment_id").alias("id"), F.col("segment_type").alias("type"), F.col("source_text").alias("text"), keep.alias("constraints"))
    rows = segments.groupBy("batch_key").agg(F.array_sort(F.collect_list(F.struct("order_index", row.alias("row")))).alias("rows"), F.first("hits").alias("hits"))
    wanted = F.struct(F.array(F.struct(F.lit("string").alias("id"), F.lit("string").alias("translated_text"))).alias("results"))
    payload = F.struct(
        F.lit("revise_translation" if revise else "draft_translate").alias("task"), T.style_guide(F.lit(style), revise).alias("style_guide"), F.col("hits").alias("termbase_hits"),
        F.transform("rows", lambda x: x["row"]).alias("segments"), wanted.alias("output_schema"), F.lit("auto").alias("source_lang"), F.lit("Simplified Chinese").alias("target_lang"),
    )
    return rows.select("batch_key", F.to_json(payload).alias("payload"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """Rows (batch_key, id, translated_text) of replies (batch_key, reply), fences removed."""
    parsed = replies.withColumn("_r", F.from_json(T.unfenced("reply"), REPLY))
    return parsed.select("batch_key", F.explode_outer("_r.results").alias("x")).select("batch_key", "x.id", "x.translated_text")


def reply_errors(expected: DataFrame, replies: DataFrame) -> DataFrame:
    """(batch_key, error) for each batch, error null if its reply is whole.

    expected: batch_key, id. A reply must have each id once, with a text.
    """
    got = parse_replies(replies)
    unfit = F.max(F.col("id").isNull() | (F.col("id") == "") | F.col("translated_text").isNull())
    per_reply = got.groupBy("batch_key").agg(unfit.alias("unfit"), (F.count("id") != F.countDistinct("id")).alias("twice"))
    pairs = expected.select("batch_key", "id").distinct().withColumn("_e", F.lit(1)).join(got.select("batch_key", "id").distinct().withColumn("_g", F.lit(1)), ["batch_key", "id"], "full_outer")
    differ = pairs.groupBy("batch_key").agg(F.max(F.col("_e").isNull() | F.col("_g").isNull()).alias("differ"))
    error = F.when(F.col("unfit"), "id/translated_text missing").when(F.col("twice"), "duplicate id").when(F.col("differ"), "ids mismatch")
    return differ.join(per_reply, "batch_key", "left").select("batch_key", error.alias("error"))


def segment_counts() -> dict[str, Column]:
    """Counters of rows (state, translated, error), to be aggregated or observed."""
    return {
        "total_segments": F.count("*"), "translated_segments": F.count_if(F.coalesce("translated", F.lit("")) != ""),
        "cached_segments": F.count_if(F.col("state") == "cached"), "failed_segments": F.count_if(F.col("error").isNotNull()),
    }


def run_counts(states: DataFrame) -> DataFrame:
    """One row of run counters from (state, translated, batch_key, error)."""
    calls = F.count_distinct(F.when(F.col("state") != "cached", F.col("batch_key")))
    return states.agg(*[c.alias(name) for name, c in segment_counts().items()], calls.alias("llm_calls"))


def with_candidates(segments: DataFrame, drafts: DataFrame, revisions: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with the draft and the revision of each, empty where there is none.

    drafts: keys, draft; revisions: keys, revised. Both are keyed tables, so no segment is doubled.
    """
    out = segments.join(drafts, keys, "left").join(revisions, keys, "left")
    return out.withColumns({"draft": F.coalesce("draft", F.lit("")), "revised": F.coalesce("revised", F.lit(""))})


def failed_ids(results: DataFrame, key: str = "segment_id") -> DataFrame:
    """Each id that has a failed call, once."""
    return results.filter("error IS NOT NULL").select(key).distinct()


def exit_code(passed: bool | None, cancelled: bool = False, failed: bool = False) -> int:
    """0: gate passed, 2: not passed, 1: failed, 130: cancelled."""
    return 130 if cancelled else 1 if failed else 0 if passed else 2


def unchanged_count(rows: DataFrame) -> DataFrame:
    same = T.strip("source_text") == T.strip("translated")
    return rows.agg(F.count_if(same).alias("unchanged"))
