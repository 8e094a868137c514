"""The two runs of the engine: translating archives, and mining a termbase.

Each is one plan over all archives at a path; what several steps read is staged
once. The outcome is a set of files and an exit code: 0 if the gate is passed,
2 if not, 1 on failure, 130 if cancelled. Archives are written in either case
of the gate.

Calls are made in waves of batches, and the memory takes the results of a wave
before the next begins. Inside a wave each task commits a batch to a log when it
is answered. Whatever ends a run, the memory has every answered batch: a
cancelled or failed run takes its log in itself, the next one those of runs that
were killed, and ``resume`` goes on after them.
"""

from __future__ import annotations

import math
import traceback
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.functions import text as T
from glossaflow.operators import memory, qa, segments, terms, translate
from glossaflow.plans.config import Settings, fingerprint, read_document
from glossaflow.plans.scratch import Observed, drop_staged, stage_table, staged_here
from glossaflow.sources import epub

TERM = terms.TERM
Progress = Callable[[str], None]
WAVES = 50  # at most; each is a job and a part of the memory
WAVE_BATCHES = 64  # at least, where there are so many


@dataclass
class Outcome:
    code: int
    counts: dict = field(default_factory=dict)
    books: DataFrame | None = None  # (book, content), packed when it is read
    files: DataFrame | None = None  # (book, entry, content)
    issues: DataFrame | None = None
    summary: str = ""
    trace: str = ""
    staged: list = field(default_factory=list, repr=False)

    def release(self) -> None:
        """Drops the tables of the run, when its books, files and issues have been written or read."""
        drop_staged(self.staged)


def load_terms(spark: SparkSession, path: str | None) -> tuple[DataFrame, str]:
    """Accepted terms of a file, longest source first by rank, and their fingerprint."""
    payload = read_document(spark, path) if path else {}
    rows = terms.read_terms(payload)
    frame = spark.createDataFrame([(t["source"], t["target"], t["force"], t["note"], i) for i, t in enumerate(rows)], f"{TERM}, place int")
    kept = terms.accepted(frame)
    version = str(payload.get("version", "1")) if path else "empty"
    ranked = kept.withColumn("term_rank", F.struct(-F.length("source"), "place")).drop("place")
    return ranked, terms.fingerprint([r.asDict() for r in kept.select("source", "target", "force", "note").collect()], version)


class Cancelled(InterruptedError):
    """What a cancelled run raises between its steps."""


class Run:
    """Job group of a run: cancel() ends its jobs, and the run returns 130."""

    def __init__(self, spark: SparkSession, progress: Progress | None = None):
        self.spark, self.id, self.cancelled = spark, f"{datetime.now(timezone.utc):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:6]}", False
        self._progress = progress
        spark.sparkContext.setJobGroup(self.id, "glossaflow run", interruptOnCancel=True)

    def say(self, message: str) -> None:
        if self._progress:
            try:
                self._progress(message)
            except Exception:  # a listener must not end a run
                pass

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobGroup(self.id)

    def go_on(self) -> None:
        """Between steps, since a cancel may come while no job is running."""
        if self.cancelled:
            raise Cancelled("cancelled")


def _in_waves(batched: DataFrame, make: Callable, in_flight: int | None, store: memory.Workspace | None, run: Run) -> tuple[DataFrame, int, int]:
    """Results of all batches, how many of them failed, and the number of batches; each wave is in the memory before the next begins.

    Batches lie apart by wave, so that a wave reads its own.
    """
    batches = batched.select("batch_key").distinct().count()
    waves = max(1, min(WAVES, math.ceil(batches / max(WAVE_BATCHES, 4 * (in_flight or 0)))) if store else 1)
    if waves > 1:
        batched = stage_table(batched.withColumn("wave", F.pmod(F.xxhash64("batch_key"), F.lit(waves)).cast("int")), "waves", ["wave"])
    log = store.log(run.id) if store else None
    done, failed = None, 0
    for k in range(waves):
        run.go_on()
        rows = batched.filter(F.col("wave") == k) if waves > 1 else batched
        seen = Observed(failed=F.count_if(F.col("error").isNotNull()))
        found = stage_table(translate.translate(rows, make, in_flight, log), "translated", observed=seen)
        failed += seen.values()["failed"]
        if store:
            store.translations.upsert(found.filter("error IS NULL").join(rows.select(*memory.KEY), "segment_id").withColumn("updated_at", F.current_timestamp()))
            if log:
                log.clear()
        run.say(f"wave {k + 1} of {waves}")
        done = found if done is None else done.unionByName(found)
    return done, failed, batches


def _files(books: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All files, those in reading order, and the tables of contents; of archives (book, content) or their files (book, entry, content)."""
    rows = books if "entry" in books.columns else epub.entries(books)
    files = stage_table(rows.withColumnRenamed("entry", "file_path"), "files")
    rows = stage_table(epub.package_of(files), "package")
    items = epub.manifest(rows)
    order = stage_table(epub.reading_order(items, epub.spine(rows)).filter("file_path IS NOT NULL"), "order")
    toc = epub.nav_file(items).withColumn("kind", F.lit("nav")).unionByName(epub.ncx_file(items).withColumn("kind", F.lit("ncx")))
    return files, order, files.join(toc, ["book", "file_path"])


def translate_books(
    spark: SparkSession, books: DataFrame, settings: Settings | None = None, term_path: str | None = None, plan: translate.Plan | None = None,
    store: memory.Workspace | None = None, resume: bool = False, run: Run | None = None, in_flight: int | None = None, names: tuple[str, str] = ("", ""),
) -> Outcome:
    """Translates archives (book, content), or their files (book, entry, content); ``names`` are those of input and output in the record of runs."""
    with staged_here(drop=False) as held:
        outcome = _translated(spark, books, settings or Settings(), term_path, plan or translate.plan(), store, resume, run or Run(spark), in_flight, names)
    outcome.staged = held
    return outcome


def _translated(
    spark: SparkSession, books: DataFrame, settings: Settings, term_path: str | None, plan: translate.Plan, store: memory.Workspace | None, resume: bool, run: Run,
    in_flight: int | None, names: tuple[str, str],
) -> Outcome:
    try:
        make = plan.maker(settings)
        known, terms_digest = load_terms(spark, term_path)
        key = fingerprint(settings=settings, terms={"all": terms_digest}, provider=plan.values())
        if store:
            store.recover()
            store.begin(run.id, *names, plan.draft.provider, key)
        files, order, toc = _files(books)
        chapters = files.join(order.select("book", "file_path").distinct(), ["book", "file_path"], "left_semi")
        run.say("reading")
        columns = ["book", "node_task_id", "file_path", "node_selector", "segment_type", "source_text", "pairs", "order_index", "poetry_line_count"]
        tasks = epub.node_tasks(epub.nodes(chapters, settings["translate_titles"]), order).select(*columns)
        if settings["translate_toc"]:
            labels = epub.toc_tasks(epub.toc_rows(toc)).withColumns({"order_index": F.col("pos"), "poetry_line_count": F.lit(None).cast("int")})
            tasks = segments.task_union(tasks, labels.select(*columns), ["book"])
        tasks = stage_table(tasks, "tasks")
        seg = segments.build_segments(tasks, ["book"], settings["segmentation.max_chars_per_segment"], settings["context.prev_segment_chars"])
        seg = seg.withColumns({"source_hash": T.text_hash("source_text"), "config_hash": F.lit(key), "segment_id": F.concat_ws("#", "book", "segment_id")})
        seg = stage_table(seg, "segments")
        if store:
            store.segments.upsert(memory.segment_rows(seg))

        held = store.translations.lookup(seg.select(*memory.KEY)) if store and resume else spark.createDataFrame([], memory.SCHEMA)
        probed = stage_table(memory.probe(seg, held, prefer_revise=plan.revise is not None), "probed")
        todo = probed.filter("state <> 'cached'").withColumns({"chars": F.length("source_text"), "_order": F.struct("order_index", "chunk_index")})
        batched = segments.greedy_batches(todo, "book", "_order", "chars", settings["segmentation.max_chars_per_batch"], settings["segmentation.max_segments_per_batch"])
        batched = stage_table(batched.withColumn("batch_key", F.concat_ws("/", "book", F.col("batch_no").cast("string"))), "batched")
        hits = terms.batch_hits(terms.term_hits(batched.select("batch_key", "order_index", "source_text"), known), ["batch_key"])
        shown = F.to_json(F.array_sort(F.collect_list(F.struct("source", "target", "force", "note"))))
        batched = stage_table(batched.join(hits.groupBy("batch_key").agg(shown.alias("hits")), "batch_key", "left"), "asked")
        run.say("translating")
        done, failures, batches = _in_waves(batched, make, in_flight, store, run)
        merged = probed.join(done, "segment_id", "left").withColumn("translated", F.coalesce("cached", "revise_text", F.lit("")))
        merged = stage_table(merged.join(batched.select("segment_id", "batch_key"), "segment_id", "left"), "merged")
        run.go_on()
        run.say(f"{failures} segments failed at first")
        log = store.log(run.id) if store else None
        repaired = stage_table(translate.repair(merged.select(*memory.KEY, "source_text", "translated"), make, in_flight, log), "repaired")
        if store:
            store.translations.upsert(repaired.filter("error IS NULL").join(seg.select(*memory.KEY), "segment_id").withColumn("updated_at", F.current_timestamp()))
            if log:
                log.clear()
            failed = done.filter("error IS NOT NULL").select("segment_id", F.lit("translate").alias("stage"), F.col("error").alias("message"))
            failed = failed.unionByName(repaired.filter("error IS NOT NULL").select("segment_id", F.lit("repair").alias("stage"), F.col("error").alias("message")))
            for stage in ("translate", "repair"):
                store.fail(failed.filter(F.col("stage") == stage).drop("stage"), run.id, stage)
        better = repaired.filter("error IS NULL").select("segment_id", F.col("revise_text").alias("_better"))
        seen_rows = Observed(**translate.segment_counts())
        final = stage_table(merged.join(better, "segment_id", "left").withColumn("translated", F.coalesce("_better", "translated")), "final", observed=seen_rows)
        run.go_on()

        pieces = final.select("segment_id", F.col("translated").alias("text"))
        texts = segments.merge_chunks(seg.select("book", "node_task_id", "chunk_index", "segment_id"), pieces, ["book", "node_task_id"], ["segment_id"])
        ready = stage_table(tasks.join(texts, ["book", "node_task_id"]), "node-texts")
        out = epub.rewrite(files, ready.filter("segment_type <> 'toc'"))
        out = stage_table(epub.rewrite(out, ready.filter("segment_type = 'toc'"), plain_tag="text"), "rewritten")

        run.say("checking")
        was, now = (stage_table(epub.file_facts(x.join(order.select("book", "file_path").distinct(), ["book", "file_path"], "left_semi")), "facts") for x in (files, out))
        path = F.concat_ws("!", "book", "file_path")
        facts = lambda x: x.select(path.alias("file_path"), "parse_error", "signatures")
        kinds = toc.select("book", "file_path", "kind")
        before, after = epub.toc_hrefs(toc), epub.toc_hrefs(out.join(kinds, ["book", "file_path"]))
        lines = tasks.select(F.concat_ws("#", "book", "node_task_id").alias("node_task_id"), "poetry_line_count")
        seen = facts(now)
        issues = qa.all_issues(
            qa.segment_issues(final, known), qa.poetry_line_mismatch(lines, texts.select(F.concat_ws("#", "book", "node_task_id").alias("node_task_id"), "text")), qa.parse_failures(seen),
            qa.broken_links(now.select("book", "file_path", F.explode("hrefs").alias("href")), now, now.select("book", "file_path", F.explode("ids").alias("anchor")), "book"),
            qa.toc_changes(before, after), qa.attribute_changes(facts(was).select("file_path", "signatures"), seen.select("file_path", "signatures")),
        )
        found = Observed(error_count=F.count_if(F.col("severity") == "error"), warn_count=F.count_if(F.col("severity") == "warn"))
        issues = stage_table(issues, "issues", observed=found)
        counts = {**seen_rows.values(), "llm_calls": batches}  # taken while the tables were written
        gate = qa.gated(spark.createDataFrame([found.values()], "error_count long, warn_count long"), counts["total_segments"], settings["qa.warn_ratio_limit"], settings["qa.warn_min_cap"]).first()
        whole = out.withColumnRenamed("file_path", "entry")
        return Outcome(translate.exit_code(gate["passed"]), counts, epub.pack(whole), whole, issues, qa.summary(issues, counts["total_segments"]))
    except Exception as e:
        if store:
            store.recover(run.id)
        if run.cancelled:
            return Outcome(translate.exit_code(None, cancelled=True))
        failed = spark.createDataFrame([(None, f"{type(e).__name__}: {e}")], "segment_id string, message string")
        if store:
            store.fail(failed, run.id, "runtime")
        issues = qa.all_issues(qa.runtime_failure(failed))
        return Outcome(translate.exit_code(None, failed=True), {}, None, None, issues, qa.summary(issues, 0), traceback.format_exc())


@dataclass
class MiningOptions:
    min_freq: int = 2
    max_terms: int = 300
    include_single_word: bool = False
    merge_existing: bool = True
    fill_empty_targets: bool = False
    fill_provider: str = "mock"
    fill_model: str = ""
    fill_batch_size: int = 40


def generate_termbase(
    spark: SparkSession, books: DataFrame, options: MiningOptions, existing: list[dict] | None = None, name: str = "",
    settings: Settings | None = None, in_flight: int | None = None, run: Run | None = None,
) -> tuple[dict, dict]:
    """(payload to write as YAML or JSON, counts); at most max_terms new terms. Raises ``Cancelled`` when ``run`` is cancelled."""
    run = run or Run(spark)
    try:
        with staged_here():
            return _mined(spark, books, options, existing, name, settings, in_flight, run)
    except Exception:
        run.go_on()  # what a cancelled job raises is no failure
        raise


def _mined(spark: SparkSession, books: DataFrame, options: MiningOptions, existing: list[dict] | None, name: str, settings: Settings | None, in_flight: int | None, run: Run) -> tuple[dict, dict]:
    run.go_on()
    run.say("reading")
    files, order, _ = _files(books)
    chapters = files.join(order.select("book", "file_path").distinct(), ["book", "file_path"], "left_semi")
    nodes = stage_table(epub.text_nodes(chapters), "text-nodes")
    run.go_on()
    run.say("mining")
    found = stage_table(terms.candidates(nodes, single=options.include_single_word), "candidates")
    old = [t for t in existing or [] if t.get("source")] if options.merge_existing else []
    known = spark.createDataFrame([(str(t["source"]), str(t.get("target") or ""), bool(t.get("force", False)), str(t.get("note", "")), i) for i, t in enumerate(old)], f"{TERM}, place int")
    picked = terms.top_candidates(found, options.min_freq, options.max_terms)
    fresh = terms.new_terms(picked, known).withColumn("place", -F.regexp_extract("note", r"(\d+)$", 1).cast("int"))
    every = stage_table(terms.termbase_union(known, fresh), "termbase")
    outcomes: dict[str, int] = {}
    run.go_on()
    if options.fill_empty_targets:
        run.say("filling")
        asked = terms.term_segments(terms.to_fill(every).select("source").distinct(), "source")
        size = max(1, options.fill_batch_size)
        number = F.floor((F.regexp_extract("segment_id", r"(\d+)$", 1).cast("long") - 1) / size)
        make = translate.plan(options.fill_provider, options.fill_model, revise="none").maker(settings)
        asked = stage_table(asked.withColumns({"hits": F.lit("[]"), "batch_key": number.cast("string")}), "asked")
        replies = translate.translate(asked, make, in_flight).join(asked.select("segment_id", "source"), "segment_id").select("source", F.col("draft_text").alias("reply"))
        every = stage_table(terms.fill_targets(every, replies), "filled")
        outcomes = {r["outcome"]: r["count"] for r in every.groupBy("outcome").count().collect()}
    run.go_on()
    done = stage_table(terms.normalise_targets(every), "normal")
    listed = done.orderBy("branch", "place", F.desc(F.length("source")), "source").select("source", "target", "force", "note").collect()
    payload = {"version": 1, "generated_at": datetime.now(timezone.utc).isoformat(), "source_epub": name, "settings": asdict(options), "terms": [r.asDict() for r in listed]}
    counts = {
        "scanned_text_nodes": nodes.count(), "candidate_terms": found.filter(F.col("freq") >= max(1, options.min_freq)).count(), "generated_terms": every.filter("branch = 1").count(),
        "total_terms_in_file": len(listed), "filled_targets": outcomes.get("filled", 0), "rejected_non_cjk_targets": outcomes.get("rejected", 0),
        "cleared_non_cjk_targets": done.filter("cleared").count(),
    }
    return payload, counts
