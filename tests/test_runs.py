"""Whole runs over small archives with the mock provider."""

import io
import json
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from glossaflow.__main__ import main, write_mapping
from glossaflow.operators import memory, translate
from glossaflow.plans import run as runs
from tests.test_engine import CASES, archive


@pytest.fixture(scope="module")
def books(spark):
    rows = [(k, bytearray(archive([v + "<p>The Norman Conquest began. The Norman Conquest ended.</p>", '<p id="s1">second</p>']))) for k, v in CASES.items()]
    return spark.createDataFrame(rows, "book string, content binary")


def test_translation(spark, books, tmp_path):
    store = memory.Workspace(spark, str(tmp_path / "tm"))
    said = []
    out = runs.translate_books(spark, books, store=store, run=runs.Run(spark, said.append))
    assert said == ["reading", "translating", "wave 1 of 1", "0 segments failed at first", "checking"], out.trace
    kinds = {r["issue_type"] for r in out.issues.collect()}
    assert kinds <= {"link_break", "attribute_changed"}, out.issues.collect()
    packed = {r["book"]: bytes(r["content"]) for r in out.books.collect()}
    assert set(packed) == set(CASES)
    with zipfile.ZipFile(io.BytesIO(packed["code"])) as z:
        text = z.read("OEBPS/ch0.xhtml").decode()
        assert ">raw<" in text and "[中]see" in text and ">no<" in text
        assert "[中]One 1" in z.read("OEBPS/nav.xhtml").decode() and "[中]A" in z.read("OEBPS/toc.ncx").decode()
    out.release()
    assert not out.staged
    rows = store.translations.read().count()
    again = runs.translate_books(spark, books, store=store, resume=True)
    assert store.translations.read().count() == rows and again.counts["cached_segments"] == again.counts["total_segments"] == rows
    assert out.counts["llm_calls"] == len(CASES) and again.counts["llm_calls"] == 0
    assert store.segments.read().count() == rows and spark.read.schema(memory.RUN_SCHEMA).parquet(f"{store.path}/runs").count() == 2


class _Stops:
    """Fails on every call of the text that it is given."""

    def __init__(self, model, settings):
        self.model = model

    def translate(self, rows, hits):
        if any(self.model in r["source_text"] for r in rows):
            raise OSError("down")
        return {r["segment_id"]: f"译{r['source_text']}" for r in rows}

    def revise(self, rows, drafts, hits):
        return drafts


def test_finished_waves_outlive_a_cancel(spark, books, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "WAVE_BATCHES", 2)
    store = memory.Workspace(spark, str(tmp_path / "tm"))
    run = runs.Run(spark)
    run._progress = lambda said: said == "wave 1 of 3" and run.cancel()
    out = runs.translate_books(spark, books, store=store, run=run)
    assert out.code == 130 and out.books is None
    kept = store.translations.read().count()
    assert kept > 0
    again = runs.translate_books(spark, books, store=store, resume=True, run=runs.Run(spark))
    assert again.counts["cached_segments"] == kept and 0 < again.counts["llm_calls"] < len(CASES)


class _Slow:
    """Answers all batches but those of one text at once, and says which; for the others it never ends."""

    def __init__(self, model, settings):
        self.folder = model

    def translate(self, rows, hits):
        if any("line" in r["source_text"] for r in rows):
            time.sleep(300)
        return {r["segment_id"]: f"译{r['source_text']}" for r in rows}

    def revise(self, rows, drafts, hits):
        for r in rows:
            with open(f"{self.folder}/{r['segment_id'].replace('/', '_')}", "w"):
                pass
        return drafts


def test_answered_batches_outlive_a_cancel_inside_a_wave(spark, books, tmp_path, monkeypatch):
    monkeypatch.setitem(translate.PROVIDERS, "slow", _Slow)
    said = tmp_path / "said"
    said.mkdir()
    store, run = memory.Workspace(spark, str(tmp_path / "tm")), runs.Run(spark)

    def watch():
        log = store.log(run.id)
        deadline = time.time() + 60
        while len(log.files()) < len(CASES) - 1 and time.time() < deadline:
            time.sleep(0.2)
        run.cancel()

    watcher = threading.Thread(target=watch)
    watcher.start()
    out = runs.translate_books(spark, books.repartition(len(CASES)), plan=translate.plan("slow", str(said), revise="none"), store=store, run=run, in_flight=4 * len(CASES))
    watcher.join()
    assert out.code == 130 and out.books is None
    kept = {r["segment_id"] for r in store.translations.read().collect()}
    assert len({k.split("#")[0] for k in kept}) == len(CASES) - 1 and not any(k.startswith("poetry#") for k in kept)
    assert not store.log(run.id).files()
    assert store.segments.read().count() > len(kept)


def test_logs_of_killed_runs_are_taken_in(spark, tmp_path):
    store = memory.Workspace(spark, str(tmp_path / "tm"))
    row = {"segment_id": "s", "source_hash": "h", "config_hash": "c", "draft_text": "d", "revise_text": "one", "provider": "p"}
    for text in ("one", "two"):  # a second attempt of a task replaces the first
        store.log("killed").commit("b/1", [{**row, "revise_text": text}])
    store.log("other").commit("b/2", [{**row, "segment_id": "t"}])
    assert store.recover("other") == 1 and store.recover() == 1 and store.recover() == 0
    assert {r["segment_id"]: r["revise_text"] for r in store.translations.read().collect()} == {"s": "two", "t": "one"}


def test_mining_can_be_cancelled(spark, books):
    for when in (None, "reading", "mining", "filling"):
        run = runs.Run(spark)
        if when is None:
            run.cancel()
        else:
            run._progress = lambda said, when=when, run=run: said == when and run.cancel()
        with pytest.raises(runs.Cancelled):
            runs.generate_termbase(spark, books.limit(2), runs.MiningOptions(fill_empty_targets=True), run=run)


def test_links_in_an_archive_whose_package_lies_at_its_root(spark, tmp_path):
    rows = []
    for name, chapter in CASES.items():
        with zipfile.ZipFile(io.BytesIO(archive(['<p id="s1">One <a href="ch1.xhtml#t">two</a></p>' + chapter, '<p id="t">Back to <a href="ch0.xhtml#s1">one</a></p>']))) as z:
            rows += [(f"file:/x/{name}.epub", n.removeprefix("OEBPS/"), bytearray(z.read(n).replace(b"OEBPS/", b""))) for n in z.namelist()]
    files = spark.createDataFrame(rows, "book string, entry string, content binary")
    out = runs.translate_books(spark, files.filter("book NOT LIKE '%footnotes%'"))
    assert out.code == 0, out.issues.collect()
    assert out.issues.filter("issue_type = 'link_break'").count() == 0
    broken = files.withColumn("content", F.when(F.col("entry") == "ch0.xhtml", F.expr("CAST(replace(CAST(content AS string), 'ch1.xhtml#t', 'gone.xhtml#t') AS binary)")).otherwise(F.col("content")))
    out = runs.translate_books(spark, broken.filter("book LIKE '%basic%'"))
    assert out.code == 2 and "href target file missing: gone.xhtml#t from file:/x/basic.epub!ch0.xhtml" in {r["message"] for r in out.issues.collect()}


def test_failed_batches_are_recorded(spark, books, tmp_path, monkeypatch):
    monkeypatch.setitem(translate.PROVIDERS, "stops", _Stops)
    store = memory.Workspace(spark, str(tmp_path / "tm"))
    out = runs.translate_books(spark, books.filter("book IN ('code', 'tables')"), plan=translate.plan("stops", "Norman", revise="none"), store=store)
    errors = spark.read.schema(memory.ERROR_SCHEMA).parquet(f"{store.path}/errors")
    found = {r["stage"] for r in errors.collect()}
    assert found == {"translate", "repair"} and out.counts["failed_segments"] > 0 and out.code == 2
    assert errors.filter("run_id IS NULL OR segment_id IS NULL OR message NOT LIKE '%down%'").count() == 0


def test_failure_and_gate(spark, tmp_path):
    bad = spark.createDataFrame([("x", bytearray(b"no archive"))], "book string, content binary")
    store = memory.Workspace(spark, str(tmp_path / "tm"))
    out = runs.translate_books(spark, bad, store=store)
    assert out.code == 1 and out.issues.first()["issue_type"] == "runtime_fail" and "Traceback" in out.trace
    assert spark.read.schema(memory.ERROR_SCHEMA).parquet(f"{store.path}/errors").first()["stage"] == "runtime"
    term = runs.load_terms(spark, None)
    assert term[0].count() == 0 and '"empty"' in term[1]


def test_mining(spark, books, tmp_path):
    payload, counts = runs.generate_termbase(spark, books, runs.MiningOptions(fill_empty_targets=True), [{"source": "Old", "target": "旧"}])
    by = {t["source"]: t["target"] for t in payload["terms"]}
    assert by["Old"] == "旧（Old）" and by["Norman Conquest"].startswith("[中]Norman Conquest")
    assert counts["generated_terms"] == len(by) - 1 and counts["filled_targets"] >= 1
    for name in ("t.yaml", "t.json"):
        write_mapping(payload, str(tmp_path / name))
        known, _ = runs.load_terms(spark, str(tmp_path / name))
        assert {r["source"] for r in known.collect()} == set(by)


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.epub").write_bytes(archive(['<p id="s1">One plain line.</p>', "<p>Two</p>"]))
    code = main(["translate", str(tmp_path / "in" / "*.epub"), str(tmp_path / "out")])
    assert dict(spark.read.parquet(str(tmp_path / "out" / "issues")).dtypes)["details"] == "variant"
    report = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out" / "report")).collect()]
    assert code == (0 if not any("severity" in r for r in report) else 2)
    with zipfile.ZipFile(tmp_path / "out" / "books" / "a.epub") as z:
        assert z.namelist()[0] == "mimetype" and "[中]Two" in z.read("OEBPS/ch1.xhtml").decode()
    assert main(["translate", str(tmp_path / "in" / "a.epub"), str(tmp_path / "done.epub")]) == code
    assert (tmp_path / "done.epub").exists() and (tmp_path / "done.epub-report").is_dir()
    (tmp_path / "t.json").write_text("no termbase")
    assert main(["termbase", str(tmp_path / "in" / "*.epub"), str(tmp_path / "t.json"), "--fill", "--fill-batch-size", "2", "--max-concurrency", "2"]) == 0
    assert main(["translate", str(tmp_path / "in" / "*.epub"), str(tmp_path / "out2"), "--provider", "mixed", "--draft-provider", "mock", "--revise-provider", "none", "--memory", str(tmp_path / "m")]) == code
