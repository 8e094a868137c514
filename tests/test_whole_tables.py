"""Inputs and sizes that the smallest tables don't have."""

import __spark_entry__ as entry


def test_titles_cut_in_an_entity(spark, tmp_path):
    page = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>{}</title></head><body><p>a &amp;&nbsp;b</p></body></html>'
    rows = [(1, "u", page.format("One&a")), (2, "u", page.format("Two &amp; &am")), (3, "u", page.format("Three&")), (4, "u", page.format("&#38; four"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()["parse_failures"](spark, str(tmp_path)).collect()
    assert sorted((r["file_path"], r["why"]) for r in got) == [(str(i), "mismatched tag") for i in (1, 2, 4)]


def test_rows_of_files_go_in_small_batches(spark):
    from glossaflow.functions import batches
    from glossaflow.sources import epub

    pairs = [{"token": f"t{i}", "raw": "x" * 1000} for i in range(100)]
    rows = ((str(i), "f", i, "/p[1]", "p", None, False, "text", pairs) for i in range(200))
    sizes = [b.num_rows for b in batches.record_batches(rows, epub.NODE)]
    assert sum(sizes) == 200 and max(sizes) * 100_000 <= 2 * batches.BATCH_BYTES  # what pairs hold counts
    files = spark.createDataFrame([("b", "f", "<p>One</p>")], "book string, file_path string, content string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert epub.nodes(files, tolerant=True).count() == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= batches.BATCH_ROWS


def test_paths_are_looked_up_in_what_has_become_of_a_file():
    from glossaflow.sources import markup

    data = "<r>" + "<p>a<b>c</b></p>" * 3 + "</r>"
    tasks = [{"node_selector": "/r[1]/p[2]/b[1]", "text": "B"}, {"node_selector": "/r[1]/p[2]", "text": "<i>x</i><b>n</b><b>m</b>"}, {"node_selector": "/r[1]/p[2]/b[2]", "text": "M"}, {"node_selector": "/r[1]/p[3]/b[1]", "text": "C"}]
    out = markup.rewritten(data.encode(), tasks).decode()
    assert out.endswith("<r><p>a<b>c</b></p><p><i>x</i><b>n</b><b>M</b></p><p>a<b>C</b></p></r>")


def _bounds(spark, make):
    """Rows of an Arrow batch that the session has after ``make``, from a bound of 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    make()
    return int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


def test_texts_meet_terms_in_small_batches(spark):
    from glossaflow.operators import terms

    texts = spark.createDataFrame([("One Two",), (None,)], "source_text string")
    known = spark.createDataFrame([("one", "x")], "source string, target string")
    assert _bounds(spark, lambda: terms.term_hits(texts, known).collect()) <= 128


def test_texts_are_mined_and_cut_in_small_batches(spark):
    from glossaflow.functions import masking

    texts = spark.createDataFrame([("The Red House",)], "text string")
    for column in (masking.phrases_column("text"), masking.mask_markup_column("text")):
        assert len(texts.select(column).collect()) == 1
    assert _bounds(spark, lambda: masking.phrases_column("text")) <= 512
    assert _bounds(spark, lambda: masking.chunks_column("text", 10)) <= 512


def test_a_batch_of_segments_is_one_call_across_arrow_batches(spark):
    from glossaflow.operators import translate

    class Counting(translate.MockProvider):
        def translate(self, rows, hits):
            return {r["segment_id"]: f"[中]{len(rows)}" for r in rows}

    rows = [(key, f"{key}{i}", "t", "[]") for i in range(700) for key in ("a", "b", "c")] + [(None, "n", "t", "[]")]
    done = translate.translate(spark.createDataFrame(rows, "batch_key string, segment_id string, source_text string, hits string"), Counting)
    assert "MapInArrow" in done._jdf.queryExecution().toString()
    assert {(r["draft_text"], r["n"]) for r in done.groupBy("draft_text").count().withColumnRenamed("count", "n").collect()} == {("[中]700", 2100), ("[中]1", 1)}


def test_small_archives_share_tasks_and_are_read_at_once(spark, tmp_path):
    import zipfile

    from glossaflow.sources import archive_files as A
    from glossaflow.sources import store

    for k in range(400):
        with zipfile.ZipFile(tmp_path / f"{k}.epub", "w") as z:
            z.writestr("a.xhtml", "x")
    reader = A.ArchiveReader({"path": str(tmp_path)})
    (part,) = reader.partitions()
    reads, plain = [], store.opened

    class Counted:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, path):
            reads.append(path)
            return self.fs.open_input_file(path)

    try:
        store.opened = lambda path: (Counted(plain(path)[0]), plain(path)[1])
        assert sum(b.num_rows for b in reader.read(part)) == 400
    finally:
        store.opened = plain
    assert len(reads) == 400


def test_pages_of_many_links_go_in_small_batches(spark):
    from glossaflow.functions import batches
    from glossaflow.sources import epub

    page = "<html><body>" + "".join(f'<p>{i} <a href="u{i}">{"x" * 200}</a> y</p>' for i in range(600)) + "</body></html>"
    pages = spark.createDataFrame([(str(k), "u", page) for k in range(4)], "book string, file_path string, content string")
    assert _bounds(spark, lambda: epub.nodes(pages, tolerant=True)) <= batches.BATCH_ROWS
    assert epub.nodes(pages, tolerant=True).filter("tag = 'p'").count() == 2400


def test_only_wanted_files_leave_an_archive(spark):
    from glossaflow.sources import epub
    from tests.test_engine import archive

    books = spark.createDataFrame([("a", bytearray(archive(["<p>one</p>", "<p>two 2</p>"]))), ("b", bytearray(archive(["<p>three</p>"]))), ("c", bytearray(archive([])))], "book string, content binary")
    order = epub.reading_order(*(part(epub.package(books)) for part in (epub.manifest, epub.spine)))
    want = epub.entries(books).withColumnRenamed("entry", "file_path").join(order.select("book", "file_path"), ["book", "file_path"], "left_semi")
    got = epub.files_of(books, order)
    key = lambda df: sorted((r["book"], r["file_path"], bytes(r["content"])) for r in df.select("book", "file_path", "content").collect())
    assert key(got) == key(want) and got.count() == 3
    tasks = epub.node_tasks(epub.nodes(got), order)
    assert tasks.filter("node_task_id <> format_string('NT_%06d', order_index)").count() == 0
    assert str(tasks._jdf.queryExecution().executedPlan()).count("row_number") == 1  # one order of a book numbers its tasks


def test_plain_searches_find_what_patterns_find():
    import re

    from glossaflow.functions import masking

    for text in ("", "a", "Ab", "x1", "١", "é٣", "é", "IV", "I V", "MIX", "ix", "c. fl."):
        digit, roman = masking.HOLDS[1](text), masking.HOLDS[2](text)
        assert bool(digit) == bool(re.search(r"\d", text)) and bool(roman) == bool(re.search("[IVXLCDM]{2}", text))
        assert masking.mask_markup(text) == masking.mask_text(text)
