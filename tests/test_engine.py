"""Operators, sources and streaming on small tables."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from glossaflow.operators import memory, qa, segments, terms, translate
from glossaflow.plans import config
from glossaflow.plans.components import components
from glossaflow.plans.scratch import scratch_dir, stage_table
from glossaflow.sources import epub, markup
from glossaflow.streaming.resume import resume, translate_missing

P1 = "⟦PH:000001⟧"


def archive(chapters, nav=True, container=True):
    out = io.BytesIO()
    items = "".join(f'<item id="c{i}" href="ch{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(chapters)))
    refs = "".join(f'<itemref idref="c{i}"/>' for i in reversed(range(len(chapters))))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        if container:
            z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr(
            "OEBPS/content.opf",
            f'<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="n" href="nav.xhtml" properties="x nav"/><item id="x" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="x">{refs}<itemref idref="none"/></spine></package>',
        )
        z.writestr("OEBPS/nav.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><a href="ch0.xhtml#s1">One 1</a></nav><nav><a href="other"> </a></nav></body></html>')
        z.writestr("OEBPS/toc.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text> A </text></navLabel><content src="ch0.xhtml"/><navPoint><navLabel><text>B</text></navLabel><content src="ch1.xhtml"/></navPoint></navPoint></navMap></ncx>')
        for i, c in enumerate(chapters):
            z.writestr(f"OEBPS/ch{i}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>T</title></head><body>{c}</body></html>')
    return out.getvalue()


CASES = {
    "basic": '<section id="s1"><h1>Head</h1><p id="p1">Text <span id="sp1">in</span> 1999</p><ul><li id="li1">x</li></ul></section>',
    "footnotes": '<p>Note<a epub:type="noteref" href="#fn1">1</a> here</p><aside epub:type="footnote" id="fn1"><p>The note</p></aside>',
    "poetry": '<div class="poem"><p>line<br/>two</p></div><p class="verse">a\nb</p>',
    "tables": "<table><tr><th>Year</th><td>c. 1700 AD</td></tr></table>",
    "code": '<pre>raw</pre><p>see <code>x</code> now</p><p class="notranslate">no</p><div translate="NO"><p>no</p></div>',
    "comment": "<!-- c --><p>kept<!-- d --> on</p>",
}


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame([(k, bytearray(archive([v, "<p>second</p>"]))) for k, v in CASES.items()], "book string, content binary")


def test_epub_reading_order(books):
    rows = epub.package(books)
    m, s = epub.manifest(rows), epub.spine(rows)
    order = epub.reading_order(m, s).filter("book = 'basic'").orderBy("pos").collect()
    assert [r["file_path"] for r in order] == ["OEBPS/ch1.xhtml", "OEBPS/ch0.xhtml"]
    assert {r["file_path"] for r in epub.nav_file(m).collect()} == {"OEBPS/nav.xhtml"}
    assert {r["file_path"] for r in epub.ncx_file(m).collect()} == {"OEBPS/toc.ncx"}


def test_epub_tasks(books):
    order = epub.reading_order(*(part(epub.package(books)) for part in (epub.manifest, epub.spine)))
    files = epub.entries(books).withColumnRenamed("entry", "file_path").join(order.select("book", "file_path"), ["book", "file_path"], "left_semi")
    tasks = epub.node_tasks(epub.nodes(files), order).filter("file_path LIKE '%ch0%'").orderBy("book", "order_index").collect()
    by = {}
    for t in tasks:
        by.setdefault(t["book"], []).append((t["tag"], t["segment_type"], t["source_text"]))
    assert by["basic"][1:] == [("h1", "heading", "Head"), ("p", "paragraph", f"Text {P1} ⟦PH:000002⟧"), ("span", "paragraph", "in"), ("li", "list_item", "x")]
    assert ("p", "footnote", "The note") in by["footnotes"]
    assert ("p", "paragraph", f"line{P1}two") in by["poetry"] and ("p", "poetry_line", "a\nb") in by["poetry"]
    assert [k for k, t, _ in by["tables"] if t == "table_cell"] == ["th", "td"]
    assert [x[2] for x in by["code"][1:]] == ["see x now"]
    assert by["comment"][1:] == [("p", "paragraph", "kept on")]
    assert min(t["node_task_id"] for t in tasks) > "NT_000001"


def test_epub_errors(spark):
    bad = spark.createDataFrame([("b", bytearray(archive(["<p>x</p>"], container=False)))], "book string, content binary")
    with pytest.raises(Exception, match="container.xml missing"):
        epub.package(bad).count()


def test_toc(books):
    files = epub.entries(books).withColumnRenamed("entry", "file_path").filter("book = 'basic'")
    kind = F.when(F.col("file_path").endswith("nav.xhtml"), "nav").when(F.col("file_path").endswith(".ncx"), "ncx")
    toc = files.withColumn("kind", kind).filter("kind IS NOT NULL")
    items = epub.toc_tasks(epub.toc_rows(toc)).orderBy("node_task_id").collect()
    assert sorted((r["kind"], r["href"], r["source_text"]) for r in items) == [("nav", "ch0.xhtml#s1", f"One {P1}"), ("ncx", "ch0.xhtml", "A"), ("ncx", "ch1.xhtml", "B")]
    assert epub.toc_hrefs(toc).first()["hrefs"] == ["ch0.xhtml#s1", "other", "ch0.xhtml", "ch1.xhtml"]


def test_rewrite_and_pack(spark, books):
    one = books.filter("book = 'basic'")
    files = epub.entries(one).withColumnRenamed("entry", "file_path")
    found = epub.nodes(files.filter("file_path LIKE '%ch0%'")).filter("tag IN ('p', 'h1')")
    done = found.select("book", "file_path", F.col("order_in_file").alias("order_index"), "node_selector", translate.mock_translation("source_text").alias("text"), "pairs")
    packed = epub.pack(epub.rewrite(files, done).withColumnRenamed("file_path", "entry")).first()["content"]
    with zipfile.ZipFile(io.BytesIO(bytes(packed))) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        text = z.read("OEBPS/ch0.xhtml").decode()
        assert "[中]Head" in text and ">in</" in text and "1999" in text and 'id="p1"' in text
        assert [i.filename for i in z.infolist()][1:] == sorted(i.filename for i in z.infolist()[1:])


def test_write_back_of_text_that_is_no_markup():
    data = b"<r><p>a</p><p>b</p></r>"
    tasks = [{"node_selector": "/r[1]/p[2]", "text": "x & y", "pairs": []}, {"node_selector": "/r[1]/p[9]", "text": "gone", "pairs": []}]
    assert b"<p>a</p><p>x &amp; y</p>" in markup.rewritten(data, tasks)


def test_tolerant_pages(spark):
    page = "<html><body><p>One<p>Two <b>x</b></p><script>no()</script><br>tail</body>"
    rows = spark.createDataFrame([("1", "u", page), ("2", "v", None), ("3", "w", "")], "book string, file_path string, content string")
    got = epub.nodes(rows.filter("book = '1'"), tolerant=True).collect()
    assert [r["tag"] for r in got][:2] == ["p", "p"]
    assert list(markup.node_rows(markup.parse_html(None))) == [] == list(markup.node_rows(markup.parse_html("")))


def test_signatures_and_links(spark, books):
    facts = epub.file_facts(epub.entries(books).filter("entry LIKE '%ch0%'").withColumnRenamed("entry", "file_path"))
    row = facts.filter("book = 'footnotes'").first()
    assert row["parse_error"] is None and row["ids"] == ["fn1"] and row["hrefs"] == ["#fn1"]
    assert 'aside|{"epub:type": "footnote", "id": "fn1"}' in row["signatures"]
    bad = spark.createDataFrame([("b", "f", bytearray(b"<p>"))], "book string, file_path string, content binary")
    assert qa.parse_failures(epub.file_facts(bad)).first()["issue_type"] == "html_parse_fail"


def test_segments(spark):
    tasks = spark.createDataFrame([("b", 1, "One. Two three. Four"), ("b", 2, "next"), ("c", 1, "")], "book string, order_index int, source_text string")
    rows = segments.build_segments(tasks, ["book"], 16, 4).orderBy("book", "segment_id").collect()
    assert [(r["segment_id"], r["source_text"], r["context_prev_source"]) for r in rows[:3]] == [("S000000001", "One. Two three.", ""), ("S000000002", "Four", "ree."), ("S000000003", "next", "Four")]
    whole = segments.build_segments(tasks, ["book"], 16, 0).filter("segment_id = 'S000000002'").first()
    assert whole["context_prev_source"] == "One. Two three."


def test_greedy_batches(spark):
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 5, 20, 1, 1, 1, 9, None])] + [("b", 0, 3)], "book string, o int, n int")
    got = [r["batch_no"] for r in segments.greedy_batches(rows, "book", "o", "n", 10, 3).filter("book = 'a'").orderBy("o").collect()]
    assert got == [0, 0, 1, 2, 2, 2, 3, 3]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_batches_across_stretches(spark, seed):
    rng = random.Random(seed)
    rows = [(k, i, rng.choice([1, 3, 9, 30])) for k, n in (("hot", 400), ("b", 3), ("a", 60), (None, 9)) for i in range(n)]
    want, state = {}, {}
    for k, i, n in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        number, count, size = state.get(k, (0, 0, 0))
        if count and (count >= 5 or size + n > 20):
            number, count, size = number + 1, 0, 0
        state[k] = (number, count + 1, size + n)
        want[k, i] = number
    df = spark.createDataFrame(rows, "book string, o int, n int").repartition(3)
    got = {(r["book"], r["o"]): r["batch_no"] for r in segments.greedy_batches(df, "book", "o", "n", 20, 5).collect()}
    assert got == want
    assert segments.greedy_batches(df.limit(0), "book", "o", "n").count() == 0


def test_merge_chunks_loses_space_between_chunks(spark):
    s = spark.createDataFrame([("n", 1, "x"), ("n", 0, "y"), ("n", 2, "z")], "node string, chunk_index int, segment_id string")
    t = spark.createDataFrame([("x", "Four"), ("y", "three.")], "segment_id string, text string")
    assert segments.merge_chunks(s, t, ["node"], ["segment_id"]).first()["text"] == "three.Four"


def test_term_hits_in_passes(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "The Norman CONQUEST"), (2, "none"), (3, None), (4, "")], "i int, source_text string")
    known = spark.createDataFrame([("norman", "诺曼", True, ""), ("Conquest", "征服", False, ""), ("man", "人", False, ""), ("", "x", False, "")], terms.TERM)
    want = {(1, "norman"), (1, "Conquest"), (1, "man")}
    assert {(r["i"], r["source"]) for r in terms.term_hits(rows, known).collect()} == want
    monkeypatch.setattr(terms, "ANCHORS", 1)
    assert {(r["i"], r["source"]) for r in terms.term_hits(rows, known).collect()} == want
    assert terms.term_hits(rows, known.limit(0)).count() == 0


def test_term_hits_match_plain_search(spark):
    """Short alphabets, so that anchors repeat, overlap and are shared by terms; a term stands once for each text."""
    rng = random.Random(6)
    alphabet = ["a", "b", "B", "É", "中", "😀", " "]
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [(i, word(rng.randrange(60))) for i in range(300)] + [(900, "ab" * 30_000)]
    sources = sorted({word(rng.randrange(1, 12)) for _ in range(400)} | {"ab" * 40, "b" + "ab" * 100})
    known = spark.createDataFrame([(s, f"t{i}", False, "") for i, s in enumerate(sources)], terms.TERM)
    got = sorted((r["i"], r["source"]) for r in terms.term_hits(spark.createDataFrame(texts, "i int, source_text string"), known).collect())
    low = {s: s.lower() for s in sources}
    assert got == sorted((i, s) for i, t in texts for s in sources if low[s] in t.lower())


def test_a_scan_serves_any_number_of_terms(spark):
    """Terms beyond number: the texts are read by one Python node, and go to no other task whole."""
    known = spark.range(200_000).selectExpr("concat('term', id, 'x') AS source", "'t' AS target", "false AS force", "'' AS note")
    rows = spark.range(2_000).selectExpr("id AS i", "concat(repeat('lorem ipsum ', 20), 'Term', id * 7, 'X rest') AS source_text")
    hits = terms.term_hits(rows, known).select("i", "source")
    assert hits.count() == 2_000
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_term_filling(spark):
    base = spark.createDataFrame([("Rome", "", False, ""), ("Oslo", "", False, ""), ("Bern", "伯尔尼", False, "")], terms.TERM)
    replies = spark.createDataFrame([("Rome", "罗马"), ("Oslo", "Oslo")], "source string, reply string")
    got = {r["source"]: (r["target"], r["outcome"]) for r in terms.fill_targets(base, replies).collect()}
    assert got == {"Rome": ("罗马（Rome）", "filled"), "Oslo": ("", "rejected"), "Bern": ("伯尔尼", "kept")}
    cleared = {r["source"]: r["cleared"] for r in terms.normalise_targets(base.withColumn("target", F.lit("latin"))).collect()}
    assert all(cleared.values())
    assert [r["segment_id"] for r in terms.term_segments(base, "source").orderBy("segment_id").collect()] == ["TERM_000001", "TERM_000002", "TERM_000003"]


def test_term_files():
    payload = {"version": 2, "terms": [{"source": "b", "target": "乙", "force": 1}, {"source": "a", "target": "甲"}, {"source": "", "target": "x"}, {"source": "y"}]}
    found = terms.read_terms(payload)
    assert [t["source"] for t in found] == ["b", "a"] and found[0]["force"] is True
    assert terms.fingerprint(found, "2") == terms.fingerprint(found[::-1], "2") and '"source":"a"' in terms.fingerprint(found, "2")


def test_keyed_table(spark, tmp_path, monkeypatch):
    store = memory.KeyedTable(spark, str(tmp_path / "tm"))
    assert store.read().count() == 0
    row = lambda text, at, key="s1": spark.createDataFrame([(key, "h", "c", text, None, "p", at)], "segment_id string, source_hash string, config_hash string, draft_text string, revise_text string, provider string, at string").select("segment_id", "source_hash", "config_hash", "draft_text", "revise_text", "provider", F.to_timestamp("at").alias("updated_at"))
    store.upsert(row("one", "2024-01-01 00:00:00"))
    held = store.read()
    store.upsert(row("old", "2023-01-01 00:00:00").unionByName(row("two", "2023-02-01 00:00:00")))
    assert store.read().first()["draft_text"] == "two" and held.first()["draft_text"] == "one"
    # two writers that began together both stay
    monkeypatch.setattr(memory.time, "time_ns", lambda: 7)
    store.upsert(row("a", "2024-01-01 00:00:00", "x"))
    store.upsert(row("b", "2024-01-02 00:00:00", "y"))
    monkeypatch.undo()
    before = store.read()
    store.compact()
    assert len(store.parts()) == 1 and before.count() == 3
    assert {r["segment_id"]: r["draft_text"] for r in store.read().collect()} == {"s1": "two", "x": "a", "y": "b"}
    store.upsert(row("three", "2020-01-01 00:00:00"))
    store.compact()
    assert {r["segment_id"]: r["draft_text"] for r in store.read().collect()} == {"s1": "three", "x": "a", "y": "b"}
    assert len(list((tmp_path / "tm").glob("p*"))) == 3  # the whole, and what it replaced


def test_memory_levels_match_the_latest_of_all_rows(spark, tmp_path, monkeypatch):
    """Upserts at random: the table is what the last writer of each key left, and each level is merged when it is full."""
    monkeypatch.setattr(memory, "PARTS", 2)
    table = memory.KeyedTable(spark, str(tmp_path / "t"), "k bigint, v string, at bigint", ["k"], "at")
    rng, want, merges = random.Random(4), {}, []
    plain = table._merge
    monkeypatch.setattr(table, "_merge", lambda parts, level: (merges.append((len(parts), level)), plain(parts, level)))
    for n in range(10):
        rows = [(rng.randrange(40), f"{n}-{i}", rng.randrange(5)) for i in range(12)]
        table.upsert(spark.createDataFrame(rows, "k bigint, v string, at bigint"))
        for k in {r[0] for r in rows}:
            want[k] = max((r[2] for r in rows if r[0] == k)), {r[1] for r in rows if r[0] == k}
        got = {r["k"]: r for r in table.read().collect()}
        assert set(got) == set(want) and all(got[k]["at"] == at and got[k]["v"] in names for k, (at, names) in want.items())
    assert merges == [(3, 1)] * 3 + [(3, 2)]
    assert [table.level(p) for p in table.parts()] == [2, 0]
    keys = spark.createDataFrame([(k,) for k in [*list(want)[:7], 999]], "k bigint")
    few = {r["k"]: r["v"] for r in table.lookup(keys).collect()}
    assert few == {r["k"]: r["v"] for r in table.read().collect() if r["k"] in few} and len(few) == 7
    monkeypatch.setattr(memory, "LITERALS", 3)
    assert {r["k"]: r["v"] for r in table.lookup(keys).collect()} == few
    assert table.lookup(keys.filter("k < 0")).count() == 0


def _scanned(df):
    """(files, rows) that the scans of a finished plan have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    files = rows = 0
    todo = [leaves.apply(i) for i in range(leaves.size())]
    while todo:
        node = todo.pop()
        inner = node.getClass().getSimpleName()
        if inner.endswith("QueryStageExec"):
            below = node.plan().collectLeaves()
            todo += [below.apply(i) for i in range(below.size())]
        elif node.metrics().contains("numFiles"):
            files, rows = files + node.metrics().apply("numFiles").value(), rows + node.metrics().apply("numOutputRows").value()
    return files, rows


def test_a_lookup_reads_what_can_hold_its_keys(spark, tmp_path):
    table = memory.KeyedTable(spark, str(tmp_path / "t"), "k bigint, v string, at bigint", ["k"], "at")
    table.upsert(spark.range(200_000).selectExpr("id AS k", "CAST(id AS string) AS v", "id AS at"))
    table.compact()
    table.upsert(spark.range(50).selectExpr("id AS k", "'new' AS v", "id AS at"))
    table.compact()
    table.upsert(spark.range(5, 10).selectExpr("id AS k", "'newer' AS v", "id AS at"))
    every = _scanned(table.read())
    found = table.lookup(spark.createDataFrame([(7,), (199_999,)], "k bigint"))
    some = _scanned(found)
    assert {(r["k"], r["v"]) for r in found.collect()} == {(7, "newer"), (199_999, "199999")}
    assert every[1] >= 200_000 and some[0] <= 4 and some[1] < every[1] / 10


def test_probe(spark):
    text = "This sentence is plainly long enough to count as Latin text."
    seg = spark.createDataFrame([("a", "h", "c", text), ("b", "h", "c", text), ("d", "h", "c", "x"), ("e", "h", "c", "x")], "segment_id string, source_hash string, config_hash string, source_text string")
    tm = spark.createDataFrame([("a", "h", "c", text, ""), ("b", "h", "c", "d", "译"), ("d", "h", "other", "z", None)], "segment_id string, source_hash string, config_hash string, draft_text string, revise_text string")
    states = {r["segment_id"]: (r["state"], r["cached"]) for r in memory.probe(seg, tm).collect()}
    assert states == {"a": ("suspicious", text), "b": ("cached", "译"), "d": ("pending", None), "e": ("pending", None)}
    assert {r["segment_id"]: r["cached"] for r in memory.probe(seg, tm, prefer_revise=False).collect()}["b"] == "d"


ENGLISH = "This sentence is plainly long enough to count as Latin text."


class Flaky:
    """Gives texts back as they are until its third call."""

    calls = 0

    def translate(self, rows, hits):
        self.calls += 1
        return {r["segment_id"]: r["source_text"] if self.calls < 3 else f"译{r['source_text']}" for r in rows}

    def revise(self, rows, drafts, hits):
        return drafts


class Careless(Flaky):
    def translate(self, rows, hits):
        return {r["segment_id"]: "译" for r in rows}


def test_provider_rounds(spark):
    rows = [{"segment_id": "1", "source_text": f"{ENGLISH} {P1}"}]
    drafts, texts, rounds = translate.run_batch(Flaky(), rows, [])
    assert texts["1"] == f"译{ENGLISH} {P1}" and rounds == 3
    assert translate.run_batch(Careless(), rows, [])[1:] == ({"1": f"译 {P1}"}, 1)
    rows = [{"segment_id": "1", "source_text": f"a {P1}"}]
    assert translate.run_batch(translate.MockProvider(), rows, [])[1:] == ({"1": f"[中]a {P1}"}, 1)
    with pytest.raises(ValueError):
        translate.translate(spark.createDataFrame([], "batch_key string, segment_id string, source_text string, hits string"), "absent")
    assert translate.plan().maker()().revise([], {"1": "x"}, []) == {"1": "x"}
    batch = spark.createDataFrame([("k", "1", "t", "[]")], "batch_key string, segment_id string, source_text string, hits string")

    class Broken:
        def translate(self, rows, hits):
            raise OSError("down")

    assert "down" in translate.translate(batch, Broken).first()["error"]
    bad = spark.createDataFrame([("1", f"a {P1}", "x"), ("2", "b", "译")], "segment_id string, source_text string, translated string")
    assert [(r["segment_id"], r["revise_text"]) for r in translate.repair(bad).collect()] == [("1", f"[中]a {P1}")]


class Marks:
    def __init__(self, model, settings):
        self.model = model

    def translate(self, rows, hits):
        return {r["segment_id"]: f"{self.model}译{r['source_text']}" for r in rows}

    def revise(self, rows, drafts, hits):
        return {i: f"{self.model}校{t}" for i, t in drafts.items()}


def test_provider_plans(monkeypatch):
    step, plan = translate.Step, translate.plan
    assert plan() == translate.Plan(step("mock"), None)
    assert plan("openai", "m", draft="deepseek") == translate.Plan(step("openai", "m"), step("openai", "m"))
    assert plan("deepseek", "m", revise="none") == translate.Plan(step("deepseek", "m"), None)
    assert plan("mixed", "m", revise_model="r") == translate.Plan(step("openai", "m"), step("deepseek", "r"))
    assert plan("mixed", "m", "mock", "none", "d") == translate.Plan(step("mock", "d"), None)
    assert plan("dashscope-mt", "qwen-mt-plus") == translate.Plan(step("dashscope-mt", "qwen-mt-plus"), None)
    with pytest.raises(ValueError):
        plan("mixed", draft="absent").maker()
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(RuntimeError, match="OPENAI_API_KEY is not set"):
        plan("openai", "m").maker()
    monkeypatch.setenv("OPENAI_API_KEY", "secret")
    make = plan("openai", "m", revise="none").maker()
    monkeypatch.delenv("OPENAI_API_KEY")
    assert make().draft.key == "secret" and "secret" not in repr(make().draft)
    for name in ("one", "two"):
        monkeypatch.setitem(translate.PROVIDERS, name, Marks)
    rows = [{"segment_id": "1", "source_text": "a"}]
    both = plan("mixed", "m", "one", "two", "d", "r").maker()()
    assert translate.run_batch(both, rows, [])[1] == {"1": "r校d译a"}
    assert [translate.exit_code(True), translate.exit_code(False), translate.exit_code(None, failed=True), translate.exit_code(None, cancelled=True)] == [0, 2, 1, 130]


def test_calls_in_flight(spark):
    rows = spark.createDataFrame([(str(k), str(k), "a", "[]") for k in range(40)], "batch_key string, segment_id string, source_text string, hits string")
    done = translate.translate(rows, "mock", in_flight=3)
    assert done.rdd.getNumPartitions() == 3 and done.count() == 40


def test_payload_and_replies(spark):
    seg = spark.createDataFrame([("k", "1", 1, "paragraph", "a", "d", [P1], "[]")], "batch_key string, segment_id string, order_index int, segment_type string, source_text string, draft_text string, placeholders array<string>, hits string")
    sent = json.loads(translate.batch_payload(seg, "concise_cn").first()["payload"])
    assert sent["style_guide"] == "concise_zh_hans" and sent["segments"] == [{"id": "1", "type": "paragraph", "text": "a", "constraints": {"do_not_translate": [P1]}}]
    revised = json.loads(translate.batch_payload(seg, "x", revise=True).first()["payload"])
    assert revised["segments"][0]["draft"] == "d" and revised["task"] == "revise_translation"
    expected = spark.createDataFrame([("k", "1"), ("m", "1"), ("n", "1")], "batch_key string, id string")
    replies = spark.createDataFrame([("k", '```\n{"results":[{"id":"1","translated_text":"x"}]}```'), ("m", '{"results":[{"id":"1"}]}'), ("n", "no json")], "batch_key string, reply string")
    got = {r["batch_key"]: r["error"] for r in translate.reply_errors(expected, replies).collect()}
    assert got["k"] is None and got["m"] and got["n"]


def test_numbers_in_stretches(spark):
    rows = spark.createDataFrame([(["a", "b", None][k % 7 // 3], (k * 37) % 101) for k in range(101)], "book string, k int")
    ids = lambda f: sorted(map(str, f(rows, ["book"], ["k"], "N", 4).collect()))
    assert ids(segments.numbered_in_stretches) == ids(segments.numbered)
    assert segments.numbered_in_stretches(rows.limit(0), ["book"], ["k"], "N", 4).count() == 0


def test_segment_issues_are_those_of_the_checks(spark):
    rows = spark.createDataFrame(
        [("1", f"x {P1}", "y"), ("2", "", None), ("3", ENGLISH, f" {ENGLISH}"), ("4", "See Rome now", "看"), ("5", "See Rome now", "看 罗马（Rome）")], "segment_id string, source_text string, translated string"
    )
    known = spark.createDataFrame([("Rome", "罗马（Rome）", True, ""), ("now", "现在", False, "")], terms.TERM)
    checks = (qa.empty_translation(rows), qa.placeholder_mismatch(rows), qa.same_as_source(rows), qa.term_inconsistency(rows, known))
    want = sorted(map(str, (r for k, c in enumerate(checks) for r in c.withColumn("check_order", F.lit(k)).collect())))
    assert sorted(map(str, qa.segment_issues(rows, known).select(*qa.COLUMNS, "check_order").collect())) == want and len(want) == 4


def test_gate_report_and_summary(spark):
    rows = spark.createDataFrame([("1", "x", "y"), ("2", "", "")], "segment_id string, source_text string, translated string")
    issues = qa.all_issues(qa.empty_translation(rows), qa.placeholder_mismatch(rows))
    assert qa.gate(issues, 2).first()["passed"] is False
    assert qa.gate(issues.limit(0), 2).first()["passed"] is True
    assert "- empty_translation: 1" in qa.summary(issues, 2)
    lines = [json.loads(r["line"]) for r in qa.report(issues, 2).orderBy("part").collect()]
    assert lines[0]["error_count"] == 1 and lines[1]["segment_id"] == "2"
    assert qa.runtime_failure(rows.withColumn("message", F.lit("m"))).first()["issue_type"] == "runtime_fail"


def test_settings(spark, tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"style": " LITERARY_CN ", "qa": {"warn_min_cap": 3, "unknown": 1}, "other": 2}')
    s = config.read_settings(spark, str(file))
    assert s["style"] == "literary_cn" and s["qa.warn_min_cap"] == 3 and s["qa.warn_ratio_limit"] == 0.005
    (tmp_path / "c.yaml").write_text("style: nonsense\nllm:\n  max_retries: 2\n")
    t = config.read_settings(spark, str(tmp_path / "c.yaml"))
    assert t["style"] == "faithful_literal" and t["llm.max_retries"] == 2 and len(t) == len(config.DEFAULTS)
    (tmp_path / "empty.yaml").write_text("")
    assert dict(config.read_settings(spark, str(tmp_path / "empty.yaml"))) == dict(config.read_settings(spark, None))
    with pytest.raises(FileNotFoundError):
        config.read_settings(spark, str(tmp_path / "none.yaml"))
    for bad in ({"llm": {"max_retries": "two"}}, {"translate_toc": 1}, {"qa": {"warn_min_cap": -1}}, {"llm": {"retry_backoff_seconds": [1, "x"]}}, {"llm": {"max_retries": True}}):
        with pytest.raises(ValueError):
            config.Settings(bad)
    key = lambda s, terms, plan: config.fingerprint(settings=s, terms={"all": terms}, provider=plan.values())
    keys = [key(s, "t", translate.plan()), key(s, "u", translate.plan()), key(t, "t", translate.plan()), key(s, "t", translate.plan("openai", "m")), key(s, "t", translate.plan("openai", "m", revise="none"))]
    assert len(set(keys)) == 5 and all(len(k) == 64 for k in keys)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)] + [(500, k) for k in range(501, 560)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {150: 100, 200: 100} | {k: 500 for k in range(501, 560)}
    assert components(links.limit(0)).count() == 0


def test_stage_table(spark):
    assert scratch_dir(spark)
    staged = stage_table(spark.range(5).withColumn("k", F.col("id") % 2).groupBy("k").count(), "t")
    assert staged.count() == 2 and staged.count() == 2


def test_staged_tables_of_a_step_go_with_it(spark):
    from glossaflow.plans import scratch

    before = list(scratch._paths)
    with scratch.staged_here(drop=False) as held:
        first = stage_table(spark.range(3), "first")
        with scratch.staged_here():
            assert stage_table(spark.range(4), "second").count() == 4
        assert first.count() == 3 and len(held) == 2
    assert len(scratch._paths) == len(before) + 1
    scratch.drop_staged(held)
    assert scratch._paths == before and not held


def test_streaming_resume(spark, tmp_path):
    source = tmp_path / "in"
    schema = "book string, order_index int, segment_id string, source_text string"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(source))
    store = memory.KeyedTable(spark, str(tmp_path / "tm"))
    put([("b", 1, "s1", "one"), ("b", 2, "s2", "two")])
    run = lambda: resume(spark.readStream.schema(schema).parquet(str(source)), store, "c", str(tmp_path / "cp")).awaitTermination(120)
    from glossaflow.plans import scratch

    before = list(scratch._paths)
    run()
    put([("b", 3, "s3", "three")])
    run()
    assert scratch._paths == before
    assert {r["segment_id"]: r["revise_text"] for r in store.read().collect()} == {"s1": "[中]one", "s2": "[中]two", "s3": "[中]three"}
    for held in (store.read(), store):
        assert translate_missing(spark.read.schema(schema).parquet(str(source)), held, "c").count() == 0
