"""EPUB archives as tables, and back.

``spark.read.format("binaryFile")`` gives whole archives; everything below
works on its rows (path, content), one archive at a time in a task, and no
file is unpacked to disk. Texts of all kinds come out as ordinary rows.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.functions import text as T
from glossaflow.functions.batches import BATCH_BYTES, BATCH_ROWS, record_batches, values_of
from glossaflow.functions.masking import PAIRS, mask_text_column
from glossaflow.plans.scratch import bounded_batches
from glossaflow.sources import markup

CONTAINER = "META-INF/container.xml"
NCX_TYPE = "application/x-dtbncx+xml"
BOOK = "book string, content binary"
ENTRY = "book string, entry string, content binary"
MANIFEST = "book string, pos int, item_id string, href string, media_type string, properties string, opf_dir string, toc_id string"
NODE = f"book string, file_path string, order_in_file int, node_selector string, tag string, classes string, footnote boolean, source_text string, pairs {PAIRS}"
TOC = "book string, file_path string, pos int, href string, label_text string, node_selector string, kind string"


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(book, content) of the archives at a path or pattern."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("book"), "content")


def _each(books: DataFrame, columns: list[str], schema: str, rows) -> DataFrame:
    """What ``rows`` makes of each row; both ways in batches that are bounded in rows and bytes, so that a worker holds no more of a larger table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches((row for values in values_of(batches) for row in rows(*values)), schema)

    bounded_batches(books.sparkSession, BATCH_ROWS, BATCH_BYTES)
    return books.select(*columns).mapInArrow(run, schema)


def entries(books: DataFrame) -> DataFrame:
    """A row for each file in each archive."""

    def rows(book: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if not name.endswith("/"):
                    yield book, name, z.read(name)

    return _each(books, ["book", "content"], ENTRY, rows)


def files_of(books: DataFrame, wanted: DataFrame) -> DataFrame:
    """(book, file_path, content) of the files of archives that ``wanted`` (book, file_path) names; no other is inflated or leaves its task."""

    def rows(book: str, content: bytes, names: list[str]) -> Iterator[tuple]:
        held = frozenset(names)
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if name in held and not name.endswith("/"):
                    yield book, name, z.read(name)

    named = wanted.groupBy("book").agg(F.collect_set("file_path").alias("names"))  # the files of one archive
    return _each(books.join(named, "book"), ["book", "content", "names"], "book string, file_path string, content binary", rows)


def _root_file(book: str, container: bytes | None) -> str:
    if container is None:
        raise ValueError(f"Invalid EPUB: {CONTAINER} missing in {book}")
    root = markup.parse_xml(container)
    path = next((n.get("full-path") for n in root.iter() if isinstance(n.tag, str) and markup.name_of(n.tag) == "rootfile"), None)
    if not path:
        raise ValueError(f"Invalid EPUB: no rootfile in {CONTAINER} of {book}")
    return path


def _package(book: str, content: bytes) -> tuple[str, bytes | None]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        path = _root_file(book, z.read(CONTAINER) if CONTAINER in names else None)
        return path, z.read(path) if path in names else None


def _under(root: ET.Element, parent: str, name: str) -> list[ET.Element]:
    return [n for p in root if isinstance(p.tag, str) and markup.name_of(p.tag) == parent for n in p if isinstance(n.tag, str) and markup.name_of(n.tag) == name]


def _package_rows(book: str, path: str, content: bytes | None) -> Iterator[tuple]:
    if content is None:
        raise ValueError(f"Invalid EPUB: OPF file missing: {path} in {book}")
    root = markup.parse_xml(content)
    toc = next((p.get("toc") for p in root if isinstance(p.tag, str) and markup.name_of(p.tag) == "spine"), None)
    for i, n in enumerate(_under(root, "manifest", "item")):
        yield book, i, n.get("id") or "", n.get("href") or "", n.get("media-type") or "", n.get("properties") or "", posixpath.dirname(path), toc or "", "item", None
    for i, n in enumerate(_under(root, "spine", "itemref")):
        if n.get("idref"):
            yield book, i, None, None, None, None, None, None, "itemref", n.get("idref")


PACKAGE = f"{MANIFEST}, part string, idref string"


def package(books: DataFrame) -> DataFrame:
    """Rows of the package file of each archive, of one opening: ``part`` says of which of the two tables below."""
    return _each(books, ["book", "content"], PACKAGE, lambda book, content: _package_rows(book, *_package(book, content)))


def package_of(files: DataFrame) -> DataFrame:
    """The same of files (book, file_path, content), of which only the container and the package file go to Python."""
    held = files.groupBy("book").agg(F.max(F.when(F.col("file_path") == CONTAINER, F.col("content"))).alias("container"))
    roots = _each(held, ["book", "container"], "book string, file_path string", lambda book, container: [(book, _root_file(book, container))])
    found = roots.join(files.select("book", "file_path", "content"), ["book", "file_path"], "left")
    return _each(found, ["book", "file_path", "content"], PACKAGE, _package_rows)


def manifest(rows: DataFrame) -> DataFrame:
    """The items of rows of ``package``."""
    return rows.filter("part = 'item'").drop("part", "idref")


def spine(rows: DataFrame) -> DataFrame:
    """The reading order of rows of ``package``."""
    return rows.filter("part = 'itemref'").select("book", "pos", "idref")


def item_path(c: str = "href"):
    """Path in the archive of an href of the manifest, dot segments resolved."""
    joined = F.when(F.col("opf_dir") == "", F.col(c)).otherwise(F.concat("opf_dir", F.lit("/"), c))
    keep = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s.isin(".", ""), acc).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), keep), "/")


def reading_order(manifest_rows: DataFrame, spine_rows: DataFrame) -> DataFrame:
    """(book, pos, idref, file_path) of spine entries that the manifest has."""
    items = manifest_rows.groupBy("book", "item_id").agg(F.max_by(F.struct("href", "opf_dir"), "pos").alias("m")).select("book", F.col("item_id").alias("idref"), "m.href", "m.opf_dir")
    return spine_rows.join(items, ["book", "idref"]).select("book", "pos", "idref", F.when(F.col("href") != "", item_path()).alias("file_path"))


def nav_file(manifest_rows: DataFrame) -> DataFrame:
    """(book, file_path): the first item that is the navigation document."""
    rows = manifest_rows.filter(F.array_contains(F.split("properties", r"\s+"), "nav") & (F.col("href") != ""))
    return rows.groupBy("book").agg(F.min_by(item_path(), "pos").alias("file_path"))


def ncx_file(manifest_rows: DataFrame) -> DataFrame:
    """(book, file_path): the item the spine names, else the first of the NCX type."""
    rows = manifest_rows.filter("href <> ''").withColumn("named", (F.col("toc_id") != "") & (F.col("item_id") == F.col("toc_id")))
    rows = rows.filter(F.col("named") | (F.col("media_type") == NCX_TYPE))
    return rows.groupBy("book").agg(F.min_by(item_path(), F.struct(~F.col("named"), "pos")).alias("file_path"))


def nodes(files: DataFrame, titles: bool = True, tolerant: bool = False) -> DataFrame:
    """Rows to translate of files (book, file_path, content)."""

    def rows(book: str, file_path: str, content) -> Iterator[tuple]:
        if tolerant:
            root = markup.parse_html(content.decode("utf-8", "replace") if isinstance(content, bytes) else content)
        else:
            root = markup.parse_xml(content)
        for i, n in enumerate(markup.node_rows(root, titles)):
            yield book, file_path, i, n["node_selector"], n["tag"], n["classes"], n["footnote"], n["source_text"], n["pairs"]

    return _each(files, ["book", "file_path", "content"], NODE, rows)


def node_tasks(node_rows: DataFrame, order: DataFrame) -> DataFrame:
    """Typed and numbered tasks in reading order; order: book, file_path, pos."""
    kind = F.when(F.col("footnote"), "footnote").when(T.is_poetry("classes"), "poetry_line").otherwise(T.segment_type("tag"))
    lines = F.when(T.is_poetry("classes"), T.line_count("source_text"))
    rows = node_rows.join(order.select("book", "file_path", "pos"), ["book", "file_path"])
    rows = rows.withColumns({"segment_type": kind, "poetry_line_count": lines, "order_index": F.row_number().over(_reading())})
    return rows.withColumn("node_task_id", T.seq_id("NT_", "order_index", 6))  # which is dense in each book


def _reading():
    from pyspark.sql import Window

    return Window.partitionBy("book").orderBy("pos", "order_in_file")


def toc_rows(files: DataFrame) -> DataFrame:
    """Labelled entries of files (book, file_path, content, kind: nav or ncx)."""

    def rows(book: str, file_path: str, content: bytes, kind: str) -> Iterator[tuple]:
        root = markup.parse_xml(content)
        for i, t in enumerate(markup.nav_items(root) if kind == "nav" else markup.ncx_items(root)):
            yield book, file_path, i, t["href"], t["label_text"], t["node_selector"], t["kind"]

    return _each(files, ["book", "file_path", "content", "kind"], TOC, rows)


def toc_tasks(items: DataFrame) -> DataFrame:
    from glossaflow.operators.segments import numbered

    rows = items.withColumn("masked", mask_text_column(F.col("label_text")))
    rows = rows.select("*", F.col("masked.text").alias("source_text"), F.col("masked.pairs").alias("pairs"), F.lit("toc").alias("segment_type")).drop("masked")
    return numbered(rows, ["book"], [F.col("kind").desc(), "pos"], "NT_TOC_", 6, "node_task_id")


def toc_hrefs(files: DataFrame) -> DataFrame:
    """(book, hrefs): all links of the nav, then of the ncx, in order."""

    def rows(book: str, content: bytes, kind: str) -> Iterator[tuple]:
        root = markup.parse_xml(content)
        for i, h in enumerate(markup.nav_hrefs(root) if kind == "nav" else markup.ncx_hrefs(root)):
            yield book, 0 if kind == "nav" else 1, i, h

    found = _each(files, ["book", "content", "kind"], "book string, part int, pos int, href string", rows)
    return found.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "href"))), lambda x: x["href"]).alias("hrefs"))


def file_facts(files: DataFrame) -> DataFrame:
    """Per file (book, file_path, content): parse_error, ids, hrefs and signatures."""

    def rows(book: str, file_path: str, content: bytes) -> Iterator[tuple]:
        root, why = markup.parsed(content)
        ids, hrefs = markup.anchor_rows(root) if root is not None else ([], [])
        yield book, file_path, why, ids, hrefs, markup.signatures(root) if root is not None else []

    schema = "book string, file_path string, parse_error string, ids array<string>, hrefs array<string>, signatures array<string>"
    return _each(files, ["book", "file_path", "content"], schema, rows)


def _root(content, tolerant: bool) -> ET.Element:
    if not tolerant:
        return markup.parse_xml(content)
    return markup.parse_html(content if isinstance(content, str) else content.decode("utf-8", "replace"))


def signatures(files: DataFrame, tolerant: bool = False) -> DataFrame:
    """(book, file_path, signatures) of files (book, file_path, content)."""
    rows = lambda book, file_path, content: [(book, file_path, markup.signatures(_root(content, tolerant)))]
    return _each(files, ["book", "file_path", "content"], "book string, file_path string, signatures array<string>", rows)


def text_nodes(files: DataFrame, tolerant: bool = False) -> DataFrame:
    def rows(book: str, file_path: str, content) -> Iterator[tuple]:
        for t in markup.text_rows(_root(content, tolerant)):
            yield book, file_path, t

    return _each(files, ["book", "file_path", "content"], "book string, file_path string, text string", rows)


def rewrite(files: DataFrame, tasks: DataFrame, plain_tag: str = "") -> DataFrame:
    """Files (book, file_path, content) with translations put in.

    tasks: book, file_path, order_index, node_selector, text, pairs. Files
    without tasks stay as they are.
    """
    per_file = tasks.groupBy("book", "file_path").agg(F.array_sort(F.collect_list(F.struct("order_index", "node_selector", "text", "pairs"))).alias("tasks"))

    def rows(book: str, file_path: str, content: bytes, tasks) -> Iterator[tuple]:
        todo = [] if tasks is None else [{"node_selector": t["node_selector"], "text": t["text"], "pairs": list(t["pairs"] if t["pairs"] is not None else ())} for t in tasks]
        yield book, file_path, markup.rewritten(content, todo, plain_tag) if todo else content

    joined = files.join(per_file, ["book", "file_path"], "left")
    return _each(joined, ["book", "file_path", "content", "tasks"], "book string, file_path string, content binary", rows)


def pack(files: DataFrame) -> DataFrame:
    """(book, content): archives of files (book, entry, content).

    ``mimetype`` comes first and stored, the others follow by path, deflated.
    An archive is made in one task, for it is one file.
    """

    def archives(rows: Iterator[tuple]) -> Iterator[tuple]:
        for book, files_of in groupby(rows, key=itemgetter(0)):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for _, name, content in files_of:
                    info = zipfile.ZipInfo(name)  # a fixed date: equal files give equal archives
                    info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
                    z.writestr(info, content)
            yield book, out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches(archives(values_of(batches)), BOOK)

    bounded_batches(files.sparkSession, BATCH_ROWS, BATCH_BYTES)
    rows = files.select("book", "entry", "content").repartition("book")
    return rows.sortWithinPartitions("book", F.col("entry") != "mimetype", F.split("entry", "/")).mapInArrow(run, BOOK)
