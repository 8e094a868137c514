"""Archives as files: read by ranges, written once and whole."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from glossaflow.sources import archive_files as A
from glossaflow.sources import epub, store
from tests.test_engine import archive

CHAPTERS = ["<p>one</p>", "<p>two</p>"]


@pytest.fixture
def folder(tmp_path):
    for k in range(5):
        (tmp_path / f"b{k}.epub").write_bytes(archive([*CHAPTERS, f"<p>{k}</p>"]))
    (tmp_path / "note.txt").write_text("no archive")
    return tmp_path


def test_reads_what_zipfile_reads(spark, folder):
    want = set()
    for k in range(5):
        with zipfile.ZipFile(folder / f"b{k}.epub") as z:
            want |= {(f"{folder}/b{k}.epub", n, z.read(n)) for n in z.namelist()}
    for path in (str(folder), f"{folder}/*.epub", f"file://{folder}/b?.epub"):
        got = A.read_entries(spark, path)
        assert {(r["book"], r["entry"], bytes(r["content"])) for r in got.collect()} == want
    small = spark.read.format("epub").option("splitBytes", "300").load(str(folder))
    assert small.rdd.getNumPartitions() > 5
    assert {(r["book"], r["entry"], bytes(r["content"])) for r in small.collect()} == want
    assert A.read_entries(spark, f"{folder}/none*.epub").count() == 0
    (folder / "broken.epub").write_bytes(b"no archive")
    with pytest.raises(Exception, match="Invalid EPUB.*broken.epub"):
        A.read_entries(spark, str(folder)).count()
    with pytest.raises(Exception, match="FileNotFoundError"):
        A.read_entries(spark, f"{folder}/gone").count()


def test_entries_by_pattern(spark, folder):
    rows = A.read_entries(spark, str(folder), ["META-INF/*", "*.opf"])
    assert {r["entry"] for r in rows.collect()} == {epub.CONTAINER, "OEBPS/content.opf"} and rows.count() == 10
    every = A.read_entries(spark, str(folder))
    assert every.filter(F.col("entry") == "mimetype").count() == 5 and every.count() > 20


def test_a_pattern_saves_the_ranges_of_other_entries(tmp_path):
    with zipfile.ZipFile(tmp_path / "large.epub", "w", zipfile.ZIP_STORED) as z:
        z.writestr("mimetype", "application/epub+zip")
        for k in range(20):
            z.writestr(f"image{k}", os.urandom(400_000))
        z.writestr("last.xhtml", "<p/>")
    seen = []
    plain = store.opened

    class Counted:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, path):
            raw = self.fs.open_input_file(path)

            class File(io.RawIOBase):
                readable = seekable = lambda self: True
                seek = lambda self, *a: raw.seek(*a)
                tell = lambda self: raw.tell()

                def readinto(self, b):
                    data = raw.read(len(b))
                    seen.append(len(data))
                    b[: len(data)] = data
                    return len(data)

            return File()

    reader = A.ArchiveReader({"path": str(tmp_path), "entries": "last.*"})
    try:
        store.opened = lambda path: (Counted(plain(path)[0]), plain(path)[1])
        parts = [A.Share([(str(tmp_path / "large.epub"), 8_000_000, 0, 1)])]
        assert [b.column(1).to_pylist() for p in parts for b in reader.read(p)] == [["last.xhtml"]]
    finally:
        store.opened = plain
    assert sum(seen) < 400_000


def test_writes_one_whole_file_a_book(spark, folder, tmp_path):
    out = tmp_path / "out"
    rows = A.read_entries(spark, f"{folder}/*.epub")
    A.write_books(rows, str(out))
    assert sorted(os.listdir(out)) == [f"b{k}.epub" for k in range(5)]
    for k in range(5):
        with zipfile.ZipFile(out / f"b{k}.epub") as z, zipfile.ZipFile(folder / f"b{k}.epub") as old:
            assert z.testzip() is None
            first = z.infolist()[0]
            assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED and not first.flag_bits & 8
            assert {n: z.read(n) for n in z.namelist()} == {n: old.read(n) for n in old.namelist()}
            assert z.namelist()[1:] == sorted(z.namelist()[1:], key=lambda n: n.split("/"))
    again = {r["book"]: r["n"] for r in A.read_entries(spark, str(out)).groupBy("book").agg(F.count("*").alias("n")).collect()}
    assert len(again) == 5
    A.write_books(rows.filter(F.col("book").endswith("b1.epub")), str(out))
    assert os.listdir(out) == ["b1.epub"]
    A.write_books(rows.filter(F.col("book").endswith("b2.epub")), str(out), mode="append")
    assert sorted(os.listdir(out)) == ["b1.epub", "b2.epub"]
    A.write_books(rows.filter(F.col("book").endswith("b3.epub")), str(out), name="mine.epub")
    assert sorted(os.listdir(out)) == ["b1.epub", "b2.epub", "mine.epub"]


def test_a_failed_task_leaves_nothing(spark, folder, tmp_path):
    out = tmp_path / "out"
    rows = A.read_entries(spark, f"{folder}/*.epub")
    A.write_books(rows.filter(F.col("book").endswith("b0.epub")), str(out))

    @F.udf("binary")
    def fails(book, content):
        if book.endswith("b3.epub"):
            raise RuntimeError("lost")
        return content

    with pytest.raises(Exception, match="lost"):
        A.write_books(rows.withColumn("content", fails("book", "content")), str(out))
    assert os.listdir(out) == ["b0.epub"]


def test_names_and_unfit_rows(spark, tmp_path):
    assert A.file_names(["/a/x.epub", "/b/x.epub", "y", "z.v1", "/b/x-2.epub"]) == {"/a/x.epub": "x.epub", "/b/x-2.epub": "x-2.epub", "/b/x.epub": "x-3.epub", "y": "y.epub", "z.v1": "z.v1.epub"}
    with pytest.raises(ValueError, match="2 books"):
        A.file_names(["a", "b"], "one.epub")
    make = lambda rows: spark.createDataFrame(rows, A.SCHEMA)
    for rows, why in (([("a", "x", b""), ("a", "x", b"1")], "entry twice"), ([("a", None, b"")], "no entry")):
        with pytest.raises(Exception, match=why):
            A.write_books(make(rows), str(tmp_path / "out"))
    A.write_books(make([("a", "x", None)]), str(tmp_path / "out"))
    with zipfile.ZipFile(tmp_path / "out" / "a.epub") as z:
        assert z.read("x") == b""
    A.write_books(make([]), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []


def test_stores_and_their_names(tmp_path, monkeypatch):
    (tmp_path / "a.epub").write_bytes(b"x")
    assert [f.path for f in store.listed(f"file:{tmp_path}/", ".epub")] == [f"{tmp_path}/a.epub"]
    plain = store.opened
    monkeypatch.setattr(store, "opened", lambda path: (plain("/")[0], path.removeprefix("hdfs://host:8020")))
    for path in (f"hdfs://host:8020{tmp_path}", f"hdfs://host:8020{tmp_path}/*.epub"):
        assert [f.path for f in store.listed(path, ".epub")] == [f"hdfs://host:8020{tmp_path}/a.epub"]
    monkeypatch.undo()
    assert store.known("/x") and not store.known("nowhere://x/y")


def _written(writer, books):
    import pyarrow as pa

    rows = [pa.array([str(b) for b in books]), pa.array(["a.xhtml"] * len(books)), pa.array([b"x"] * len(books), pa.binary())]
    return writer.write(iter([pa.RecordBatch.from_arrays(rows, names=["book", "entry", "content"])]))


def test_the_driver_holds_no_list_of_files(tmp_path):
    import pickle
    import tracemalloc

    n, tasks = 12_000, 3
    writer = A.ArchiveWriter({"path": str(tmp_path)}, True)
    messages = [_written(writer, range(k, n, tasks)) for k in range(tasks)]
    assert sum(len(pickle.dumps(m)) for m in messages) < 100 * n / 10
    tracemalloc.start()
    try:
        writer.commit(messages)
        assert tracemalloc.get_traced_memory()[1] < 500 * n
        tracemalloc.reset_peak()
        shares = A.ArchiveReader({"path": str(tmp_path)}).partitions()
        assert tracemalloc.get_traced_memory()[1] < 100 * n
    finally:
        tracemalloc.stop()
    assert sum(len(pickle.dumps(s)) for s in shares) < 20 * n
    assert sorted(os.listdir(tmp_path)) == sorted(f"{k}.epub" for k in range(n))
    assert sorted(path for s in shares for path, *_ in s.parts) == sorted(f"{tmp_path}/{k}.epub" for k in range(n))


def test_names_are_given_as_books_are_merged():
    import random

    def merged(books):
        rows = [(A._stem(b), b, f"file of {b}") for b in sorted(books, key=lambda b: (A._stem(b), b))]
        n, mixed = A.mixed_families(rows)
        assert n == len(books)
        return {file.removeprefix("file of "): name for file, name in A.names_in_order(rows, mixed)}, mixed

    few = ["/a/x.epub", "/b/x.epub", "y", "z.v1", "/b/x-2.epub"]
    assert merged(few) == (A.file_names(few), {(".epub", "x", ())})
    assert merged([f"/{k}/x.epub" for k in range(50)])[1] == set()  # all of one name need no list
    rng = random.Random(4)
    for _ in range(3000):
        parts = [(rng.choice("abc"), rng.choice(["x", "x-1", "y", "-2", ""]), rng.choice(["", "", "-2", "-3", "-2-2", "-02", "-2\n", "-12345678901"]), rng.choice(["", ".epub", ".epub", ".EPUB", ".v1"])) for _ in range(rng.randint(1, 9))]
        books = list({f"/{folder}/{stem}{suffix}{ending}" for folder, stem, suffix, ending in parts})
        names = merged(books)[0]
        assert names == A.file_names(books) and len(set(names.values())) == len(books)


def test_overwriting_removes_old_archives_of_the_folder_alone(tmp_path):
    out = tmp_path / "o[u]t"  # a folder's name is no pattern
    (out / "below").mkdir(parents=True)
    for old in ("old.epub", "1.epub", "below/kept.epub", "kept.txt"):
        (out / old).write_bytes(b"old")
    writer = A.ArchiveWriter({"path": str(out)}, True)
    writer.commit([_written(writer, [1, "/a/x"]), None, _written(writer, ["/b/x", "x-2"]), _written(writer, [])])
    assert sorted(os.listdir(out)) == ["1.epub", "below", "kept.txt", "x-2-2.epub", "x-2.epub", "x.epub"]
    assert os.listdir(out / "below") == ["kept.epub"] and (out / "1.epub").read_bytes() != b"old"


def test_nothing_is_moved_if_a_book_has_two_tasks_or_a_list_is_cut(tmp_path):
    (tmp_path / "old.epub").write_bytes(b"old")
    writer = A.ArchiveWriter({"path": str(tmp_path)}, True)
    messages = [_written(writer, ["a", "b"]), _written(writer, ["b", "c"])]
    with pytest.raises(ValueError, match="two tasks: b"):
        writer.commit(messages)
    writer.abort(messages)
    assert os.listdir(tmp_path) == ["old.epub"]
    message = _written(writer, ["a", "b"])
    (cut,) = tmp_path.glob("_temporary-*/*/books")
    cut.write_bytes(cut.read_bytes()[:-3])
    with pytest.raises(ValueError, match="2 books were written, 1"):
        writer.commit([message])
    writer.abort([message])
    assert os.listdir(tmp_path) == ["old.epub"]


def test_lists_longer_than_what_is_read_at_a_time(tmp_path, monkeypatch):
    monkeypatch.setattr(A, "LISTS_BYTES", 1)
    writer = A.ArchiveWriter({"path": str(tmp_path)}, False)
    books = ["é" * 100 + f" {k}\n{k}" for k in range(60)]
    writer.commit([_written(writer, books[:40]), _written(writer, books[40:])])
    assert sorted(os.listdir(tmp_path)) == sorted(f"{b}.epub" for b in books)


def test_files_are_listed_as_arrow_lists_them(tmp_path):
    from pyarrow import fs

    for name in ("a.epub", "b/c.epub", "b/d/e.epub", "b/d/f.txt", "g.epub/h.epub", "far/i.epub"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(name.encode())
    (tmp_path / "t/link.epub").symlink_to(tmp_path / "t/a.epub")
    (tmp_path / "t/links").symlink_to(tmp_path / "t/far")
    (tmp_path / "t/gone.epub").symlink_to(tmp_path / "nowhere")
    os.mkfifo(tmp_path / "t/pipe.epub")
    infos = fs.LocalFileSystem().get_file_info(fs.FileSelector(str(tmp_path / "t"), recursive=True))
    want = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File)
    assert [(f.path, f.size) for f in store.listed(str(tmp_path / "t"))] == want
    assert [(f.path, f.size) for f in store.listed(f"file://{tmp_path}/t", ".epub")] == [x for x in want if x[0].endswith(".epub")]
    assert [f.path for f in store.listed(f"{tmp_path}/t/*/?.epub")] == [f"{tmp_path}/t/{x}.epub" for x in ("b/c", "far/i", "g.epub/h", "links/i")]


def test_a_folder_goes_without_a_list_of_its_files(spark, tmp_path):
    import tracemalloc

    from glossaflow.plans import scratch

    n = 5000
    (tmp_path / "t/below/empty").mkdir(parents=True)
    (tmp_path / "kept").mkdir()
    (tmp_path / "kept/a").write_bytes(b"a")
    (tmp_path / "t/link").symlink_to(tmp_path / "kept")
    for k in range(n):
        (tmp_path / f"t/{k}").touch()
    (tmp_path / "t/below/b c%20").write_bytes(b"b")
    tracemalloc.start()
    try:
        scratch.drop_path(spark, f"file://{tmp_path}/t")
        assert tracemalloc.get_traced_memory()[1] < 200_000
    finally:
        tracemalloc.stop()
    assert os.listdir(tmp_path) == ["kept"] and os.listdir(tmp_path / "kept") == ["a"]
    scratch.drop_path(spark, f"{tmp_path}/kept")
    scratch.drop_path(spark, f"{tmp_path}/kept")
    assert os.listdir(tmp_path) == []


def test_a_staged_folder_is_not_listed_by_hadoop(spark, tmp_path, monkeypatch):
    from glossaflow.plans import scratch

    (tmp_path / "t").mkdir()
    dropped, plain = [], store.drop
    monkeypatch.setattr(store, "drop", lambda path: (dropped.append(path), plain(path)))
    scratch.drop_path(spark, f"file:{tmp_path}/t")
    assert dropped == [f"{tmp_path}/t"] and os.listdir(tmp_path) == []
