"""EPUB archives as a data source: ``spark.read.format("epub")`` and ``df.write.format("epub")``.

Both sides have rows (book, entry, content), one for each file in an archive.

Reading plans partitions of about ``splitBytes`` of archives; an archive larger
than that is shared out by the places of its entries. A task opens an archive by
its central directory and reads the ranges of those entries alone that the option
``entries`` names (patterns, one a line), so a reader of package files or chapters
saves the bytes and the decompression of images, not only their rows. That is an
option and no pushed filter, since Spark 4.1 keeps what was pushed with the loaded
table: after ``t.filter(...)`` the whole of ``t`` would read as filtered.

Writing makes one file of each book. Tasks write into a folder of their attempt in
a folder of the job, the driver moves whole files to their own names when all
tasks have ended, and removes the folder whether the job succeeds or fails. So
a task that is killed, repeated or run twice leaves nothing behind. An archive
is written entry by entry; a task holds one entry at a time.

The driver holds no list of books or files, as there may be millions of them. Of a
task that writes it gets a folder and a number; the books are in a list there, sorted
by the names that they would like. These lists are merged as they are read, so that
books which contend for a name meet, and moved some thousands at a time. Of files to
read it holds the shares of tasks, packed (some ten bytes a file).

Defined cases: an empty path pattern reads as an empty table; folders are read
with all files that end in ``.epub`` below them; a file that is no archive fails
the read with its name; folders inside archives are no entries. A book is named
by the last part of its path; books of one name get ``-2``, ``-3`` and so on in
the order of their paths. Null contents are written as empty files. Rows without
a book or an entry, rows of a book that don't lie together, and one entry twice
fail the write.
"""

from __future__ import annotations

import fnmatch
import heapq
import io
import json
import posixpath
import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from glossaflow.functions.batches import BATCH_BYTES, BATCH_ROWS
from glossaflow.plans.scratch import bounded_batches
from glossaflow.sources import store

SCHEMA = "book string, entry string, content binary"
SPLIT_BYTES = 64 << 20
OPEN_BYTES = 128 << 10  # what opening an archive counts for
WHOLE_BYTES = 256 << 10  # archives up to this are read at once, larger ones by the ranges of their entries
MOVES = 16  # files that the driver moves at a time
MOVES_HELD, MOVES_CALL = 4096, 64  # of which it knows at a time, and of one call
LIST = "books"  # of a task's folder
LISTS_BYTES = 16 << 20  # of all tasks' lists that the driver holds at a time
BUCKETS = 64  # in which old and new names meet
READ_BYTES = 8 << 20
_ARROW = pa.schema([("book", pa.string()), ("entry", pa.string()), ("content", pa.binary())])


class Share(InputPartition):
    """Archives of a task: (path, size, which share, of how many), packed, for the driver holds the shares of all tasks."""

    def __init__(self, parts: Iterable[tuple[str, int, int, int]]):
        self.packed = zlib.compress(json.dumps(sorted(parts)).encode())

    @property
    def parts(self) -> list[tuple[str, int, int, int]]:
        return [tuple(x) for x in json.loads(zlib.decompress(self.packed))]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options.get("path", ""), int(options.get("splitBytes", SPLIT_BYTES))
        self.entries = options.get("entries", "*").split("\n")

    def _wanted(self, name: str) -> bool:
        return any(fnmatch.fnmatchcase(name, p) for p in self.entries)

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for f in store.scanned(self.path, ".epub"):
            shares = max(1, -(-f.size // self.split))
            if shares > 1:
                out += [Share([(f.path, f.size, k, shares)]) for k in range(shares)]
                continue
            cost = f.size + OPEN_BYTES
            if held and size + cost > self.split:
                out.append(Share(held))
                held, size = [], 0
            held.append((f.path, f.size, 0, 1))
            size += cost
        return [*out, *([Share(held)] if held or not out else [])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for path, total, share, shares in partition.parts:
            fs, inner = store.opened(path)
            with fs.open_input_file(inner) as raw:
                try:
                    archive = zipfile.ZipFile(io.BytesIO(raw.read()) if total <= WHOLE_BYTES else io.BufferedReader(raw, 1 << 16))
                except (zipfile.BadZipFile, pa.ArrowInvalid) as e:  # Arrow's files refuse to seek before their start
                    raise ValueError(f"Invalid EPUB: {e}: {path}") from None
                with archive:
                    for info in archive.infolist():
                        mine = shares == 1 or min(info.header_offset * shares // max(1, total), shares - 1) == share
                        if info.is_dir() or not mine or not self._wanted(info.filename):
                            continue
                        content = archive.read(info)
                        held.append((path, info.filename, content))
                        size += len(content)
                        if size >= READ_BYTES:
                            yield _batch(held)
                            held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Entries(io.RawIOBase):
    """What ``zipfile`` writes: the entry in work stays here, where its header can be completed, whole ones go out."""

    def __init__(self, out):
        self.out, self.base, self.held = out, 0, io.BytesIO()

    def seekable(self) -> bool:
        return True

    def writable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.base + self.held.tell()

    def seek(self, at: int, whence: int = 0) -> int:
        self.held.seek(at - self.base if whence == 0 else at, whence)
        return self.tell()

    def write(self, data) -> int:
        return self.held.write(data)

    def push(self) -> None:
        self.out.write(self.held.getvalue())
        self.base += len(self.held.getvalue())
        self.held = io.BytesIO()


class _Book:
    def __init__(self, fs, path: str):
        self.out = fs.open_output_stream(path)
        self.entries = _Entries(self.out)
        self.zip = zipfile.ZipFile(self.entries, "w")
        self.names: set[str] = set()

    def add(self, name: str, content: bytes | None) -> None:
        if name in self.names:
            raise ValueError(f"entry twice: {name}")
        self.names.add(name)
        info = zipfile.ZipInfo(name)  # a fixed date: equal files give equal archives
        info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
        self.zip.writestr(info, content or b"")
        self.entries.push()

    def close(self) -> None:
        self.zip.close()
        self.entries.push()
        self.out.close()


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's attempt, and how many books it has."""

    folder: str
    books: int


_SUFFIX = re.compile(r"-([2-9]|[1-9][0-9]{1,8})\Z")
Stem = tuple[str, str, tuple[int, ...]]


def _named(book: str) -> tuple[str, str]:
    """Stem and ending of the name that a book would like."""
    stem, ending = posixpath.splitext(posixpath.basename(book.rstrip("/")) or "book")
    return (stem, ending) if ending.lower() == ".epub" else (stem + ending, ".epub")


def _stem(book: str) -> Stem:
    """The same in parts: ending, stem without the numbers that contending books get, these numbers. In this order a stem comes before all that is named after it."""
    stem, ending = _named(book)
    numbers: list[int] = []
    while found := _SUFFIX.search(stem):
        stem = stem[: found.start()]
        numbers.append(int(found[1]))
    return ending, stem, tuple(reversed(numbers))


def _after(a: Stem, b: Stem) -> bool:
    """Whether ``a`` is ``b`` or named after it."""
    return a[:2] == b[:2] and a[2][: len(b[2])] == b[2]


def _only(n: int, one: str) -> None:
    if n > 1:
        raise ValueError(f"{n} books can't be one file {one}")


def file_names(books: list[str], one: str = "") -> dict[str, str]:
    """The name of each book's file; ``one`` names that of a single book."""
    if one:
        _only(len(books), one)
        return dict.fromkeys(books, one)
    out: dict[str, str] = {}
    taken: set[str] = set()
    tried: dict[tuple[str, str], int] = {}
    for book in sorted(books):
        stem, ending = _named(book)
        name, k = stem + ending, tried.get((stem, ending), 1)
        while name in taken:
            k += 1
            name = f"{stem}-{k}{ending}"
        taken.add(name)
        tried[stem, ending] = k
        out[book] = name
    return out


Book = tuple[Stem, str, str]  # its stem, the book, its attempt file


def mixed_families(books: Iterable[Book]) -> tuple[int, set[Stem]]:
    """Of books in the order of their stems: how many, and stems that several have and that others are named after, whose names depend on each other."""
    n, mixed = 0, set()
    top, several, last = None, False, None
    for stem, book, _ in books:
        n += 1
        if book == last:
            raise ValueError(f"a book was written by two tasks: {book}")
        last = book
        if stem == top:
            several = True
        elif several and _after(stem, top):
            mixed.add(top)
        else:
            top, several = stem, False
    return n, mixed


def names_in_order(books: Iterable[Book], mixed: set[Stem]) -> Iterator[tuple[str, str]]:
    """(attempt file, name) of books in the order of their stems, the names of ``file_names``; none is held but one mixed family."""
    held: dict[str, str] = {}
    top, k = None, 0
    for stem, book, file in books:
        if held and _after(stem, top):
            held[book] = file
            continue
        yield from ((held[b], name) for b, name in file_names(list(held)).items())
        held = {}
        top, k = stem, k + 1 if stem == top else 1
        if stem in mixed:
            held[book] = file
        else:
            plain, ending = _named(book)
            yield file, f"{plain}-{k}{ending}" if k > 1 else plain + ending
    yield from ((held[b], name) for b, name in file_names(list(held)).items())


def _lines(fs, path: str, size: int) -> Iterator[bytes]:
    """Lines of a file, about ``size`` bytes at a time; it isn't kept open, as there is one for each task."""
    at, rest = 0, b""
    while True:
        with fs.open_input_file(path) as f:
            more = f.read_at(size, at)
        if not more:
            return
        at += len(more)
        *lines, rest = (rest + more).split(b"\n")
        yield from lines


class _Names:
    """Names on the driver's disk, in buckets."""

    def __init__(self, folder: str, kind: str):
        self.files = [open(f"{folder}/{kind}{k}", "w+") for k in range(BUCKETS)]  # noqa: SIM115
        self.n = 0

    def add(self, name: str) -> None:
        self.files[zlib.crc32(name.encode()) % BUCKETS].write(json.dumps(name) + "\n")
        self.n += 1

    def bucket(self, k: int) -> set[str]:
        with self.files[k] as f:
            f.seek(0)
            return set(map(json.loads, f))


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.one, self.overwrite = options["path"].rstrip("/"), options.get("name", ""), overwrite
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        attempt = uuid.uuid4().hex
        fs, folder = store.opened(f"{self.temporary}/{attempt}")
        places: dict[str, int] = {}
        now, book = None, None
        for batch in iterator:
            for name, entry, content in zip(*(batch.column(c).to_pylist() for c in ("book", "entry", "content")), strict=True):
                if name is None or entry is None:
                    raise ValueError("a row has no book or no entry")
                if name != now:
                    if book:
                        book.close()
                    if name in places:
                        raise ValueError(f"rows of a book must lie together: {name}")
                    if not places:
                        fs.create_dir(folder, recursive=True)
                    now, book = name, _Book(fs, f"{folder}/{len(places)}")
                    places[name] = len(places)
                book.add(entry, content)
        if book:
            book.close()
            with fs.open_output_stream(f"{folder}/{LIST}", buffer_size=1 << 20) as out:
                for stem, name in sorted((_stem(b), b) for b in places):
                    out.write(json.dumps([*stem, name, places[name]]).encode() + b"\n")
        return Written(attempt, len(places))

    def _books(self, tasks: list[Written]) -> Iterator[Book]:
        """All books in the order of their stems."""
        fs, folder = store.opened(self.temporary)
        size = max(4096, min(1 << 20, LISTS_BYTES // max(1, len(tasks))))

        def books(attempt: str) -> Iterator[Book]:
            for line in _lines(fs, f"{folder}/{attempt}/{LIST}", size):
                ending, stem, numbers, book, place = json.loads(line)
                yield (ending, stem, tuple(numbers)), book, f"{folder}/{attempt}/{place}"

        return heapq.merge(*(books(t.folder) for t in tasks))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = store.opened(self.path)
        tasks = [m for m in messages if m and m.books]
        n = sum(t.books for t in tasks)
        if self.one:
            _only(n, self.one)
        listed, mixed = mixed_families(self._books(tasks))
        if listed != n:
            raise ValueError(f"{n} books were written, {listed} are in their lists")
        names = ((file, self.one) for _, _, file in self._books(tasks)) if self.one else names_in_order(self._books(tasks), mixed)
        fs.create_dir(folder, recursive=True)

        def move(files: Sequence[tuple[str, str]]) -> None:
            for file, name in files:
                fs.move(file, f"{folder}/{name}")

        with tempfile.TemporaryDirectory() as local, ThreadPoolExecutor(MOVES) as pool:  # a move waits for its store
            old, new = _Names(local, "old"), _Names(local, "new")
            if self.overwrite and not self.one:
                for found, _ in store.walked(fs, folder, False, lambda p: p.endswith(".epub")):
                    old.add(posixpath.basename(found))
            for some in batched(names, MOVES_HELD):
                for _ in pool.map(move, batched(some, MOVES_CALL)):
                    pass
                if old.n:
                    for _, name in some:
                        new.add(name)
            for k in range(BUCKETS):
                for name in old.bucket(k) - new.bucket(k):
                    fs.delete_file(f"{folder}/{name}")
        store.drop(self.temporary)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store.drop(self.temporary)


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def read_entries(spark: SparkSession, path: str, entries: Sequence[str] = ("*",)) -> DataFrame:
    """(book, entry, content) of the archives at a path, a pattern or below a folder; of the entries that a pattern matches."""
    spark.dataSource.register(Archives)
    return spark.read.format("epub").option("entries", "\n".join(entries)).load(path)


def write_books(files: DataFrame, path: str, mode: str = "overwrite", name: str = "") -> None:
    """One archive a book of files (book, entry, content): ``mimetype`` first and stored, the others by path.

    ``overwrite`` also removes other archives of the folder; ``name`` is the file of a single book.
    """
    files.sparkSession.dataSource.register(Archives)
    rows = files.select("book", "entry", "content").repartition("book")
    rows = rows.sortWithinPartitions("book", F.col("entry") != "mimetype", F.split("entry", "/"))
    bounded_batches(files.sparkSession, BATCH_ROWS, BATCH_BYTES)
    writer = rows.write.format("epub").mode(mode)
    (writer.option("name", name) if name else writer).save(path)
