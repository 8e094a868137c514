"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last one of the
prefix's encoding. ``PrefixTable`` stores that token per prefix. The token that
ends at byte ``i`` is the one whose start leaves a prefix whose own last token
stands validly before it, that is, no merge crosses their border at its turn.
Appending bytes extends the table without touching what is there, and an edit
keeps the table up to its first changed byte.

Texts are first split by a pattern and each match is encoded by itself, so
``EncodedText`` keeps the matches before an edit and encodes the rest again.

Defined cases: a null or empty text has no tokens; decoding returns the bytes
of the text for any text; equal texts have equal ids; repeated rows have a row
each; ids of documents may be of any type and null.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from glossaflow.plans.scratch import bounded_batches

CACHE_PIECES = 1_000_000
CACHE_BYTES = 64


class Ranks:
    """A rank file: token bytes by id, and how each token was merged."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self._made: dict[tuple[int, int], int] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            parts = self._merged(token, rank)
            if len(parts) != 2:
                raise ValueError(f"token {rank} can't come from the merges before it")
            self.halves[rank] = (parts[0], parts[1])
            self._made[self.halves[rank]] = rank

    @classmethod
    def parse(cls, content: bytes) -> "Ranks":
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())})

    def _merged(self, text: bytes, below: int) -> list[int]:
        """Ids after all merges of a rank under ``below``, lowest rank first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens side by side encode to these two.

        Undoes the later of the two outermost merges again and again; the pair
        fails if the tokens then facing each other would have merged earlier.
        """
        known = self._pairs.get((left, right))
        if known is None:
            known = self._fits(left, right)
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            self._pairs[(left, right)] = known
        return known

    def _fits(self, a: int, b: int) -> bool:
        before = len(self.tokens) + 1
        while True:
            made = self._made.get((a, b))
            if made is not None and made < before:
                return False
            down_a, down_b = self.halves.get(a), self.halves.get(b)
            if down_a is None and down_b is None:
                return True
            # Of equal ranks the left merge comes first, so the right is undone first.
            if down_b is None or down_a is not None and a > b:
                before, a = a, down_a[1]
            else:
                before, b = b + 1, down_b[0]


class PrefixTable:
    """last[i]: the id of the last token in the encoding of the first i+1 bytes."""

    def __init__(self, ranks: Ranks, text: bytes = b""):
        self.ranks, self.text, self.last = ranks, b"", []
        self.append(text)

    def append(self, more: bytes) -> None:
        last, get, fits, pairs = self.last, self.ranks.ids.get, self.ranks.fits, self.ranks._pairs
        done, longest = len(self.text), self.ranks.longest
        self.text = text = self.text + more
        for end in range(done + 1, len(text) + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                token = get(text[start:end])
                if token is None:
                    continue
                if not start:
                    last.append(token)
                    break
                known = pairs.get((last[start - 1], token))
                if known or known is None and fits(last[start - 1], token):
                    last.append(token)
                    break

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Edit bytes; only prefixes that reach the edit are computed again."""
        rest = new + self.text[end:]
        self.text = self.text[:start]
        del self.last[start:]
        self.append(rest)

    def ids(self) -> list[int]:
        out, at = [], len(self.text)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.ranks.tokens[out[-1]])
        return out[::-1]


class _Pieces(dict):
    """Ids of pieces; unknown ones are encoded, short ones remembered up to a fixed number."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.ids.get(raw)
        ids = (whole,) if whole is not None else tuple(PrefixTable(self.ranks, raw).ids())
        if len(raw) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes whole texts, each match of the pattern by itself."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.pieces = _Pieces(ranks)
        self._names = [str(i) for i in range(len(ranks.tokens))]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text or ""))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self._names.__getitem__, ids))


class EncodedText:
    """A text with its pieces, for exact appends and encoding again near edits."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text, self.pieces = codec, "", []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """A piece stays if text that isn't space stands between it and the edit,
        for the pattern looks no further ahead than the next such character."""
        kept, at = 0, 0
        for piece in self.pieces:
            if not self.text[at + len(piece) : start].strip():
                break
            at += len(piece)
            kept += 1
        self.text = self.text[:start] + new + self.text[end:]
        self.pieces[kept:] = [m[0] for m in self.codec.pattern.finditer(self.text, at)]

    def ids(self) -> list[int]:
        return list(chain.from_iterable(map(self.codec.pieces.__getitem__, self.pieces)))


_codecs: dict[str, Codec] = {}


def codec_of(content: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Ranks.parse(content), pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, content: bytes, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, and digests of the ids and of what they decode to."""
    return _per_document(docs, content, pattern, text, doc_id, True)


def encode_digests(docs: DataFrame, content: bytes, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The same without the ids."""
    return _per_document(docs, content, pattern, text, doc_id, False)


def _per_document(docs: DataFrame, content: bytes, pattern: str, text: str, doc_id: str, with_ids: bool) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(content)  # the rank file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks.value, pattern)
        for b in batches:
            cols = {"doc_id": b.column(0)}
            n, ids_sha, bytes_sha, all_ids = [], [], [], []
            for t in b.column(1).to_pylist():
                ids = codec.encode(t)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(codec.joined(ids).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            cols["n_tokens"] = pa.array(n, pa.int64())
            if with_ids:
                cols["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            cols |= {"ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(bytes_sha, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {'ids array<int>, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string")
