"""Masking, chunking and phrase mining: logic that keeps state along a text.

Each is a plain Python function with a column function beside it. Masking of
texts is built-in expressions alone: a pass of a pattern is one list of matches
and one list of what lies between, put together again. The others are
Arrow-batched. Markup is masked in Python, for it is parsed there anyway.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from glossaflow.plans.scratch import bounded_batches

# What is masked, in this order, and the inline elements.
TOKEN = re.compile(r"⟦PH:\d{6}⟧")
LITERALS = tuple(
    re.compile(p)
    for p in (
        r"(?:https?://\S+|mailto:\S+)",
        r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?(?:st|nd|rd|th)?\b|\b\d+\b",
        r"\b[IVXLCDM]{2,}\b",
        r"\b(?:c\.|fl\.|r\.)",
    )
)
_DIGIT, _ROMAN = re.compile(r"\d"), re.compile(r"[IVXLCDM]{2}")


def _holds_digit(text: str) -> bool:
    """Plain searches are several times as fast as a pattern's; other scripts have digits of their own."""
    return any(map(text.__contains__, "0123456789")) or not text.isascii() and _DIGIT.search(text) is not None


def _holds_roman(text: str) -> bool:
    return any(map(text.__contains__, "IVXLCDM")) and _ROMAN.search(text) is not None


#: What a text must hold for each of them to match in it, which is found much faster.
HOLDS: tuple[Callable[[str], object], ...] = (
    lambda t: "http" in t or "mailto:" in t,
    _holds_digit,
    _holds_roman,
    lambda t: "c." in t or "fl." in t or "r." in t,
)
#: The same for the JVM's patterns, where classes must say what words, digits and spaces are in
#: all scripts, and where a match may neither run into a token nor lie in one. (A digit beyond 16
#: bits, though it is among \\p{N}, makes them look back by code points.)
_W, _SPACE, _HELD = r"[\p{L}\p{N}_𝟎]", r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}", r"⟦PH:\p{Nd}{6}⟧"
_RUN = rf"(?:(?!{_HELD})[^{_SPACE}])+"
JVM_LITERALS = (
    rf"https?://{_RUN}|mailto:{_RUN}",
    rf"(?<!{_W})(?!(?<=⟦PH:)\p{{Nd}}{{6}}⟧)(?:\p{{Nd}}{{1,3}}(?:,\p{{Nd}}{{3}})*(?:\.\p{{Nd}}+)?(?:st|nd|rd|th)?(?!{_W})|\p{{Nd}}+(?!{_W}))",
    rf"(?<!{_W})[IVXLCDM]{{2,}}(?!{_W})",
    rf"(?<!{_W})(?:c\.|fl\.|r\.)",
)
INLINE = frozenset({"a", "em", "strong", "i", "b", "sup", "sub", "span", "br", "img", "q", "cite"})
MARKUP = "<&\r"  # what a parser would read as something else
BREAK = re.compile(r"(?<=[。！？.!?;；:：])\s+")
MARKS = (" ", "，", ",", "；", ";", "。", ".")
PAIRS = "array<struct<token:string,raw:string>>"


def name_of(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


class Masker:
    """Gives out numbered tokens and remembers what each stands for."""

    def __init__(self) -> None:
        self.pairs: list[tuple[str, str]] = []

    def token(self, raw: str) -> str:
        token = f"⟦PH:{len(self.pairs) + 1:06d}⟧"
        self.pairs.append((token, raw))
        return token

    def literals(self, text: str) -> str:
        for pattern, holds in zip(LITERALS, HOLDS, strict=True):
            if not holds(text):
                continue
            done, at = [], 0
            for held in [*(TOKEN.finditer(text) if "⟦" in text else ()), None]:
                stop = held.start() if held else len(text)
                done.append(pattern.sub(lambda m: self.token(m[0]), text[at:stop]))
                if held:
                    done.append(held[0])
                    at = held.end()
            text = "".join(done)
        return text

    def inline(self, node: ET.Element) -> str:
        """Text of a node with each inline element as one token, others flattened."""
        out = [node.text or ""]
        for child in node:
            if isinstance(child.tag, str):
                if name_of(child.tag) in INLINE:
                    tail, child.tail = child.tail, None
                    out.append(self.token(ET.tostring(child, encoding="unicode")))
                    child.tail = tail
                else:
                    out.append(self.inline(child))
            out.append(child.tail or "")
        return "".join(out)


def mask_text(text: str) -> tuple[str, list[tuple[str, str]]]:
    masker = Masker()
    return masker.literals(text), masker.pairs


def mask_markup(inner_xml: str) -> tuple[str, list[tuple[str, str]]]:
    """Masks a fragment; one that doesn't parse is masked as the text it is."""
    if not any(map(inner_xml.__contains__, MARKUP)):  # it parses as the text it is
        return mask_text(inner_xml)
    masker = Masker()
    try:
        return masker.literals(masker.inline(ET.fromstring(f"<root>{inner_xml}</root>"))), masker.pairs
    except ET.ParseError:
        return mask_text(inner_xml)


def _cut_at(window: str) -> int:
    last = None
    for last in BREAK.finditer(window):
        pass
    if last is not None:
        return last.start()
    return next((at + 1 for at in map(window.rfind, MARKS) if at > 0), len(window))


def chunks(text: str, size: int) -> list[str]:
    """Pieces of at most ``size`` code points, cut at sentence ends where there are any."""
    out, at = [], 0
    if len(text) <= size:
        return [text]
    while len(text) - at > size:
        window = text[at : at + size]
        cut = _cut_at(window) or size
        piece = window[:cut].strip()
        if not piece:
            piece, cut = window, size
        out.append(piece)
        at += cut
        while at < len(text) and text[at].isspace():
            at += 1
    if at < len(text):
        out.append(text[at:])
    return out


# Words around capitalised phrases, and words that are no term alone.
CONNECTORS = frozenset({"of", "the", "and", "de", "von", "van", "la", "le", "di", "da", "du"})
ARTICLES = frozenset({"the", "a", "an"})
STOP_WORDS = frozenset({
    "the", "a", "an", "in", "on", "at", "for", "to", "from", "and", "but", "or", "nor", "yet", "so", "he", "she", "it", "they", "we", "i",
    "this", "that", "these", "those", "chapter", "book", "part",
})
SENTENCE = re.compile(r"[\n\r.!?;:]+")
WORD = re.compile(r"[A-Za-z][A-Za-z'’-]*|[A-Z]{2,}")
ROMAN = re.compile(r"[IVXLCDM]+")


def _capital(word: str) -> bool:
    return len(word) >= 2 and (word.isupper() or word[0].isupper() and any(map(str.isalpha, word[1:])))


def _term(words: list[str], single: bool) -> str | None:
    end, start = len(words), 0
    while end and words[end - 1].lower() in CONNECTORS:
        end -= 1
    while end - start > 1 and words[start].lower() in ARTICLES:
        start += 1
    words = words[start:end]
    phrase = " ".join(words)
    if len(phrase) < 3 or ROMAN.fullmatch(phrase):
        return None
    if len(words) == 1 and (not single and not phrase.isupper() or phrase.lower() in STOP_WORDS):
        return None
    return phrase


def phrases(text: str, single: bool = False) -> list[str]:
    """Capitalised runs of words, with connectors inside, sentence by sentence."""
    out = []
    for sentence in SENTENCE.split(text):
        run: list[str] = []
        for word in [*WORD.findall(sentence), ""]:
            if _capital(word) or run and word.lower() in CONNECTORS:
                run.append(word)
            elif run:
                term = _term(run, single)
                run = []
                if term:
                    out.append(term)
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _pass(before: Column, pattern: str) -> Column:
    """struct<text, pairs> after a further pattern: its matches take the next numbers in their order."""

    def after(done: Column) -> Column:
        def number(k: Column) -> Column:
            return F.format_string("⟦PH:%06d⟧", F.size(done["pairs"]) + k)

        def both(found: Column) -> Column:
            between = F.transform(F.split(done["text"], pattern, -1), lambda text, i: F.when(i < F.size(found), F.concat(text, number(i + 1))).otherwise(text))
            new = F.transform(found, lambda raw, i: F.struct(number(i + 1).alias("token"), raw.alias("raw")))
            text = F.when(F.size(found) > 0, F.array_join(between, "")).otherwise(done["text"])
            return F.struct(text.alias("text"), F.concat(done["pairs"], new).alias("pairs"))

        return _let(F.regexp_extract_all(done["text"], F.lit(pattern), F.lit(0)), both)

    return _let(before, after)


def mask_text_column(c: Column) -> Column:
    """struct<text, pairs> of plain texts, without Python; both null of null."""
    out = F.struct(c.alias("text"), F.array().cast(PAIRS).alias("pairs"))
    for pattern in JVM_LITERALS:
        out = _pass(out, pattern)
    return _let(out, lambda done: F.struct(done["text"].alias("text"), F.when(done["text"].isNotNull(), done["pairs"]).alias("pairs")))


def mask_markup_column(c: Column) -> Column:
    """The same of fragments of markup."""

    _bounded()

    @F.pandas_udf(f"struct<text:string,pairs:{PAIRS}>")
    def mask(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            done = [(None, None) if t is None else mask_markup(t) for t in s]
            yield pd.DataFrame({"text": [t for t, _ in done], "pairs": [p and [{"token": a, "raw": b} for a, b in p] or ([] if t is not None else None) for t, p in done]})

    return mask(c)


def _bounded() -> None:
    bounded_batches(SparkSession.active(), 512, 2 << 20)


def chunks_column(c: Column, size: int) -> Column:
    _bounded()

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else chunks(t, size) for t in texts], dtype=object)

    return cut(c)


def phrases_column(c: Column, single: bool = False) -> Column:
    _bounded()

    @F.pandas_udf("array<string>")
    def mine(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else phrases(t, single) for t in texts], dtype=object)

    return mine(c)
