"""Text functions: edges of patterns and thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from glossaflow.functions import masking
from glossaflow.functions import text as T

P1, P2 = "⟦PH:000001⟧", "⟦PH:000002⟧"
ENGLISH = "This sentence is plainly long enough to count as Latin text."


def one(spark, values, column):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(column(*map(F.col, names))).first()[0]


@pytest.mark.parametrize(
    "text", ["", " a ", "　a b ", "\t\n\x1f", "a\x1cb\x1d", "  é  ", "x"]
)
def test_strip_is_pythons(spark, text):
    assert one(spark, [text], T.strip) == text.strip()
    assert one(spark, [text], T.is_blank) == (not text.strip())


@pytest.mark.parametrize(
    "source,target,retry,message",
    [
        ("これは文です", "これは文です", True, True),
        ("漢字の", "漢字の", True, False),  # one kana: tried again, no issue
        (ENGLISH, f" {ENGLISH}\n", True, True),
        (ENGLISH, "译文", False, False),
        (P1, P1, False, False),
        (f"{P1} {ENGLISH}", f"{P1} {ENGLISH}", True, True),
        ("short text", "short text", False, False),
        ("", "", False, False),
    ],
)
def test_unchanged(spark, source, target, retry, message):
    assert one(spark, [source, target], T.needs_retry) is retry
    assert (one(spark, [source, target], T.unchanged_message) is not None) is message


@pytest.mark.parametrize(
    "source,target,want",
    [
        (f"a{P1}b{P2}", f"{P2}", f"{P2} {P1}"), (f"{P1}{P1}", P1, f"{P1} {P1}"), (P1, "", P1), (P1, "  ", P1),
        (P1, f"{P1}{P2}", f"{P1}{P2}"), ("x", " y ", " y "), (f"{P2}{P1}", "t", f"t {P2}{P1}"),
    ],
)
def test_repair_tokens(spark, source, target, want):
    assert one(spark, [source, target], T.repair_tokens) == want


def test_choice(spark):
    pick = lambda s, r, d: one(spark, [s, r, d], T.choose_candidate)
    assert pick(P1, f"r{P1}", f"d{P1}") == f"r{P1}"
    assert pick(P1, "r", f"d{P1}") == f"d{P1}"
    assert pick(P1, "r", "d") == f"r {P1}"
    assert pick(P1, "", "d") == f"d {P1}"
    assert pick(P1, None, None) == P1


@pytest.mark.parametrize(
    "source,target,formatted,left,cjk",
    [
        ("Rome", "罗马", "罗马（Rome）", "罗马", True), ("Rome", "罗马（Rome）", "罗马（Rome）", "罗马", True), ("Rome", " 罗马 (Rome)", "罗马 (Rome)", "罗马", True),
        ("Rome", "Rome", "Rome（Rome）", "Rome", False), ("", "罗马", "罗马", "罗马", True), ("Rome", "", "", "", False),
    ],
)
def test_terms(spark, source, target, formatted, left, cjk):
    assert one(spark, [source, target], T.format_term) == formatted
    assert one(spark, [source, target], T.term_left) == left
    assert one(spark, [source, target], T.has_cjk_left) is cjk


def test_small_functions(spark):
    assert one(spark, ["{urn:x}p"], T.local_name) == "p"
    assert one(spark, ["a RAW b"], lambda c: T.has_any_class(c, ["raw"])) is True
    assert one(spark, [None], lambda c: T.has_any_class(c, ["raw"])) is False
    assert one(spark, ["abc"], lambda c: T.clamp(c, 2)) == "ab"
    assert one(spark, ["a\nb\n"], T.line_count) == 3
    assert one(spark, ["```json\n{}\n```"], T.unfenced) == "{}"
    assert one(spark, [" Literary_CN "], T.style_guide) == "literary_zh_hans"
    assert one(spark, ["nonsense"], lambda c: T.style_guide(c, True)) == "light_revision_keep_meaning_and_placeholders"
    assert one(spark, ["x poem y"], T.is_poetry) is True and one(spark, ["poems"], T.is_poetry) is False
    assert one(spark, ["a/b.xhtml", "c.xhtml#d"], T.link_target) == "a/c.xhtml" and one(spark, ["a/b.xhtml", "#d"], T.link_target) == "a/b.xhtml"
    assert [one(spark, [t], T.segment_type) for t in ("title", "h2", "li", "th", "div")] == ["title", "heading", "list_item", "table_cell", "paragraph"]


def test_masking_order_and_round_trip():
    text = "See https://a.org/1 on 1,234.5 and Louis XIV, c. 1700, mailto:x@y 3rd"
    masked, pairs = masking.mask_text(text)
    assert [raw for _, raw in pairs] == ["https://a.org/1", "mailto:x@y", "1,234.5", "1700", "3rd", "XIV", "c."]
    for token, raw in pairs:
        masked = masked.replace(token, raw)
    assert masked == text


def test_masking_markup():
    masked, pairs = masking.mask_markup('He <em class="x">said</em> <p>in <b>12</b></p> 7')
    assert masked.count("⟦PH:") == 3 and "<" not in masked
    assert pairs[0][1] == '<em class="x">said</em>' and pairs[-1][1] == "7"
    assert masking.mask_markup("a & b 5")[1] == [(P1, "5")]  # no XML: text


def test_tokens_are_left_alone():
    masked, pairs = masking.mask_text(f"{P2} 12")
    assert masked == f"{P2} {P1}" and pairs == [(P1, "12")]


def test_chunks():
    assert masking.chunks("abc", 3) == ["abc"]
    assert masking.chunks("One. Two three. Four", 16) == ["One. Two three.", "Four"]
    assert masking.chunks("a" * 7, 3) == ["aaa", "aaa", "a"]
    assert masking.chunks("aa bb cc", 4) == ["aa", "bb", "cc"]
    torn = masking.chunks(P1 + P2, 15)
    assert torn == [(P1 + P2)[:15], (P1 + P2)[15:]]
    assert masking.chunks("     x", 3) == ["   ", "x"]


@pytest.mark.parametrize(
    "text,single,want",
    [
        ("The Norman Conquest of England began.", False, ["Norman Conquest of England"]),
        ("Paris is NATO land", False, ["NATO"]), ("Paris is big", True, ["Paris"]), ("Louis XIV. XIV", False, ["Louis XIV"]),
        ("He saw. They Went Home", False, ["They Went Home"]), ("", False, []), ("King of the and", True, ["King"]),
    ],
)
def test_phrases(text, single, want):
    assert masking.phrases(text, single) == want


def test_arrow_columns_keep_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("A 1",)], "t string")
    m = [r[0] for r in df.select(masking.mask_text_column(F.col("t"))).collect()]
    assert m[0] is None or m[0]["text"] is None
    assert m[1]["text"] == "" and m[2]["pairs"][0]["raw"] == "1"
    assert [r[0] for r in df.select(masking.chunks_column(F.col("t"), 5)).collect()] == [None, [""], ["A 1"]]
    assert df.select(F.explode(masking.phrases_column(F.col("t")))).count() == 0


def test_masking_without_python_matches_the_masker(spark):
    """Texts of the pieces that matter, beside each other at random, tokens and half tokens among them."""
    bits = ["1", "23", "456", "7890", ",", ".", "st", "th", " ", "\n", "https://", "http://x.y", "mailto:", "a@b", "IV", "XX", "I", "c.", "fl.", "r.", "PH", "⟦PH:000001⟧", "⟦PH:12⟧", "⟦PH:", "⟧"]
    bits += ["٣", "é", "e\u0301", "中", "_", "²", "½", "-", "(", "\u2003", "\xa0", "\x1c", "\u3000", "😀", "𝟗", "x", "C", "MM", "/"]
    rng = random.Random(8)
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(18))) for _ in range(5000)] + [None, "", "x" * 50_000 + " 12 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", masking.mask_text_column(F.col("t")).alias("m"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        want = (None, None) if texts[r["i"]] is None else masking.mask_text(texts[r["i"]])
        assert (r["m"]["text"], r["m"]["pairs"] and [tuple(p) for p in r["m"]["pairs"]] or ([] if r["m"]["pairs"] is not None else None)) == want, repr(texts[r["i"]])[:200]
