"""Text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token that stands for a masked span, and character classes.
TOKEN = r"⟦PH:[0-9]{6}⟧"
KANA = r"[ぁ-ゟ゠-ヿｦ-ﾟー]"
LATIN = r"[A-Za-z]"
CJK = r"[一-鿿]"
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # what Python's str.strip removes

# Styles, and the guide names that providers expect for them.
STYLES = ("faithful_literal", "faithful_fluent", "literary_cn", "concise_cn")
TRANSLATE_GUIDES = {
    "faithful_literal": "faithful_literal_zh_hans",
    "faithful_fluent": "faithful_fluent_zh_hans",
    "literary_cn": "literary_zh_hans",
    "concise_cn": "concise_zh_hans",
}
REVISE_GUIDES = {
    "faithful_literal": "light_revision_keep_meaning_and_placeholders",
    "faithful_fluent": "fluent_revision_keep_meaning_and_placeholders",
    "literary_cn": "literary_revision_keep_meaning_and_placeholders",
    "concise_cn": "concise_revision_keep_meaning_and_placeholders",
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space off both ends, by Unicode; looks at the ends alone."""
    return F.btrim(_c(c), F.lit(SPACES))


def is_blank(c: Column | str) -> Column:
    return strip(c) == ""


def text_hash(c: Column | str) -> Column:
    return F.sha2(_c(c), 256)


def local_name(c: Column | str) -> Column:
    """Tag or attribute name without its {namespace}."""
    return F.regexp_replace(_c(c), r"^\{[^}]*\}", "")


def has_any_class(c: Column | str, wanted: list[str]) -> Column:
    """Whether a class attribute holds one of the names, in any case."""
    return F.coalesce(F.arrays_overlap(F.split(F.lower(_c(c)), r"(?U)\s+"), F.array(*map(F.lit, wanted))), F.lit(False))


def clamp(c: Column | str, n: int) -> Column:
    return F.left(_c(c), F.lit(n))


def line_count(c: Column | str) -> Column:
    return (F.length(_c(c)) - F.length(F.replace(_c(c), F.lit("\n"), F.lit(""))) + 1).cast("int")


def tokens(c: Column | str) -> Column:
    """Mask tokens in order, repeats included."""
    return F.regexp_extract_all(_c(c), F.lit(TOKEN), F.lit(0))


def without_tokens(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), TOKEN, "")


def token_mismatch(source: Column | str, target: Column | str) -> Column:
    """Whether two texts hold different multisets of tokens."""
    return F.array_sort(tokens(source)) != F.array_sort(tokens(target))


def _unchanged(source: Column | str, target: Column | str, kana: int) -> Column:
    bare = strip(source)
    probe = strip(without_tokens(bare))
    japanese = F.regexp_count(probe, F.lit(KANA)) >= kana
    latin = (F.length(probe) >= 40) & (F.regexp_count(probe, F.lit(LATIN)) >= 20)
    return (bare == strip(target)) & (probe != "") & (japanese | latin)


def needs_retry(source: Column | str, target: Column | str) -> Column:
    """Unchanged text that must be translated again: any kana, or long Latin text."""
    return _unchanged(source, target, 1)


def unchanged_message(source: Column | str, target: Column | str) -> Column:
    """The quality issue of an unchanged text, or null; it takes two kana."""
    probe = strip(without_tokens(strip(source)))
    kana = F.regexp_count(probe, F.lit(KANA)) >= 2
    return F.when(_unchanged(source, target, 2), F.when(kana, F.lit("译文与原文完全一致（含日文假名）")).otherwise("译文与原文完全一致（长拉丁文本）"))


def needs_repair(source: Column | str, target: Column | str) -> Column:
    return is_blank(target) | token_mismatch(source, target) | needs_retry(source, target)


def repair_tokens(source: Column | str, target: Column | str) -> Column:
    """The target with the tokens it lacks at its end; tokens too many stay."""
    have, got = tokens(source), tokens(target)

    def times(xs: Column, t: Column) -> Column:
        return F.size(F.filter(xs, lambda x: x == t))

    missing = F.array_join(F.transform(F.array_distinct(have), lambda t: F.repeat(t, F.greatest(F.lit(0), times(have, t) - times(got, t)))), "")
    base = strip(target)
    return F.when(missing == "", _c(target)).when(base == "", missing).otherwise(F.concat(base, F.lit(" "), missing))


def choose_candidate(source: Column | str, revised: Column | str, draft: Column | str) -> Column:
    """The revision if its tokens are whole, else such a draft, else a repair of one."""
    revised, draft = F.coalesce(_c(revised), F.lit("")), F.coalesce(_c(draft), F.lit(""))
    return (
        F.when((revised != "") & ~token_mismatch(source, revised), revised)
        .when((draft != "") & ~token_mismatch(source, draft), draft)
        .otherwise(repair_tokens(source, F.when(revised != "", revised).otherwise(draft)))
    )


def format_term(source: Column | str, target: Column | str) -> Column:
    """``target（source）`` unless the target already brackets the source."""
    s, t = strip(source), strip(target)
    full, half = F.concat(F.lit("（"), s, F.lit("）")), F.concat(F.lit("("), s, F.lit(")"))
    return F.when((s == "") | (t == "") | F.contains(t, full) | F.contains(t, half), t).otherwise(F.concat(t, full))


def term_left(source: Column | str, target: Column | str) -> Column:
    """The target without the bracketed source at its end."""
    s, t = strip(source), strip(target)
    full, half = F.concat(F.lit("（"), s, F.lit("）")), F.concat(F.lit("("), s, F.lit(")"))
    cut = strip(F.left(t, F.length(t) - F.length(full)))
    return F.when((s != "") & (t != "") & (F.endswith(t, full) | F.endswith(t, half)), cut).otherwise(t)


def has_cjk_left(source: Column | str, target: Column | str) -> Column:
    return term_left(source, target).rlike(CJK)


def normal_style(c: Column | str) -> Column:
    style = F.lower(strip(F.coalesce(_c(c), F.lit(""))))
    return F.when(style.isin(*STYLES), style).otherwise(STYLES[0])


def style_guide(c: Column | str, revise: bool = False) -> Column:
    guides = REVISE_GUIDES if revise else TRANSLATE_GUIDES
    pairs = [F.lit(x) for kv in guides.items() for x in kv]
    return F.element_at(F.create_map(*pairs), normal_style(c))


def segment_type(tag: Column | str) -> Column:
    tag = _c(tag)
    return (
        F.when(tag == "title", "title").when(tag.rlike("^h[0-9]+$"), "heading").when(tag == "li", "list_item")
        .when(tag.isin("td", "th"), "table_cell").otherwise("paragraph")
    )


def is_poetry(classes: Column | str) -> Column:
    return F.coalesce(_c(classes), F.lit("")).rlike(r"(?i)\b(poem|poetry|verse|stanza)\b")


def link_target(file: Column | str, href: Column | str) -> Column:
    """File that a link points to, from the folder of its own file; ``..`` stays as it is."""
    file, part = _c(file), F.regexp_extract(_c(href), r"^([^#]*)", 1)
    folder = F.regexp_extract(file, r"^(.*/)[^/]*$", 1)
    return F.when(part == "", file).when(F.startswith(part, F.lit("/")), part).otherwise(F.concat(folder, part))


def link_fragment(href: Column | str) -> Column:
    return F.regexp_extract(_c(href), r"^[^#]*#(.*)$", 1)


def is_external(href: Column | str) -> Column:
    href = _c(href)
    return F.startswith(href, F.lit("http://")) | F.startswith(href, F.lit("https://")) | F.startswith(href, F.lit("mailto:"))


def unfenced(c: Column | str) -> Column:
    """A reply without the code fence around it."""
    bare = strip(c)
    inner = F.regexp_replace(bare, r"^```[a-zA-Z]*\n", "")
    return F.when(F.startswith(bare, F.lit("```")), strip(F.regexp_replace(inner, r"```$", ""))).otherwise(bare)


def seq_id(prefix: str, n: Column | str, width: int) -> Column:
    return F.format_string(f"{prefix}%0{width}d", _c(n))


def decode_tokens(c: Column | str, pairs: Column | str) -> Column:
    """Puts the raw spans back for their tokens; pairs: array<struct<token,raw>>."""
    return F.aggregate(_c(pairs), _c(c), lambda text, p: F.replace(text, p["token"], p["raw"]))
