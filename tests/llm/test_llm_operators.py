"""Operators against brute force on small tables, and their defined cases."""

import hashlib
import math
import random
import time
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from glossaflow.llm import attention, bpe, decontaminate, line_dedup, lm, pii, quality, simhash, substring_dedup, url_filter, winnow

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def docs_of(spark, texts, first=0):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\n", "É é Ab", "a b c", "a b c", LONG, "x" * 50_000, "tab\tnew\nline 漢字 🙂"]


def content():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


# 1 ------------------------------------------------------------------------------------------


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("com", "/en/", "allow"), ("net", "", "block")], url_filter.RULE_SCHEMA)
    urls = ["https://A.Example.COM/en/7x?q", "http://b.com/en/x#f", "http://xcom/en/", "no scheme", None, "", "http://", "ftp://com/en/", "http://n.net?x", "HTTP://com/EN/", "http://b.com/en/x#f", "a://b://com/en/"]
    pages = spark.createDataFrame([(i if i else None, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.apply_rules(pages, rules).collect()}
    assert url_filter.apply_rules(pages, rules).count() == len(urls)
    assert got["https://A.Example.COM/en/7x?q"] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got["http://b.com/en/x#f"] == ("b.com", "/en/x", "com/en/", "block")  # block over allow for equal rules
    assert got["http://xcom/en/"] == ("xcom", "/en/", None, "allow")
    assert got["no scheme"] == got[None] == got[""] == ("", "", None, "allow")
    assert got["http://"] == ("", "", None, "allow")
    assert got["ftp://com/en/"][2:] == ("com/en/", "block")
    assert got["http://n.net?x"] == ("n.net", "", "net", "block")
    assert got["HTTP://com/EN/"][2] is None
    assert got["a://b://com/en/"][:2] == ("b:", "//com/en/")


def test_url_rules_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    assert url_filter.apply_rules(pages, none).first()["verdict"] == "allow"
    assert url_filter.apply_rules(pages.limit(0), spark.createDataFrame([("com", "/", "block")], url_filter.RULE_SCHEMA)).count() == 0


# 2 ------------------------------------------------------------------------------------------


def test_winnowing_keeps_its_guarantee():
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdef ") for _ in range(winnow.K + winnow.W - 1))
    a, b = ("".join(rng.choice("abcdef ") for _ in range(500)) + shared + "".join(rng.choice("abcdef ") for _ in range(n)) for n in (300, 100))
    assert set(winnow.fingerprint(a)[0].tolist()) & set(winnow.fingerprint(b)[0].tolist())


@pytest.mark.parametrize("n", [0, 1, 2, 5, 29, 30, 31, 200])
def test_winnowing_chooses_rightmost_minima(n):
    h = np.random.default_rng(n).integers(0, 6, n, dtype=np.uint64)
    w = min(winnow.W, n)
    want = sorted({max(j for j in range(i, i + w) if h[j] == h[i : i + w].min()) for i in range(n - w + 1)}) if n else []
    assert winnow.choose(h).tolist() == want


def test_winnowing_and_features_by_parts(monkeypatch):
    rng = random.Random(16)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (0, 1, 19, 20, 48, 49, 50, 120, 777)]
    whole = [(winnow.shown(winnow.fingerprint(t)), quality.features(t).tolist()) for t in texts]
    monkeypatch.setattr(winnow, "PART", 13)
    monkeypatch.setattr(quality, "PART", 7)
    assert [(winnow.shown(winnow.fingerprint(t)), quality.features(t).tolist()) for t in texts] == whole


def test_gram_hashes_depend_on_the_gram_alone():
    text = "abcabcabcabcabcabcabcabcabcabc"
    h = winnow.gram_hashes(text, 7)
    assert len(h) == len(text) - 6 and h[0] == h[3] and h[0] != h[1]
    assert winnow.gram_hashes(text[3:10], 7)[0] == h[3]


def test_winnowing_meets_the_next_document(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh \n") for _ in range(rng.choice([0, 3, 7, 80, 900]))) for _ in range(60)] + ODD
    got = {r["doc_id"]: r for r in winnow.compare_with_next(docs_of(spark, texts), groups=7).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        new = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        fp, other, after = winnow.fingerprint(t), winnow.fingerprint(new), winnow.fingerprint(nxt)
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == winnow.shown(fp) and r["edited_fingerprint"] == winnow.shown(other)
        assert (r["near_edited"], r["near_next"]) == (winnow.likeness(fp[0], other[0]), winnow.likeness(fp[0], after[0]))


def test_winnowing_defined_cases(spark):
    assert winnow.compare_with_next(docs_of(spark, [])).count() == 0
    one = winnow.compare_with_next(docs_of(spark, ["some text of some length here"])).first()
    assert one["near_next"] == 1.0
    twice = docs_of(spark, ["a b c d e f"]).unionByName(docs_of(spark, ["g h i", None]))
    nulls = twice.unionByName(twice.withColumn("doc_id", F.lit(None).cast("long")))
    assert winnow.compare_with_next(nulls).count() == 6
    named = docs_of(spark, ["one text", "two texts", None]).select(F.concat(F.lit("k"), F.lit(9) - F.col("doc_id")).alias("doc_id"), "text")
    got = {r["doc_id"]: r["n_chars"] for r in winnow.compare_with_next(named).collect()}
    assert got == {"k9": 8, "k8": 9, "k7": 0}


@pytest.mark.parametrize("ids", [[None] * 40, [5] * 40, [1, 2, 3, None] * 10, [2**62 + k // 20 for k in range(40)]])
def test_winnowing_splits_rows_of_one_id(spark, ids):
    texts = [f"text number {k} of some length" for k in range(40)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(((winnow._LOWEST if r["doc_id"] is None else r["doc_id"], r["h"], r["text"]) for r in rows))
    want = Counter()
    for k, (_, _, t) in enumerate(order):
        following = order[(k + 1) % 40][2]
        want[hashlib.sha256(winnow.edited(t, following).encode()).hexdigest()] += 1
    out = winnow.compare_with_next(docs, groups=8)
    assert Counter(r["edited_sha256"] for r in out.collect()) == want
    assert out.withColumn("p", F.spark_partition_id()).groupBy("p").count().count() > 3
    assert winnow.likeness(np.array([]), np.array([1])) == 0.0
    assert winnow.fingerprints(docs_of(spark, ODD)).count() == len(ODD)


# 3 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.codec_of(content(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(codec.ranks.ids), special_tokens={})


ALPHABET = "ab  \n\t'stre éü漢字🙂0123‍the ing\u00a0\u2003"


def test_bpe_agrees_with_the_library(codec, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + [t or "" for t in ODD]
    for t in texts:
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_bpe_prefix_table_appends_and_edits_exactly(codec, library):
    rng = random.Random(4)
    for _ in range(300):
        raw = b"".join(rng.choice(codec.ranks.tokens) for _ in range(rng.randint(1, 6)))
        table = bpe.PrefixTable(codec.ranks)
        for i in range(0, len(raw), 3):
            table.append(raw[i : i + 3])
        assert table.ids() == library._encode_single_piece(raw)
        a = rng.randint(0, len(raw))
        b = rng.randint(a, len(raw))
        table.replace(a, b, b"th")
        assert table.ids() == library._encode_single_piece(raw[:a] + b"th" + raw[b:])


def test_bpe_texts_encode_again_near_edits(codec, library):
    rng = random.Random(5)
    for _ in range(400):
        text = bpe.EncodedText(codec, "".join(rng.choice(ALPHABET) for _ in range(40)))
        for _ in range(4):
            a = rng.randint(0, len(text.text))
            text.replace(a, rng.randint(a, min(len(text.text), a + 4)), "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 4))))
            assert text.ids() == library.encode_ordinary(text.text)
        text.append(" the end")
        assert text.ids() == library.encode_ordinary(text.text)


def test_bpe_query_columns(spark, library):
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs_of(spark, ODD), content(), public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_digests(docs_of(spark, []), content(), public_tokenizers.PATTERN).count() == 0


# 4 ------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    rng = random.Random(6)
    lines = ["Same  line", "same  LINE ", "\tother", "É x", "é x", "", "rare", "漢字", "K sign", "k sign"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6))) for _ in range(60)] + ODD
    docs = docs_of(spark, texts).withColumn("kept_text", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("a", F.lit(None).cast("int"))
    got = {r["doc_id"]: r for r in line_dedup.drop_common_lines(docs, min_docs=10).collect()}
    key = lambda x: low(x.strip(" \t\n\x0b\f\r"))
    split = {i: (t or "").split("\n") for i, t in enumerate(texts)}
    seen = Counter(k for ls in split.values() for k in {key(x) for x in ls} if k)
    for i, ls in split.items():
        kept = [x for x in ls if seen[key(x)] < 10]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == (len(ls), len(ls) - len(kept), "\n".join(kept))
    assert got[0]["pos"] == 1


def test_working_columns_meet_no_others(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "mine", 2, 3)], "page_id int, url string, _cut string, _rule int, _verdict int")
    r = url_filter.apply_rules(pages, spark.createDataFrame([("com", "/en/", "block")], url_filter.RULE_SCHEMA)).first()
    assert (r["_cut"], r["_rule"], r["_verdict"], r["rule"], r["verdict"]) == ("mine", 2, 3, "com/en/", "block")
    docs = spark.createDataFrame([(k, "same\nx", "a", "b", "c") for k in range(10)], "doc_id bigint, text string, _r1 string, _r2 string, _drop string")
    out = line_dedup.drop_common_lines(docs)
    assert {(r["_r1"], r["_r2"], r["_drop"], r["n_dropped"]) for r in out.collect()} == {("a", "b", "c", 2)}
    scored = quality.add_scores(docs_of(spark, ["t"]).withColumn("doc_id", F.lit(None).cast("long")), quality.fit([], np.array([])))
    assert scored.first()["held_out"] is False


def test_line_dedup_defined_cases(spark):
    same = docs_of(spark, ["shared\nown"] * 10).withColumn("doc_id", F.lit(None).cast("long"))
    assert {r["kept_text"] for r in line_dedup.drop_common_lines(same).collect()} == {""}
    assert line_dedup.drop_common_lines(docs_of(spark, [])).count() == 0


# 5 ------------------------------------------------------------------------------------------


def _quality_texts(n):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 60))]
        good = i % 3 != 0
        out.append((i, " ".join(words if good else [w + rng.choice(["***", "###"]) for w in words]), int(good)))
    return out


def test_quality_is_accurate_on_held_out_rows(spark):
    rows = _quality_texts(600)
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.add_scores(docs, quality.train(docs, labels)).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == rows[i][2] for i in held) >= 0.97 * len(held)
    assert all(got[i]["held_out"] == (i in set(held)) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.5) for i in got)


def test_quality_ignores_labels_of_held_out_rows(spark):
    rows = _quality_texts(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    make = lambda flip: spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows], "doc_id bigint, quality int")
    a, b = (quality.train(docs, make(f)) for f in (False, True))
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)


def test_quality_defined_cases(spark):
    docs = docs_of(spark, ODD)
    none = spark.createDataFrame([(1, None)], "doc_id bigint, quality int")
    model = quality.train(docs, none)
    assert {r["score"] for r in quality.add_scores(docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(10)] * 2, "doc_id bigint, quality int")
    assert all(r["predicted"] == 1 for r in quality.add_scores(docs, quality.train(docs, one)).collect())
    assert quality.add_scores(docs.limit(0), model).count() == 0
    assert quality.keep_good(docs.withColumn("score", F.lit("x")), model).columns == [*docs.columns, "score"]


def test_hinge_descent_nears_the_optimum():
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(80)]
    signs = np.where(np.array([r.min() for r in rows]) < 3, 1.0, -1.0)
    ratio = np.ones(quality.DIMS + quality.RUNS)
    weights, bias = quality.descend(rows, signs, ratio, c=1.0, epochs=300)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, 30] = 1
    cost = np.where(signs > 0, 80 / (2 * (signs > 0).sum()), 80 / (2 * (signs < 0).sum()))
    v = np.append(weights[:30], bias)
    best = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - signs * (x @ v))).sum()
    for _ in range(200):
        assert best(v) <= best(v + rng.normal(0, 0.02, 31)) + 1e-3


# 6 ------------------------------------------------------------------------------------------

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], list(KINDS).index(x[0])))


def test_pii_base_spans():
    rng = random.Random(9)
    parts = ["a.b@c-d.com", "x@y", "@", "a@b.c@d.e", "1.2.3.4", "256.1.1.1", "9.1.2.3.4.5", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+12 3", " ", "é", "call ", "...", "12", "+", "%_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    for t in texts:
        assert [(k, a, b) for k, a, b, _ in pii.find_spans(t) if k in pii.BASE] == _base(t), t


def test_pii_added_spans():
    spans = {t: [s[0] for s in pii.find_spans(t)] for t in ("iban GB82 WEST 1234 5698 7654 32 ok", "iban GB82 WEST 1234 5698 7654 33 ok", "ssn 123-45-6789", "x 123-45-6789", "call 555-123-4567", None, "")}
    assert "iban" in spans["iban GB82 WEST 1234 5698 7654 32 ok"] and "iban" not in spans["iban GB82 WEST 1234 5698 7654 33 ok"]
    assert spans["ssn 123-45-6789"] == ["ssn"] and spans["x 123-45-6789"] == []
    assert spans["call 555-123-4567"] == ["local_phone"] and spans[None] == spans[""] == []


def test_pii_context_on_both_sides_and_secrets():
    kinds = lambda t: [k for k, *_ in pii.find_spans(t)]
    assert kinds("123-45-6789 is my ssn") == ["ssn"] and kinds("555-123-4567 is my phone") == ["local_phone"]
    assert kinds("123-45-6789" + " x" * 30 + " ssn") == []
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert kinds(f'token = "{key}" th') == ["secret"] and kinds(f"commit {key} th") == [] and kinds(f"commit {key} key") == []
    assert kinds("key " + "a1" * 20) == [] and kinds("key " + "abcdefghij" * 3) == [] and kinds("api key: Zx9/Kq3vB7tLw2RmN8sY== ok") == ["secret"]


def test_pii_recall_of_planted_added_kinds():
    rng = random.Random(18)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9)))
    made = {
        "iban": lambda: (_iban(rng.choice(["DE", "GB", "NO"]), digits(rng.choice([14, 18]))), ["iban", "bank", ""]),
        "ssn": lambda: (f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", ["ssn", "social"]),
        "local_phone": lambda: (f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{digits(4)}", ["phone", "call", "tel"]),
        "secret": lambda: ("".join(rng.choice("0123456789abcdef") for _ in range(40)), ["token", "key", "password"]),
    }
    for kind, make in made.items():
        caught = 0
        for _ in range(200):
            span, context = make()
            near, other = rng.choice(context), " ".join(word() for _ in range(3))
            parts = [near, other, span] if rng.random() < 0.5 else [span, other, near]
            text = " ".join([*(word() for _ in range(20)), *parts, *(word() for _ in range(20))])
            caught += any(k == kind and text[a:b] == span for k, a, b, _ in pii.find_spans(text))
        assert caught >= 190, (kind, caught)


def _iban(country, rest):
    """A valid IBAN: the check digits that mod-97 asks for."""
    value = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{country}{98 - value % 97:02d}{rest}"


def test_pii_ibans_before_and_after_other_words():
    for iban in ("DE89370400440532013000", "GB82WEST12345698765432", "NL91ABNA0417164300", "GB82 WEST 1234 5698 7654 32"):
        for before, after in (("", " BIC COBADEFFXXX"), ("", " 2024-01-02"), ("", " EUR 500"), ("", " I paid"), ("AB12 ", ""), ("REF XY99 ", " X"), ("(", ")")):
            text = before + iban + after
            assert [text[a:b] for k, a, b, _ in pii.find_spans(text) if k == "iban"] == [iban], text
    two = "DE89370400440532013000 NL91ABNA0417164300"
    assert [two[a:b] for k, a, b, _ in pii.find_spans(two) if k == "iban"] == two.split()
    assert not any(k == "iban" for k, *_ in pii.find_spans("DE89370400440532013001 BIC EUR 500"))


def test_pii_ibans_beside_base_spans():
    rng, both = random.Random(12), 0
    for _ in range(300):
        kinds = [k for k, *_ in pii.find_spans(_iban("NO", "".join(rng.choice("0123456789") for _ in range(11))))]
        assert "iban" in kinds
        both += "card" in kinds
    assert both


def test_pii_long_runs_are_linear():
    assert pii.find_spans("a" * 300_000 + "@") == []
    assert pii.find_spans("1" * 300_000) == []


def test_pii_rows(spark):
    got = pii.spans_of(docs_of(spark, [*ODD, "m@n.org"])).orderBy("doc_id").collect()
    assert len(got) == len(ODD) + 1 and got[-1]["spans"][0]["kind"] == "email"
    assert pii.spans_of(docs_of(spark, [])).count() == 0


# 7 ------------------------------------------------------------------------------------------


def test_attention_gradients():
    rng = np.random.default_rng(10)
    model = attention.start(rng.integers(1, 50, attention.IDS).astype(float))
    windows, aims, _ = attention.blocks([rng.integers(0, attention.IDS, n).astype(np.int16) for n in (30, 5, 49)])
    total = float((aims >= 0).sum())
    trainer = attention.Trainer(model)
    assert abs(trainer.slopes(windows, aims) + attention.Scorer(model).block_scores(windows, aims).sum() / total) < 1e-4
    caught = {k: v.copy() for k, v in trainer.g.items()}

    def loss(name, at, by):
        m = attention.Model({k: v.copy() for k, v in model.params.items()}, model.place)
        m.params[name][at] += by
        return -attention.Scorer(m).block_scores(windows, aims).sum() / total

    for name in attention.SHAPES:
        at = np.unravel_index(np.argmax(np.abs(caught[name])), caught[name].shape)
        slope = (loss(name, at, 0.05) - loss(name, at, -0.05)) / 0.1
        assert abs(slope - caught[name][at]) < 0.05 * abs(slope) + 1e-4, name


def test_attention_is_causal_and_a_distribution():
    model = attention.start(np.arange(1.0, attention.IDS + 1))
    scorer = attention.Scorer(model)
    head = np.array([5, 9, 700], dtype=np.int16)
    each = scorer.scores([np.append(head, np.int16(i)) for i in range(attention.IDS)]) - scorer.scores([head])
    assert abs(sum(10.0**each) - 1) < 1e-3
    long = np.random.default_rng(1).integers(0, attention.IDS, 200).astype(np.int16)
    w, a, _ = attention.blocks([long])
    w2, a2, _ = attention.blocks([long[:100]])
    assert np.allclose(scorer.block_scores(w, a)[:4], scorer.block_scores(w2, a2)[:4], atol=1e-4)


def test_attention_has_its_full_size():
    assert (attention.HIDDEN, attention.WINDOW) == (24, 32)
    ids = np.arange(60, dtype=np.int16)
    assert [(w.shape, a.shape) for w, a, _ in [attention.blocks([ids])]] == [((3, 32), (3, 24))]


def test_attention_learns():
    rng = np.random.default_rng(2)
    seqs = [np.tile([7, 8, 9, 10], 12).astype(np.int16) for _ in range(40)]
    model = attention.start(np.bincount(np.concatenate(seqs), minlength=attention.IDS).astype(float))
    trainer = attention.Trainer(model, rate=0.02)
    w, a, _ = attention.blocks(seqs)
    for _ in range(60):
        at = rng.permutation(len(w))[:32]
        trainer.step(w[at], a[at])
    assert attention.Scorer(trainer.model).scores(seqs[:1])[0] > attention.Scorer(model).scores(seqs[:1])[0] + 5


def test_lm_base_scores(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["the", "The", "cat", "É", "rare" + str(i)]) for _ in range(rng.randint(0, 30))) for i in range(40)] + ODD[:7]
    docs = docs_of(spark, texts).withColumn("word", F.lit("clash"))
    got = {r["doc_id"]: r for r in lm.score_documents(docs, content()).collect()}
    tokens = {i: WORDS.findall(low(t or "")) + ["\n"] for i, t in enumerate(texts)}
    learned = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(learned.values()), len(learned)
    assert len(got) == len(texts)
    for i, ws in tokens.items():
        want = sum(math.log10((learned[w] + 1) / (n + v + 1)) for w in ws)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(learned[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - want) < 1e-6 and r["score"] < 0 and r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)


def _naive_scores(model, ids):
    """Natural log probability of each id, position by position in plain loops."""
    p, n, out = {k: v.astype(float) for k, v in model.params.items()}, len(ids), []
    seen = [attention.END, *ids[:-1].tolist()]
    for at in range(n):
        begin = max(0, at // attention.STRIDE * attention.STRIDE - attention.CONTEXT)
        q = p["emb"][seen[at]] @ p["wq"]
        keys = range(begin, at + 1)
        logits = np.array([q @ (p["emb"][seen[j]] @ p["wk"]) / math.sqrt(attention.DIM) + p["near"][at - j] for j in keys])
        share = np.exp(logits - logits.max())
        share /= share.sum()
        mean = sum(a * (p["emb"][seen[j]] @ p["wv"]) for a, j in zip(share, keys, strict=True))
        h = np.tanh(p["emb"][seen[at]] @ p["w1"] + p["b1"] + mean @ p["w2"])
        klass, number = divmod(int(model.place[ids[at]]), attention.WIDE)
        outer, inner = h @ p["wc"] + p["bc"], h @ p["wi"][klass] + p["bi"][klass]
        out.append(outer[klass] - np.log(np.exp(outer).sum()) + inner[number] - np.log(np.exp(inner).sum()))
    return np.array(out)


def test_attention_is_what_plain_loops_give():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, attention.IDS, n).astype(np.int16) for n in (1, 23, 24, 25, 70)]
    model = attention.start(rng.integers(1, 50, attention.IDS).astype(float))
    trainer = attention.Trainer(model, rate=0.05)  # away from the start, where attention is even
    for _ in range(5):
        trainer.step(*attention.blocks(seqs)[:2])
    want = [_naive_scores(trainer.model, s).sum() / math.log(10) for s in seqs]
    assert np.allclose(attention.Scorer(trainer.model).scores(seqs), want, rtol=1e-4, atol=1e-4)


def test_lm_rounds_follow_from_the_words():
    assert lm.plan_rounds(0) == [(0.0, 1.0, 1)] and lm.plan_rounds(10, 100) == [(0.0, 1.0, 1)]
    assert lm.plan_rounds(100, 100) == [(0.0, 1.0, 1)]
    assert lm.plan_rounds(500, 100) == [(0.0, 0.2, 1), (0.2, 1.0, 2)]
    assert lm.plan_rounds(4100, 100) == [(0.0, 100 / 4100, 1), (100 / 4100, 900 / 4100, 4), (900 / 4100, 1.0, 8)]
    for words in (1, 10**6, 10**9, 10**13):
        rounds = lm.plan_rounds(words)
        assert [r[0] for r in rounds[1:]] == [r[1] for r in rounds[:-1]] and rounds[-1][1] == 1.0
        assert max(r[2] for r in rounds) <= 1 + words / lm.FIRST_WORDS and len(rounds) <= 10


def test_lm_trains_on_every_word_of_every_row(spark):
    coder = lm.Subwords(content())
    texts = [f"{w} {w}x and {w}" * (1 + i % 3) for i, w in enumerate(["cat", "É", "the"] * 20)] + ["a b " * 3000, "", None]
    ids = [len(coder.ids(lm.words_of(t))) for t in texts]
    counts = np.ones(attention.IDS)
    rows = pa.RecordBatch.from_arrays([pa.array([k // 20 for k in range(len(texts))]), pa.array(texts)], names=["shard", "text"])
    got = [(r["shard"], r["weight"]) for b in lm.learned(iter([rows[:7], rows[7:]]), attention.start(counts), coder) for r in b.to_pylist()]
    assert got == [(0, sum(ids[:20])), (1, sum(ids[20:40])), (2, sum(ids[40:60])), (3, sum(ids[60:]))]
    assert list(lm.learned(iter([rows[:0]]), attention.start(counts), coder)) == []


def _prose(n):
    rng = random.Random(17)
    likely = {w: rng.choices("abcdefghijklmnopqrst", k=3) for w in "abcdefghijklmnopqrst"}
    for i in range(n):
        words = ["a"]
        for _ in range(rng.randint(5, 120)):
            words.append(rng.choice(likely[words[-1]]))
        yield i, " ".join(words)


def test_lm_rounds_beat_the_start_and_ignore_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "plan_rounds", lambda words, f=lm.plan_rounds: f(words, 2_000))
    docs = spark.createDataFrame(list(_prose(400)), "doc_id bigint, text string")
    n = sum(len(t.split()) + 1 for _, t in _prose(400))
    assert len(lm.plan_rounds(n)) == 3  # several rounds of several shards
    runs = []
    for layout in (docs.coalesce(1), docs.repartition(8, "text")):
        runs.append({r["doc_id"]: (r["score"], r["base_score"]) for r in lm.score_documents(layout, content()).collect()})
    assert all(abs(runs[0][i][0] - runs[1][i][0]) < 1e-4 * abs(runs[0][i][0]) for i in runs[0])
    monkeypatch.setattr(lm, "train", lambda docs, counts, words, ranks: attention.start(counts))
    untrained = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, content()).collect()}
    held = [i for i in untrained if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(runs[0][i][0] for i in held) > sum(untrained[i] for i in held)  # by few steps


def test_lm_training_shows_on_held_out_rows(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 8)
    coder = lm.Subwords(content())
    ids = {i: coder.ids(lm.words_of(t)) for i, t in _prose(400)}
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [t for i, t in _prose(400) if i not in held]
    first = attention.start(np.bincount(np.concatenate([ids[i] for i in ids if i not in held]), minlength=attention.IDS).astype(float))
    (batch,) = lm.learned(iter([pa.RecordBatch.from_arrays([pa.array([0] * len(rows)), pa.array(rows)], names=["shard", "text"])]), first, coder)
    (r,) = batch.to_pylist()
    model = first.with_flat(np.frombuffer(r["flat"]) / r["weight"])
    before, after = (attention.Scorer(m).scores([ids[i] for i in held]).sum() for m in (first, model))
    assert after > 0.8 * before


def test_lm_ids_of_any_type(spark):
    docs = spark.createDataFrame([("x1", "one two"), ("x2", "three"), (None, "four")], "doc_id string, text string")
    got = {r["doc_id"]: r["held_out"] for r in lm.score_documents(docs, content()).collect()}
    assert got == {i: zlib.crc32(i.encode()) % 7 == 2 for i in ("x1", "x2")} | {None: False}


def test_lm_rare_words_take_the_join(spark, monkeypatch):
    docs = docs_of(spark, ["a a a a b c", "a b d", "e a", "x y z"])
    want = {r["doc_id"]: r["base_score"] for r in lm.score_documents(docs, content()).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 3)
    got = {r["doc_id"]: r["base_score"] for r in lm.score_documents(docs, content()).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_lm_defined_cases(spark):
    assert lm.score_documents(docs_of(spark, []), content()).count() == 0
    nulls = docs_of(spark, [None, None]).withColumn("doc_id", F.lit(None).cast("long"))
    rows = lm.score_documents(nulls, content()).collect()
    assert len(rows) == 2 and all(r["n_tokens"] == 1 and r["held_out"] is False and r["train_tokens"] == 2 for r in rows)


def test_attention_steps_use_their_arrays_again():
    rng = np.random.default_rng(4)
    windows, aims, _ = attention.blocks([rng.integers(0, attention.IDS, attention.STRIDE * 256).astype(np.int16)])
    trainer = attention.Trainer(attention.start(np.ones(attention.IDS)))
    trainer.step(windows, aims)
    tracemalloc.start()
    trainer.step(windows, aims)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20  # 256 windows of weights, units and classes are more than that by themselves


def test_lm_encodes_different_words_of_a_batch_once(monkeypatch):
    coder = lm.Subwords(content())
    texts = [*ODD, "  b a\x0bA", "x\x1cy \u00a0z", "zoë zoë " * 50]
    batch = pa.array(["left out", *texts])[1:]
    want = [coder.ids(lm.words_of(t)) for t in texts]
    got = coder.rows(*lm.split(batch), len(batch))
    assert len(got) == len(want) and all(map(np.array_equal, got, want))
    rows = pa.RecordBatch.from_arrays([pa.array([0] * len(texts)), batch], names=["shard", "text"])
    monkeypatch.setattr(lm, "words_of", None)  # no text is cut word by word
    (out,) = lm.learned(iter([rows]), attention.start(np.ones(attention.IDS)), coder)
    assert out.to_pylist()[0]["weight"] == sum(map(len, want))


# 8 ------------------------------------------------------------------------------------------


def _tile_brute(doc, item, least):
    """Greedy string tiling by trying all pairs of starts each time."""
    fd, fi, out = [w > 0 for w in doc], [w > 0 for w in item], []
    while True:
        best = []
        longest = least - 1
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and fd[i + n] and fi[j + n]:
                    n += 1
                if n > longest:
                    longest, best = n, []
                if n == longest and n >= least:
                    best.append((i, j))
        if not best:
            return out
        for i, j in best:
            if all(fd[i : i + longest]) and all(fi[j : j + longest]):
                out.append((i, j, longest))
                fd[i : i + longest] = [False] * longest
                fi[j : j + longest] = [False] * longest


def test_tiling_covers_what_brute_force_does():
    rng = random.Random(12)
    for _ in range(300):
        doc, item = ([rng.randint(0, 4) for _ in range(rng.randint(0, 40))] for _ in range(2))
        for least in (2, 3):
            got, want = decontaminate.tile(doc, item, least), _tile_brute(doc, item, least)
            assert got == want


def test_items_match_what_tiling_of_whole_texts_does():
    rng = random.Random(13)
    text = lambda n, k: " ".join(f"v{rng.randint(0, k)}" for _ in range(n))
    found = 0
    for _ in range(60):
        benchmark = [(j, text(rng.randint(0, 30), 2)) for j in range(4)]
        words = text(rng.randint(0, 60), 3).split()
        for _, t in benchmark[:2]:  # passages in another order
            part = t.split()
            cut = rng.randint(0, len(part))
            words += part[cut:] + ["x"] + part[:cut]
        items = decontaminate.Items(benchmark)
        want = []
        for j, t in benchmark:
            ids = {w: k + 1 for k, w in enumerate(dict.fromkeys(t.split()))}
            item = [ids[w] for w in t.split()]
            tiles = _tile_brute([ids.get(w, 0) for w in words], item, min(decontaminate.SEED, len(item))) if item else []
            covered = sum(n for *_, n in tiles)
            if item and covered >= decontaminate.COVERAGE * len(item):
                want.append((j, covered / len(item), len(tiles), max(n for *_, n in tiles)))
        assert items.matches(" ".join(words)) == want
        found += len(want)
    assert found > 40


@pytest.mark.parametrize("text", ["a " * 100_000, "a " * 30 + "b " + "a b " * 50_000, " ".join(["a " * 30 + "b"] * 3_000)])
def test_tiling_of_long_repetitive_texts(text):
    items = decontaminate.Items([(k, ("a " * 100 if k % 2 else "a b " * 60)) for k in range(6)])
    began = time.process_time()
    assert items.matches(text)
    assert time.process_time() - began < 15


def test_decontamination(spark):
    words = [f"t{i}" for i in range(40)]
    item, other = " ".join(words), "only four words here"
    noise = " ".join(f"n{i}" for i in range(50))
    texts = [
        noise + " " + item.upper() + ", " + noise, noise, " ".join(words[20:] + ["x"] + words[:20]), " ".join(words[:10]),
        f"a {other}. b", None, "", LONG, noise + " " + item.upper() + ", " + noise,
    ]
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (1, item)], "item_id bigint, text string")
    docs = docs_of(spark, texts).withColumn("coverage", F.lit(0))
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == Counter({(0, 1): 2, (2, 1): 2, (4, 2): 1, (8, 1): 2})
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 5, 6, 7}


def test_decontamination_in_blocks_and_empty(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(20)], "item_id bigint, text string")
    docs = docs_of(spark, ["pre " + " ".join(f"w{i}x{k}" for k in range(12)) for i in range(20)] + ["clean"])
    monkeypatch.setattr(decontaminate, "item_blocks", lambda b, f=decontaminate.item_blocks: f(b, 300))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(i, i) for i in range(20)}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()] == [20]
    named = bench.withColumn("item_id", F.concat(F.lit("k"), "item_id"))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, named).collect()} == {(i, f"k{i}") for i in range(20)}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


# 9 ------------------------------------------------------------------------------------------


def _simhash(t):
    w = WORDS.findall(low(t or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(fps):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash_groups(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(25):
        base = [rng.choice("abcdefghijklm") * rng.randint(1, 3) for _ in range(300)]
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            words[rng.randrange(300)] = "edit"
            texts.append(" ".join(words))
    texts += ODD + ["one", "one two", "two one"]
    want = [_simhash(t) for t in texts]
    assert [simhash.simhash(t) for t in texts] == want
    groups = _groups(want)
    docs = docs_of(spark, texts).withColumn("fp", F.lit("clash"))
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_groups(docs).collect()}
    assert got == {i: (want[i], groups[i]) for i in range(len(texts))}
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(groups))


def test_simhash_links_inside_large_groups(monkeypatch):
    rng = np.random.default_rng(14)
    fps = []
    for b in rng.integers(0, 1 << 64, 60, dtype=np.uint64).tolist():
        for _ in range(40):
            y = b
            for k in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                y ^= 1 << k
            fps.append(y)
    xs = np.unique(np.array(fps, dtype=np.uint64))
    want = _groups(xs.tolist())

    def grouped(a, b):
        at = {int(x): i for i, x in enumerate(xs)}
        up = list(range(len(xs)))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            i, j = at[x], at[y]
            while up[i] != i:
                i = up[i]
            while up[j] != j:
                j = up[j]
            up[max(i, j)] = min(i, j)
        out = []
        for i in range(len(xs)):
            while up[i] != i:
                i = up[i]
            out.append(i)
        return out

    assert grouped(*simhash.links_within(np.zeros(len(xs), np.int64), xs, simhash.pivot_table(xs))) == want
    monkeypatch.setattr(simhash, "REFINE", 30)
    a, b = simhash._refined(xs, simhash.pivot_table(xs), list(range(64)), 3)
    assert grouped(a, b) == want and len(a) < 60 * len(xs)


def test_simhash_defined_cases(spark):
    assert simhash.near_groups(docs_of(spark, [])).count() == 0
    assert simhash.keep_one(docs_of(spark, [])).count() == 0
    rows = docs_of(spark, ["a b c d", None])
    doubled = rows.unionByName(rows)
    assert simhash.near_groups(doubled).count() == 4 and simhash.keep_one(doubled).count() == 2
    nameless = doubled.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r["component_id"] for r in simhash.near_groups(nameless).collect()} == {None}
    assert simhash.keep_one(nameless).count() == 4
    mixed = rows.unionByName(docs_of(spark, ["a b c d", "quite another text here"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(mixed).collect() if r["doc_id"] is not None) == [(0, "a b c d"), (1, None)]
    assert [r["text"] for r in simhash.keep_one(mixed).collect() if r["doc_id"] is None] == ["quite another text here"]


def test_simhash_ids_and_clashing_names(spark):
    docs = spark.createDataFrame([("b", "x y z", 1, 2), ("a", "x  Y z", 1, 2), ("c", "other words here", 1, 2), (None, "p q r", 1, 2)], "doc_id string, text string, _drop int, _fp int")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()} == {"a": "a", "b": "a", "c": "c", None: None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {"a", "c", None}


# 10 -----------------------------------------------------------------------------------------


def _kept(texts):
    seen, out = set(), []
    words = [WORDS.findall(t or "") for t in texts]
    for w in words:
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substring_dedup(spark):
    rng = random.Random(15)
    pool = [[f"p{p}w{i}" for i in range(rng.randint(18, 70))] for p in range(8)]
    texts = []
    for d in range(80):
        words = []
        for _ in range(rng.randint(0, 4)):
            a = rng.choice(pool)
            i = rng.randrange(len(a))
            words += a[i : i + rng.randint(5, 60)] + [f"d{d}u{rng.randrange(99)}" for _ in range(rng.randint(0, 5))]
        texts.append(rng.choice([" ", "\n", "\t"]).join(words))
    texts += [*ODD, "r " * 100, "r " * 45, texts[0], texts[0]]
    docs = docs_of(spark, texts).withColumn("kept_text", F.lit("clash"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == _kept(texts)


def test_substring_dedup_in_many_buckets(spark, monkeypatch):
    rng = random.Random(16)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"d{d}u{k}" for k in range(rng.randint(0, 40))] + passage[rng.randint(0, 20) : rng.randint(30, 60)]) for d in range(60)]
    want = _kept(texts)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 64)
    docs = docs_of(spark, texts).repartition(7)
    assert substring_dedup._bucket_count(docs) > 100
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_substring_dedup_ids_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([("b", text, 1, 2, 3, 4), ("a", text + " x", 1, 2, 3, 4), ("c", text, 1, 2, 3, 4)], "doc_id string, text string, _order int, _cuts int, _i int, _h int")
    got = {r["doc_id"]: (r["n_removed"], r["_order"], r["_cuts"], r["_i"], r["_h"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {"a": (0, 1, 2, 3, 4), "b": (30, 1, 2, 3, 4), "c": (30, 1, 2, 3, 4)}


def test_substring_dedup_defined_cases(spark):
    assert substring_dedup.remove_repeats(docs_of(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = docs_of(spark, [text])
    for both in (rows.unionByName(rows), rows.unionByName(rows).coalesce(1)):
        assert [r["n_removed"] for r in substring_dedup.remove_repeats(both).collect()] == [0, 0]
    nameless = docs_of(spark, [text + " end"]).withColumn("doc_id", F.lit(None).cast("long"))
    mixed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(rows.unionByName(nameless)).collect()}
    assert mixed == {0: 0, None: 30}


def test_packing():
    for a in ([], [5], [9, 2, 2**40, -3, 0]):
        assert substring_dedup._unpack(substring_dedup._pack(np.array(a, dtype=np.int64))).tolist() == a


def test_result_columns_replace_those_of_any_case(spark):
    rules = spark.createDataFrame([("org", "/", "block")], "rule_host string, rule_path string, rule_verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/x", "own")], "page_id int, url string, Rule string")
    assert url_filter.apply_rules(pages, rules).select("rule", "verdict").first()[:] == ("org/", "block")
    docs = spark.createDataFrame([(1, "a\nb", 7, 8)], "doc_id int, text string, N_Lines int, Kept_Text int")
    assert line_dedup.drop_common_lines(docs).select("n_lines", "kept_text").first()[:] == (2, "a\nb")
    docs = spark.createDataFrame([(1, "a b", 7)], "doc_id int, text string, N_Words int")
    assert substring_dedup.remove_repeats(docs).select("n_words", "kept_text").first()[:] == (2, "a b")


def test_no_word_outvotes_a_checksum():
    for text in ("DE89 3704 0044 0532 0130 00 2024 invoice", "order page version example DE89370400440532013000"):
        assert "iban" in {k for k, *_ in pii.find_spans(text)}


def test_quality_sample_is_bounded_and_takes_any_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", ("good words here " if i % 2 else "xq zz kk ") * 5) for i in range(60)] + [("d1", "good words here " * 5)] * 3, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(60)], "doc_id string, quality int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in quality.add_scores(docs, model).collect()}
    assert all(got[f"d{i}"] == i % 2 for i in range(60))
    few = quality.train(docs, labels, places=1)  # the first row always stays
    assert not few.weights.any() and few.slope == 1.0
