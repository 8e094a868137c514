"""The pipeline against its stages done by hand, and the registered queries on the smallest tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from glossaflow.llm import bpe, decontaminate, near_copies, quality, simhash, sketches
from tests.test_entry import SF, _rows, duck  # noqa: F401

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 5)))
    item = " ".join(f"bench{i}" for i in range(20))
    rows, labels = [], []
    for i in range(90):
        good = i % 4 != 0
        lines = [" ".join(word() + ("" if good else rng.choice(["***", "###"])) for _ in range(40)) for _ in range(3)]
        if i % 3 == 0:
            lines.insert(1, "Shared  Footer line")
        if i % 10 == 1:
            lines.append(item)
        rows.append((i, "\n".join(lines), "en", "s", 0))
        labels.append((i, int(good), 0))
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in (1, 2, 3)] + [(200, None, None, None, None), (201, "", "en", "s", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item


def test_pipeline(spark, tables):
    path, rows, item = tables
    model = quality.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    docs = {i: t or "" for i, t, *_ in rows if model.score(t) >= 0.5}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    seen = Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")} if k)
    docs = {i: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10) for i, t in docs.items()}
    fps = {i: simhash.simhash(t) for i, t in docs.items()}
    kept: dict[int, str] = {}
    for i in sorted(docs):  # groups here are no chains: each member is near the first
        if not any((fps[i] ^ fps[j]).bit_count() <= 3 for j in kept):
            kept[i] = docs[i]
    items = decontaminate.Items([(7, item)])
    kept = {i: t for i, t in kept.items() if not items.matches(t)}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.Ranks.parse(f.read()).ids
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == set(kept)
    for i, t in kept.items():
        assert got[i]["ids"] == library.encode_ordinary(t) and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark, tables):
    path, *_ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and "quality" in names[0] and "line" in names[1] and "SimHash" in names[2] and "benchmark" in names[3] and "BPE" in names[4]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        assert stage(spark, docs.limit(0), path).count() == 0


def _kept(texts):
    """Ids to stay, by brute force over all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i for i in texts if root(i) == i}


def test_near_dedup_links_five_word_similarity(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    texts = [None, "", "a b c", "A  b c", "a b c d", "a b c d e", "a b c d e f"]
    for size in (12, 40, 150, 600):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for edits in (0, 1, 2, size // 60, size // 40, size // 30):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = word()
                texts.append(" ".join(copy[: len(copy) - rng.randrange(3)]))
    core = [word() for _ in range(60)]
    for _ in range(80):  # share most shingles, and are not all similar
        texts.append(" ".join([word() for _ in range(rng.randrange(8))] + core + [word() for _ in range(rng.randrange(8))]))
    rng.shuffle(texts)
    want = _kept(dict(enumerate(texts)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS)
    monkeypatch.setattr(near_copies, "SAMPLED", 2)
    for chunk in (near_copies.CHUNK, 3):
        monkeypatch.setattr(near_copies, "CHUNK", chunk)
        dealt = near_copies.marked(docs).filter("array_max(chunks) > 1").count()
        assert dealt > 10 if chunk == 3 else not dealt
        got = corpus_pipeline.one_of_each(spark, docs, "")
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)
    near = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert len(near) > len(want)  # 3 bits leave copies apart


def test_near_dedup_meets_many_of_a_shingle(monkeypatch):
    rng = np.random.default_rng(3)
    n, p = np.sort(rng.integers(40, 60, 50)), rng.integers(0, 8, 50)
    for few in (2, 4, 60):
        monkeypatch.setattr(near_copies, "FEW", few)
        large = np.full(50, few < 50)
        pairs = [(a, b) for x, y in near_copies._few_and_first(np.zeros(50, int), large, n, p) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(pairs) <= 2 * 50 if few < 50 else len(pairs) > 2 * 50


def test_fingerprints_of_near_sets_are_near():
    rng = np.random.default_rng(4)
    for n in (32, 60, 200, 3000):
        prints = []
        for _ in range(40):
            base = rng.integers(-(2**63), 2**63, n)
            other = np.concatenate((base[: -(n // 9)], rng.integers(-(2**63), 2**63, n // 9)))  # a similarity of 0.8
            prints.append([near_copies.fingerprint(x) for x in (base, other)])
        bits = [int(np.bitwise_count(a ^ b).sum()) for a, b in prints]
        assert max(bits) < near_copies.FAR - 10
        apart = [int(np.bitwise_count(prints[k][0] ^ prints[k - 1][0]).sum()) for k in range(40)]
        assert min(apart) > near_copies.FAR
        d = near_copies.pivot_distances(np.stack([x for pair in prints for x in pair])).astype(int)
        assert np.abs(d[::2] - d[1::2]).max() <= max(bits)
    whole = rng.integers(-(2**63), 2**63, 9001)
    ones = sum(np.unpackbits(near_copies.fingerprint(whole[k : k + 1]).view(np.uint8), bitorder="little").astype(int) for k in range(9001))
    assert np.array_equal(np.packbits(2 * ones > 9001, bitorder="little").view("<u8"), near_copies.fingerprint(whole))


def test_near_dedup_ids_and_clashing_names(spark):
    text = " ".join(f"t{i}" for i in range(50))
    docs = spark.createDataFrame([("b", text, 1, 2, 3), ("a", text + " x", 1, 2, 3), ("c", "other", 1, 2, 3)], "doc_id string, text string, _raw int, _drop_id int, node int")
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == ["a", "c"]


def test_near_dedup_keeps_unique_texts_of_repeated_ids(spark):
    long = " ".join(f"t{i}" for i in range(50))
    rows = [(1, long), (2, long + " x"), (2, "quite another text"), (3, "p q r"), (3, "s t u"), (4, "k l m"), (4, "k l m"), (None, "k  l m"), (None, "n o p"), (None, "n o p")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    got = Counter((r["doc_id"], r["text"]) for r in near_copies.keep_one(docs).collect())
    assert got == Counter([(1, long), (2, "quite another text"), (3, "p q r"), (3, "s t u"), (4, "k l m"), (None, "n o p"), (None, "n o p")])


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n[:2] == "op" or n == "pipeline"))
def test_query(spark, duck, name):  # noqa: F811
    got = entry.queries()[name](spark, SF)
    frame = got.toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(frame)
    else:
        columns = sorted(got.columns)
        assert _rows(frame, columns) == _rows(duck.sql(sql).df(), columns)


def test_packed_sketches_and_rows_of_the_last_meeting(spark, monkeypatch):
    rng = np.random.default_rng(8)
    for real, n in ((0.8, 900), (0.8, 90), (0.6, 900)):
        shared = round(2 * n * real / (1 + real))
        means = []
        for _ in range(20):
            h = rng.integers(-(1 << 63), 1 << 63, 2 * n - shared)
            a, b = (sketches.packed(sketches.sketch(x)) for x in (h[:n], h[n - shared :]))
            assert a.nbytes == 256
            means.append(int(sketches.packed_agreement(a.view(np.uint64), b.view(np.uint64))))
        assert abs(np.mean(means) / sketches.SKETCH - (real + (1 - real) / 4)) < 0.01
        assert (min(means) >= sketches.LEAST_PACKED) == (real == 0.8)

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([f"x{k}", *words, f"y{k}"]) for k in range(7)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS)
    once = near_copies.marked(docs)
    rows = once.selectExpr("posexplode(keys) AS (p, key)", "n", "node").selectExpr("key", "n", "CAST(p AS BIGINT) AS p", "node", "node AS label")
    apart = rows.join(rows.groupBy("key").count().filter("count > 1").select("key"), "key")
    source = docs.selectExpr("doc_id AS id", "xxhash64(text) AS raw", "text")
    for chunk in (near_copies.CHUNK, 3):
        monkeypatch.setattr(near_copies, "CHUNK", chunk)
        met = near_copies._meeting_rows(apart, once, source)
        held = {(r["node"], r["p"]): r["key"] for r in apart.collect()}
        found = met.collect()
        assert {len(r["sketch"]) for r in found} == {256}
        assert all(set(r["before"]) == {k for (node, p), k in held.items() if node == r["node"] and p < r["p"]} for r in found)
        pairs = [(r["a"], r["b"]) for r in met.mapInArrow(near_copies._last_meeting, near_copies._PAIR).collect()]
        assert len(pairs) == len(set(pairs)) == 21  # each pair leaves one task alone
