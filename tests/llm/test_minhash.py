"""MinHash near-duplicates against the similarity of all pairs."""

import numpy as np

from glossaflow.llm import minhash as M


def _sets(rows):
    out = []
    for i, t in rows:
        words = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        out.append((i, {tuple(words)} if 0 < len(words) < 4 else {tuple(words[k : k + 4]) for k in range(len(words) - 3)}))
    return out


def _brute(rows):
    sets = _sets(rows)
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and root(i) != root(j):
                low, high = sorted((root(i), root(j)))
                up[high] = low
    return {(i, len(s), root(i), root(i) == i) for i, s in sets}


def _made(seed=3):
    """Originals with edits around the threshold, chains of edits, copies, and texts of few words."""
    rng = np.random.default_rng(seed)
    words = np.array([f"v{i}" for i in range(400)])
    rows, texts = [], []
    for _ in range(40):
        base = rng.choice(words, size=rng.integers(6, 150)).tolist()
        for _ in range(int(rng.integers(1, 6))):
            text = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 12)))):
                text[rng.integers(0, len(text))] = str(rng.choice(words))
            texts.append(" ".join(text))
            if rng.random() < 0.4:
                base = text
    texts += ["a b c d e", "A  b c d\te", "a b c d e f", "a", "A", "a b", "", None, "  ", "a b c d", "ä b c d", "Ä b c d"]
    texts += texts[:7]
    order = rng.permutation(len(texts))
    return [(int(i) + 10, texts[k]) for i, k in enumerate(order)] + rows


def test_groups_match_all_pairs(spark):
    rows = _made()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {tuple(r) for r in M.near_groups(docs).collect()}
    assert got == _brute(rows)
    kept = {r["doc_id"] for r in M.keep_one(docs).collect()}
    assert kept == {i for i, _, _, first in _brute(rows) if first}


def test_a_large_loose_group_in_rounds_and_chunks(spark, monkeypatch):
    """Texts that are linked to some of a group alone, and many that are linked to none of it."""
    rng = np.random.default_rng(9)
    words = np.array([f"u{i}" for i in range(900)])
    base = rng.choice(words, size=120)
    rows = []
    for i in range(160):
        text = base.copy()
        at = rng.choice(len(base), size=int(rng.integers(1, 12)), replace=False)
        text[at] = rng.choice(words, size=len(at))
        rows.append((i, " ".join(text)))
    want = _brute(rows)
    assert 1 < len({r[2] for r in want}) < 120
    monkeypatch.setattr(M, "ROUNDS", 1)
    monkeypatch.setattr(M, "CHUNK", 16)
    assert {tuple(r) for r in M.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == want


def test_sketches_agree_as_sets_do():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 40, 300, 3000):
        hashes = rng.integers(0, 1 << 63, size, dtype=np.int64)
        assert (M.sketch(hashes) == M.sketch(hashes[::-1].copy())).all()
        means = []
        for _ in range(30):
            a = rng.integers(0, 1 << 63, size, dtype=np.int64)
            b = np.concatenate((a[: size - size // 5], rng.integers(0, 1 << 63, size // 5, dtype=np.int64)))
            real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            means.append(M.agreement(M.sketch(a), M.sketch(b)) / M.SKETCH - real)
        assert abs(np.mean(means)) < 0.03 and np.abs(means).max() < 0.1


def test_defined_cases(spark):
    assert M.near_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    text = "one two three four five"
    rows = [("b", text, 1, 2), ("a", text, 1, 2), ("a", text, 1, 2), ("a", "of another id alike", 1, 2), (None, text, 1, 2), (None, "x y z w", 1, 2), ("c", None, 1, 2), ("d", "", 1, 2), ("e", "w " * 50_000, 1, 2)]
    docs = spark.createDataFrame(rows, "key string, body string, root int, N_Shingles int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_groups(docs, "body", "key").collect()), key=str)
    want = [("b", 2, "a", False), ("a", 2, "a", True), ("a", 2, "a", True), ("a", 1, "a", True), (None, 2, "a", False), (None, 1, None, True), ("c", 0, "c", True), ("d", 0, "d", True), ("e", 1, "e", True)]
    assert got == sorted(want, key=str)
    kept = M.keep_one(docs, "body", "key")
    assert kept.columns == docs.columns
    assert {(r["key"], r["body"]) for r in kept.collect() if r["key"] != "e"} == {("a", text), ("a", "of another id alike"), (None, "x y z w"), ("c", None), ("d", "")}
    assert kept.count() == 6
