"""Ranked search against plain scoring of every document."""

import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glossaflow.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def _brute(docs, items, k=20):
    bags = [(i, _terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = set()
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 75 + 25 * len(b) * n_docs // total
            score = 0
            for t in _terms(text):
                if t in df:
                    tf = b.count(t)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, i))
        out |= {(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])}
    return out


def _made(seed, count, words):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" if i % 3 else f"É{i}x" for i in range(words)])
    odds = 1 / np.arange(1, words + 1)
    return [(int(i), " ".join(rng.choice(vocabulary, size=rng.integers(0, 60), p=odds / odds.sum()))) for i in range(count)]


def test_matches_plain_scoring(spark, monkeypatch):
    docs = _made(1, 500, 80) + [(600 + i, "w1 w2, W2! w4") for i in range(40)] + [(700, None), (701, ""), (702, "--- !!")]
    items = [(i, t) for i, t in _made(2, 25, 90)] + [(90, None), (91, "unheard-of"), (92, "w1 w1 w1 w2")]
    for rows, postings in ((1 << 16, 1 << 22), (64, 900)):
        monkeypatch.setattr(L, "SHARD_ROWS", rows)
        monkeypatch.setattr(L, "SHARD_POSTINGS", postings)
        a = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
        got = L.rank(a, spark.createDataFrame(items, "item_id bigint, text string"))
        assert {tuple(r) for r in got.collect()} == _brute(docs, items)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEM_CHARS", 600)
    docs, items = _made(3, 120, 40), _made(4, 30, 40)
    got = L.rank(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {tuple(r) for r in got.collect()} == _brute(docs, items)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), max_size=12), min_size=1, max_size=4), st.integers(0, 80), st.integers(1, 3), st.integers(1, 4))
def test_blocks_are_the_best_of_all_cuts(lists, fixed, grain, longest):
    values = np.array([v for part in lists for v in part], np.int64)
    starts = np.concatenate(([0], np.cumsum([len(part) for part in lists])))
    ends = L.block_ends(values, starts, fixed, grain, longest).tolist()

    def least(part):
        best = {0: 0}
        for j in range(1, len(part) + 1):
            if j % grain and j < len(part):
                continue
            best[j] = min(best[i] + max(part[i:j]) * (j - i) + fixed for i in range(0, j, grain) if -(-(j - i) // grain) <= longest and i in best)
        return best[len(part)]

    for part, a, b in zip(lists, starts, starts[1:], strict=False):
        own = [e for e in ends if a < e <= b]
        assert not part or own[-1] == b
        assert all((e - a) % grain == 0 or e == b for e in own)
        cuts = [a, *own]
        assert sum(max(values[x:y]) * (y - x) + fixed for x, y in zip(cuts, own, strict=False)) == least(part)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 400))
def test_search_in_a_shard_skips_nothing_of_the_best(seed, k, count):
    rng = np.random.default_rng(seed)
    held = rng.random((count, 6)) < rng.random(6)
    doc, term = np.nonzero(held)
    impact = rng.integers(0, rng.integers(2, 1000), len(doc))
    times = rng.integers(1, 4, 6)
    shard = L.Shard.of(doc, term, impact, 6)
    docs, scores = shard.best(np.arange(6), times, k)
    full = np.zeros(count, np.int64)
    np.add.at(full, doc, impact * times[term])
    want = [(int(full[i]), int(i)) for i in np.lexsort((np.arange(count), -full)) if full[i] > 0][:k]
    assert list(zip(scores.tolist(), docs.tolist(), strict=True)) == want


def test_blocks_below_the_threshold_stay_unread():
    """One list with a few great impacts: most of its blocks are never touched."""
    count = 200_000
    impact = np.ones(count, np.int64)
    impact[5_000:5_040] = 1_000
    shard = L.Shard.of(np.arange(count), np.zeros(count, np.int64), impact, 1)
    touched = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            touched.append(np.size(at))
            return np.asarray(self)[at]

    object.__setattr__(shard, "impact", shard.impact.view(Watched))
    docs, _ = shard.best(np.array([0]), np.array([1]), 20)
    assert docs.tolist() == list(range(5_000, 5_020))
    assert sum(touched) < count / 2


def test_defined_cases(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", "one two", 1), ("a", "two", 2), (None, "one", 3), ("a", "one two", 9)], "item_id string, text string, rank int")
    assert L.rank(empty, items).count() == 0
    docs = spark.createDataFrame([("x", "one one", 1), (None, "one one", 1), ("x", "one one", 1), ("y", "two", 1), ("z", "x" * 300_000 + " one", 1)], "doc_id string, text string, score int")
    assert L.rank(docs, items.limit(0)).count() == 0
    got = [tuple(r) for r in L.rank(docs, items).collect()]
    by = {}
    for i, r, d, s in sorted(got, key=lambda x: (str(x[0]), x[1])):
        by.setdefault(i, []).append((r, d))
    assert [d for _, d in by[None]] == ["x", "x", None, "z"]
    assert sorted(by["a"])[:2] == [(1, "y"), (1, "y")] and len(by["a"]) == 6
