"""Whitening against plain numpy over all rows at once."""

import math

import numpy as np
import pytest

from glossaflow.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def _brute(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return values, centred @ axes / np.sqrt(values), deviation, values / values.sum()


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(400, 40)) @ rng.normal(size=(40, 40))).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)]
    bad = [(900, None, 1), (901, [None] * 40, 1), (902, [math.nan] * 40, 1), (903, [math.inf] + [0.0] * 39, 1), (904, [1.0, 2.0], 1), (905, [], 1)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(7)
    got = W.whiten(df).collect()
    values, whitened, deviation, shares = _brute(vectors)
    assert len(got) == 400 * 32
    table = np.zeros((400, 32))
    for r in got:
        assert r["n"] == 400 and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
        table[r["vec_id"], r["component"] - 1] = r["whitened"]
    signs = np.sign((table * whitened[:, :32]).sum(axis=0))
    assert np.allclose(table * signs, whitened[:, :32], atol=1e-8)


def test_moments_merge_as_if_computed_at_once():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(1000, 6)) * 64)
    parts = [W.Moments.of(p, True) for p in np.array_split(x, 13)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.merge(p)
    assert merged.n == 1000 and list(merged.sums) == x.astype(int).sum(axis=0).tolist()
    assert np.allclose(merged.mean, x.mean(axis=0), rtol=1e-12)
    assert np.allclose(merged.scatter, np.cov(x.T, bias=True) * 1000, rtol=1e-10)


def test_no_rows_equal_rows_and_few_directions(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert W.whiten(none).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)).count() == 0
    # Two dimensions that move as one have one component; its values have the covariance of the identity.
    got = W.whiten(spark.createDataFrame([(i, [float(i), float(i), 3.0], 0) for i in range(9)], SCHEMA)).collect()
    assert len(got) == 9 and {r["component"] for r in got} == {1}
    assert sum(r["whitened"] ** 2 for r in got) / 9 == pytest.approx(1)


def test_other_ids_clashing_names_and_repeated_rows(spark):
    schema = "key string, v array<double>, component int, n bigint, Whitened double, vec_id double"
    rows = [("a", [1.0, 0.0], 5, 5, 5.0, 5.0), ("a", [1.0, 0.0], 5, 5, 5.0, 5.0), (None, [0.0, 3.0], 5, 5, 5.0, 5.0), ("b", [2.0, 9.0], 5, 5, 5.0, 5.0)]
    got = W.whiten(spark.createDataFrame(rows, schema), "v", "key").collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["None"] * 2 + ["a"] * 4 + ["b"] * 2
    assert all(r["n"] == 4 for r in got)


def test_deviations_beyond_a_long_stay_exact_or_become_null():
    learnt = W.Whitening(10**6, (10**12, 0), np.eye(2), np.ones(2), 2.0)
    x = np.array([[1_000_003.0, 0.0], [1_000_000.0 + 2**40, 0.0]])
    assert learnt.deviations(x) == [9 * 10**12, None]
