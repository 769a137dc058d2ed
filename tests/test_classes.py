"""Groups and maps of classes against numpy."""

import itertools

import numpy as np
import pytest

from tallyloom.operators import classes as cl


def gram_of(spark, x):
    names = [f"c{i:02d}" for i in range(len(x))]
    rows = [(names[i], f"w{j}", float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if x[i, j] != 0]
    shares = spark.createDataFrame(rows, "source string, word string, p double")
    return names, shares, cl.class_gram(shares, "source")


def brute_ward(x, k):
    """Greedy merging of the two clusters whose union adds least to the squares."""
    clusters, heights = [[i] for i in range(len(x))], []
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
    cut = None
    while len(clusters) > 1:
        if len(clusters) == k:
            cut = sorted(map(sorted, clusters))
        a, b = min(itertools.combinations(clusters, 2), key=lambda p: cost(*p))
        heights.append(cost(a, b))
        clusters = [c for c in clusters if c not in (a, b)] + [a + b]
    return cut, sorted(heights)


def test_ward_groups_equal_greedy_merging(spark):
    rng = np.random.default_rng(5)
    x = rng.random((11, 30)) * (rng.random((11, 30)) < 0.6) + rng.integers(0, 4, 11)[:, None] * 0.3
    names, _, gram = gram_of(spark, x)
    want, heights = brute_ward(x, 5)
    assert np.allclose(sorted(r["height"] for r in cl.ward_merges(gram).collect()), heights)
    groups = {}
    for r in cl.ward_groups(gram, 5).collect():
        groups.setdefault(r["cluster"], []).append(names.index(r["class"]))
    assert sorted(map(sorted, groups.values())) == want
    assert all(names[min(g)] == c for c, g in groups.items())


def test_few_classes(spark):
    names, _, gram = gram_of(spark, np.eye(3))
    assert {r["cluster"] for r in cl.ward_groups(gram, 9).collect()} == set(names)
    assert {r["cluster"] for r in cl.ward_groups(gram, 1).collect()} == {"c00"}
    none = spark.createDataFrame([], "class_a string, class_b string, dot double")
    assert cl.ward_groups(none, 2).collect() == []


def distance_rows(spark, d, names):
    rows = [(names[i], names[j], float(d[i, j])) for i in range(len(d)) for j in range(len(d))]
    return spark.createDataFrame(rows, "class_a string, class_b string, d double")


@pytest.mark.parametrize("n, k, spare", [(12, 11, 16), (40, 2, 3)])
def test_classical_scaling(spark, monkeypatch, n, k, spare):
    monkeypatch.setattr(cl, "SPARE_AXES", spare)
    rng = np.random.default_rng(2)
    points = rng.normal(size=(n, k)) * np.linspace(4, 1, k)
    points = np.column_stack([points, 0.1 * rng.normal(size=(n, 6))]) if spare == 3 else points
    d = np.sqrt(((points[:, None] - points) ** 2).sum(axis=2))
    names = [f"c{i:02d}" for i in range(n)]
    got = {r["class"]: r["coords"] for r in cl.map_classes(distance_rows(spark, d, names), k).collect()}
    x = np.array([got[c] for c in names])
    b = -0.5 * (d**2 - (d**2).mean(axis=0) - (d**2).mean(axis=1)[:, None] + (d**2).mean())
    value, vector = np.linalg.eigh(b)
    want = (vector * np.sqrt(np.maximum(value, 0)))[:, ::-1][:, :k]
    want = want * np.sign(want[0])
    assert np.allclose(x, want, atol=1e-6)
    if spare != 3:
        assert np.allclose(np.sqrt(((x[:, None] - x) ** 2).sum(axis=2)), d, atol=1e-6)


def test_values_far_below_zero_do_not_hide_leading_axes(spark):
    rng = np.random.default_rng(7)
    q, _ = np.linalg.qr(rng.normal(size=(16, 16)))
    values = np.concatenate([[8.0, 6.0], np.linspace(-30, -20, 5), np.linspace(-1, 1, 9)])
    m = (q * values) @ q.T
    names = [f"c{i:02d}" for i in range(16)]
    rows = distance_rows(spark, m, names).withColumnRenamed("d", "v")
    old, cl.SPARE_AXES = cl.SPARE_AXES, 5
    try:
        _, found = cl.leading_axes(rows, 2)
    finally:
        cl.SPARE_AXES = old
    assert np.allclose(found, [8, 6], atol=1e-6)


def test_dissimilarity_is_one_minus_correlation(spark):
    rng = np.random.default_rng(9)
    x = rng.random((5, 20)) * (rng.random((5, 20)) < 0.5)
    x[:, 0] = 1
    names, shares, gram = gram_of(spark, x)
    used = x[:, (x != 0).any(axis=0)]
    got = {(r["class_a"], r["class_b"]): r["d"] for r in cl.class_dissimilarity(gram, shares, "source").collect()}
    want = 1 - np.corrcoef(used)
    assert len(got) == 25 and all(abs(got[names[i], names[j]] - want[i, j]) < 1e-9 for i in range(5) for j in range(5))
