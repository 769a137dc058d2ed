"""Single long series, sparse values and noisy decays against plain Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.core import HOT_ROWS_CONF
from tallyloom.operators import relational as rel
from tallyloom.operators import series as ts
from tallyloom.operators import stats as st
from tallyloom.operators import window as wn


@pytest.fixture
def small_limit(spark):
    spark.conf.set(HOT_ROWS_CONF, "40")
    yield
    spark.conf.unset(HOT_ROWS_CONF)


def walk(n=300, seed=5):
    rng = np.random.default_rng(seed)
    y = 1e6 + np.cumsum(rng.normal(0, 1, n)) + np.where(np.arange(n) > 180, 0.3 * (np.arange(n) - 180), 0)
    return y, 2 * y + rng.normal(0, 3, n)


def rows_of(df):
    return sorted(([round(x, 6) if isinstance(x, float) else x for x in r] for r in df.collect()), key=str)


@pytest.fixture
def long_series(spark):
    a, b = walk()
    rows = [(s, i, float(v)) for s, y in (("a", a), ("b", b)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "s string, at int, v double").repartition(5).withColumn("day", F.date_add(F.lit("2020-01-01"), F.col("at")))


def test_change_point_of_a_long_series(long_series, small_limit):
    got = {r["s"]: (r["t"], r["sse"]) for r in ts.change_point(long_series, ["s"], "at", "v", bounded=False).collect()}
    for s, y in zip("ab", walk()):
        t = np.arange(1, len(y) + 1.0)
        sse = lambda m: np.sum((y[m] - np.polyval(np.polyfit(t[m] - t[m].mean(), y[m] - y[m].mean(), 1), t[m] - t[m].mean()) - y[m].mean()) ** 2)
        errors = {k: sse(t <= k) + sse(t > k) for k in range(3, len(y) - 2)}
        best = min(errors, key=errors.get)
        assert got[s][0] == best and got[s][1] == pytest.approx(errors[best], rel=1e-6)


@pytest.mark.parametrize(
    "job",
    [
        lambda d, **kw: ts.interrupted_fit(d, ["s"], "day", "v", F.lit("2020-06-01").cast("date"), **kw),
        lambda d, **kw: ts.unit_root(d, ["s"], ["day"], "v", **kw),
        lambda d, **kw: ts.cointegration(d, "s", "day", "v", "a", "b", **kw),
        lambda d, **kw: ts.pair_trades(ts.pair_residuals(d, "s", "day", "v", "a", "b"), "day", 1.0, **kw),
        lambda d, **kw: ts.impute_gaps(d.filter("at % 7 < 5"), ["s"], "day", "v", **kw),
    ],
)
def test_split_series_give_the_same(long_series, small_limit, job):
    assert rows_of(job(long_series, bounded=False)) == rows_of(job(long_series, bounded=True))


def least_squares(t, y):
    """Smallest error over log rates by nested grids."""

    def error(g):
        e = np.exp(-np.exp(g) * t)
        c = np.cov(e, y, bias=True)
        return c[1, 1] - c[0, 1] ** 2 / c[0, 0]

    mid, step = -2.0, 0.03
    for _ in range(5):
        grid = mid + step * np.arange(-120, 121)
        mid, step = grid[np.argmin([error(g) for g in grid])], step / 50
    return math.log(2) / math.exp(mid)


def test_decay_fit_of_noisy_series_with_an_asymptote(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for s in range(12):
        t = np.arange(60.0)
        y = 40 + 5 * s + 100 * np.exp(-(0.05 + 0.03 * s) * t) + rng.normal(0, 1.5, 60)
        y[0] = max(y) + 1
        want[s] = least_squares(t, y)
        rows += [(s, int(i) + 7, float(v)) for i, v in zip(t, y)]
    rows += [(90, i, 1.0 + i) for i in range(20)]  # peak at the end
    rows += [(91, i, 5.0) for i in range(20)] + [(92, 1, 9.0), (92, 2, 5.0), (92, 3, 4.0)]  # level; too few
    rows += [(93, i, 100.0 - i * i * 0.1) for i in range(20)]  # falls faster and faster
    rows += [(None, i, 50 + 10 * 0.5**i) for i in range(30)] + [(None, 40, None), (94, None, 3.0)]
    df = spark.createDataFrame(rows, "s long, at int, v double").repartition(4)
    got = {r["s"]: r for r in ts.decay_fit(df, ["s"], "at", "v").collect()}
    log_linear = {r["s"]: r["half_life"] for r in ts.decay_half_life(df, ["s"], "at", "v").collect()}
    for s, w in want.items():
        assert got[s]["half_life"] == pytest.approx(w, rel=1e-5) and abs(got[s]["step"]) <= 1e-8
        assert abs(log_linear[s] / w - 1) > 0.2  # the logarithm takes the asymptote for a slow decay
    assert all(got[s]["half_life"] is None for s in (90, 91, 92, 93))
    assert got[None]["half_life"] == pytest.approx(1) and got[None]["asymptote"] == pytest.approx(50)
    assert 94 not in got and got[92]["n_after"] == 3
    assert ts.decay_fit(df.limit(0), ["s"], "at", "v").collect() == []


def test_triples_of_sparse_values(spark):
    rng = np.random.default_rng(8)
    values = [0, 10**9, 0, 5 * 10**8, -3, 3, 10**9 - 7, 7, 7] + rng.integers(-50, 50, 40).tolist() + [None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for target in (10**9, 0, 14, -20):
        want = {}
        for x in itertools.combinations(sorted(v for v in values if v is not None), 3):
            if sum(x) == target:
                want[x] = want.get(x, 0) + 1
        got = {(r["a"], r["b"], r["c"]): r["n_triples"] for r in rel.sum_triples(df, "v", target).collect()}
        assert got == want
    assert rel.sum_triples(df.filter("v IS NULL"), "v", 3).collect() == []


def test_long_runs_are_met_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(wn, "BLOCK", 3)
    monkeypatch.setattr(wn, "LEVELS", 3)
    rng = np.random.default_rng(4)
    v = rng.integers(-4, 6, 150).tolist()
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(v)], "k string, at int, v long").repartition(4)
    want = {
        (i + 1, j + 1, min(v[i : j + 1]), max(v[i : j + 1]))
        for i in range(len(v)) for j in range(i + 1, len(v)) if sum(v[i : j + 1]) == 12
    }
    got = [tuple(r)[1:5] for r in wn.runs_with_sum(df, ["k"], ["at"], "v", 12).collect()]
    assert len(got) == len(want) and set(got) == want and max(b - a for a, b, *_ in want) > 60


def test_chains_of_many_chunks(spark):
    rng = np.random.default_rng(6)
    values = np.cumsum(rng.integers(1, 3, 80)).tolist()
    df = spark.createDataFrame([("k", x) for x in values] + [("k", 0), ("k", -4), ("one", 2), ("gap", 9)], "k string, v long")
    ways = {0: 1}
    for x in values:
        ways[x] = sum(ways.get(x - d, 0) for d in (1, 2, 3))
    got = {r["k"]: r["arrangements"] for r in wn.chain_arrangements(df, ["k"], "v", chunk_rows=3).collect()}
    assert got == {"k": float(ways[values[-1]]), "one": 1.0, "gap": 0.0}


def test_sums_keep_their_digits_at_a_high_level(spark):
    rng = np.random.default_rng(7)
    x = 1e9 + rng.normal(0, 1, 200)
    y = 1e9 + 3 * (x - 1e9) + rng.normal(0, 0.5, 200)
    w = rng.integers(1, 5, 200)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, w)], "x double, y double, w long")
    r = st.weighted_mean_interval(df, [], "x", "w").first()
    full = np.repeat(x, w)
    assert r["std_error"] == pytest.approx(full.std(ddof=1) / np.sqrt(len(full)), rel=1e-6)
    centre = st.rss_surface(df, "y", "x", 1.0, 1).filter("i = 0 AND j = 0").first()
    slope = np.polyfit(x - x.mean(), y - y.mean(), 1)[0]
    assert centre["mse"] == pytest.approx(np.mean((y - y.mean() - slope * (x - x.mean())) ** 2), rel=1e-3)
