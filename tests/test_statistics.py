"""Distribution tails, fits, components and text similarity against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import tails
from tallyloom.operators import aggregate as ag
from tallyloom.operators import lasso, ml
from tallyloom.operators import series as ts
from tallyloom.operators import stats as st
from tallyloom.operators import text as tx
from tallyloom.operators import window as wn


@pytest.mark.parametrize(
    "t, df, p", [(2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 1e7, 0.05), (3.169, 10, 0.01), (2.042, 30, 0.05)]
)
def test_t_tail_table_values(t, df, p):
    assert abs(float(tails.t_two_sided(t, df)) - p) < 2e-4


@pytest.mark.parametrize("f, d1, d2, p", [(4.96, 1, 10, 0.05), (3.10, 3, 20, 0.05), (2.53, 5, 30, 0.05), (7.56, 1, 30, 0.01)])
def test_f_tail_table_values(f, d1, d2, p):
    assert abs(float(tails.f_upper(f, d1, d2)) - p) < 5e-4


def test_t_quantile_inverts_the_tail():
    for df in (1, 4, 25, 400):
        q = float(tails.t_quantile(0.975, df))
        assert abs(float(tails.t_two_sided(q, df)) - 0.05) < 1e-9


def noise(n=300, seed=4):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    return x1, x2, 1.5 + 2 * x1 - 0.5 * x2 + rng.normal(scale=0.3, size=n)


def test_coefficient_table(spark):
    x1, x2, y = noise()
    df = spark.createDataFrame(list(map(tuple, np.c_[x1, x2, y].tolist())), "x1 double, x2 double, y double")
    got = {r.term: r for r in st.coefficient_table(df, "y", ["x1", "x2"]).collect()}
    X = np.c_[np.ones(len(y)), x1, x2]
    b, rss, *_ = np.linalg.lstsq(X, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * rss[0] / (len(y) - 3))
    for name, i in (("(intercept)", 0), ("x1", 1), ("x2", 2)):
        assert np.isclose(got[name].estimate, b[i]) and np.isclose(got[name].std_error, se[i])
        assert got[name].conf_low < b[i] < got[name].conf_high
        assert got[name].p_value < 1e-6


def test_anova_and_correlation_p_values(spark):
    df = spark.createDataFrame([(g, float(v)) for g, vs in {"a": [6, 8, 4, 5, 3, 4], "b": [8, 12, 9, 11, 6, 8], "c": [13, 9, 11, 8, 7, 12]}.items() for v in vs], "g string, v double")
    r = st.anova(df, "g", "v").first()
    assert round(r.f_value, 1) == 9.3 and abs(r.p_value - 0.0024) < 2e-4
    pairs = spark.createDataFrame([(float(i), float(i + (i % 3))) for i in range(30)], "x double, y double")
    c = st.correlation_test(pairs, [], "x", "y").first()
    assert c.r > 0.99 and c.p_value < 1e-12


def test_weighted_interval_equals_repeated_values(spark):
    values, weights = [1, 2, 3, 4, 5], [5, 10, 100, 50, 30]
    df = spark.createDataFrame([("p", float(x), w) for x, w in zip(values, weights)], "k string, x double, w long")
    r = st.weighted_mean_interval(df, ["k"], "x", "w").first()
    rep = np.repeat(values, weights)
    se = rep.std(ddof=1) / np.sqrt(len(rep))
    q = float(tails.t_quantile(0.975, len(rep) - 1))
    assert np.allclose([r.mean, r.low, r.high], [rep.mean(), rep.mean() - q * se, rep.mean() + q * se])


def test_principal_components(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(m.tolist())], "id long, v array<double>")
    rows = ml.explained_variance(df, "v", 5).orderBy("component").collect()
    ev = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1]
    assert np.allclose([r.share for r in rows], ev / ev.sum())
    assert abs(rows[-1].cumulative - 1) < 1e-9


def test_polynomial_training_error_never_grows(spark):
    x = np.linspace(0, 10, 200)
    df = spark.createDataFrame([(float(a), float(np.sin(a)), i % 2 == 0) for i, a in enumerate(x)], "x double, y double, tr boolean")
    rows = ml.polynomial_errors(df, "x", "y", [1, 2, 3, 5], "tr").orderBy("degree").collect()
    errors = [r.train_mse for r in rows]
    assert all(a >= b - 1e-9 for a, b in zip(errors, errors[1:]))


def test_normality_and_moments(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(5, 2, 2000)], "x double")
    assert st.normality_test(df, "x").first().p_value > 0.05
    skewed = spark.createDataFrame([(float(v),) for v in rng.exponential(1.0, 2000)], "x double")
    assert st.normality_test(skewed, "x").first().p_value < 1e-6


def test_half_life_of_an_exact_decay(spark):
    rows = [("a", t, 100 * 0.5 ** (t / 4)) for t in range(12)] + [("b", t, float(t + 1)) for t in range(12)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {r.k: r.half_life for r in ts.decay_half_life(df, ["k"], "t", "v").collect()}
    assert abs(got["a"] - 4) < 1e-9 and got["b"] is None
    first = {r.k: r.half_life_from_peak for r in wn.half_life(df, ["k"], "t", "v").collect()}
    assert first == {"a": 4}


def test_change_point_of_a_broken_line(spark):
    rows = [("s", i, float(i) if i < 20 else 100.0 - i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, d int, v double")
    r = ts.change_point(df, ["k"], "d", "v").first()
    assert (r.last_before, r.t) == (19, 20) and abs(r.sse) < 1e-6


def test_repeated_states_keep_the_first(spark):
    rows = [("s", i, x) for i, x in enumerate("aabba")]
    df = spark.createDataFrame(rows, "k string, i int, x string")
    keep = lambda flag: [r.i for r in wn.drop_repeats(df, ["k"], ["i"], "x", keep_first=flag).orderBy("i").collect()]
    assert keep(True) == [0, 2, 4] and keep(False) == [2, 4]


def test_radius_edges(spark):
    df = spark.createDataFrame([(50.0, 50.0), (53.0, 50.0), (50.0, 54.0), (53.0, 54.0)], "x double, y double")
    got = {(r.dims, r.radius): r.points for r in ag.radius_counts(df, ["x", "y"], 50.0, 6).collect()}
    x = df.toPandas()
    for radius in range(1, 7):
        assert got[(1, radius)] == int((abs(x.x - 50) <= radius).sum())
        assert got[(2, radius)] == int((np.hypot(x.x - 50, x.y - 50) < radius).sum())


def test_unit_rows_turn_distance_into_correlation(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 5.0]), (2, [2.0, 1.0, 0.0, 4.0])], "i int, v array<double>")
    a, b = (r.f.toArray() for r in tx.unit_rows(df, "v", "f").orderBy("i").collect())
    r = np.corrcoef([1, 2, 3, 5], [2, 1, 0, 4])[0, 1]
    assert np.isclose(((a - b) ** 2).sum(), 2 * (1 - r))


def test_lasso_keeps_the_strong_terms(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 6))
    y = 3 * x[:, 0] - 2 * x[:, 3] + rng.normal(scale=0.1, size=200)
    rows = [(i, f"w{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    counts = spark.createDataFrame(rows, "id long, word string, n double")
    targets = spark.createDataFrame([(i, float(t)) for i, t in enumerate(y)], "id long, y double")
    path = lasso.lasso_path(counts, targets, "id", "word", "n", "y", n_penalties=5, least_ratio=0.005)
    errors = sorted(path.errors.collect(), key=lambda r: r["lambda"])
    assert [p["lambda"] for p in errors if p.is_min] == [errors[0]["lambda"]]
    assert sum(p.is_1se for p in errors) == 1
    kept = {r.word for r in path.terms.filter(path.terms["lambda"] == errors[2]["lambda"]).collect()}
    assert kept == {"w0", "w3"}
