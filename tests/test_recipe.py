"""Fitted preprocessing against numpy, and after saving and loading."""

import numpy as np
from pyspark.ml import Pipeline, PipelineModel

from tallyloom.operators import ml
from tallyloom.operators import recipe as rc

COLUMNS = ["a", "b", "flat", "c"]


def frame(spark, n=400):
    rng = np.random.default_rng(6)
    a, b, c = np.exp(rng.normal(1, 0.5, n)), rng.normal(0, 1, n), rng.gamma(9.0, 2.0, n)
    rows = [(i, float(a[i]), float(b[i]), 1.0 if i % 200 else 2.0, float(c[i]), "xyz"[i % 3], float(3 * np.log(a[i]) + c[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, flat double, c double, kind string, y double"), a, b, c


def likelihood(x, p):
    t = np.log(x) if p == 0 else (x**p - 1) / p
    return -len(x) / 2 * np.log(t.var()) + (p - 1) * np.log(x).sum()


def test_stages_follow_their_definitions_and_survive_a_reload(spark, tmp_path):
    df, a, b, c = frame(spark)
    fitted = Pipeline(stages=[*rc.numeric_recipe(COLUMNS), rc.KeptColumns(inputCols=COLUMNS)]).fit(df)
    variance, power, _ = fitted.stages[:3]
    assert variance.getOrDefault("dropped") == ["flat"]
    assert power.getOrDefault("changed") == ["a", "c"]
    for x, p in zip((a, c), power.getOrDefault("powers")):
        grid = np.arange(-8000, 8001) / 1600
        assert abs(p - max(grid[np.abs(grid - p) < 0.3], key=lambda g: likelihood(x, g))) < 1e-9
    path = str(tmp_path / "recipe")
    fitted.save(path)
    rows = {}
    for model in (fitted, PipelineModel.load(path)):
        out = model.transform(df).orderBy("id")
        assert "flat" not in out.columns
        got = out.toPandas()
        rows[model] = got[["a", "b", "c"]].to_numpy()
        assert np.allclose(np.stack([v.toArray() for v in got["features"]]), rows[model])
    x, y = rows.values()
    assert (x == y).all() and np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0, ddof=1), 1)
    assert np.allclose(x[:, 1], (b - b.mean()) / b.std(ddof=1))


def test_forest_behind_the_recipe_takes_new_levels_after_a_reload(spark, tmp_path):
    df, *_ = frame(spark)
    model = ml.forest_fit(df, COLUMNS, ["kind"], "y", trees=5, stages=rc.numeric_recipe(COLUMNS))
    path = str(tmp_path / "forest")
    model.save(path)
    new = df.limit(20).withColumn("kind", df["y"].cast("string"))
    want = [r.prediction for r in model.transform(new).orderBy("id").collect()]
    assert [r.prediction for r in PipelineModel.load(path).transform(new).orderBy("id").collect()] == want


def test_columns_without_variance_or_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, -2.0), (1.0, None)], "a double, b double")
    out = rc.CentreScale(inputCols=["a", "b", "gone"]).fit(df).transform(rc.BoxCox(inputCols=["a", "b"]).fit(df).transform(df))
    assert [r.a for r in out.collect()] == [0.0] * 3 and out.filter("b IS NULL").count() == 1


def test_moments_of_powers_are_those_of_numpy_over_many_tasks(spark):
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(9, 1.5, 3000))
    rows = [(float(v), None if i % 3 else float(v / 1e4)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(7)
    tried = {"a": range(-20, 21), "b": range(-3, 4)}
    for step in rc.BoxCox.STEPS:
        found = rc.power_moments(df, ["a", "b"], tried, step).collect()
        assert len(found) == 48
        for r in found:
            own = x if r["i"] == 0 else x[::3] / 1e4
            t = np.log(own) if r["k"] == 0 else (own ** (r["k"] * step) - 1) / (r["k"] * step)
            assert r["n"] == len(own) and np.isclose(r["m2"] / r["n"], t.var(), rtol=1e-7)
            assert np.isclose(r["m"], t.mean(), rtol=1e-9) and np.isclose(r["logs"], np.log(own).sum())
