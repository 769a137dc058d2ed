"""The paths for large groups give the same results as the plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.core import HOT_ROWS_CONF
from tallyloom.operators import apply as ap
from tallyloom.operators import ml
from tallyloom.operators import relational as rel
from tallyloom.operators import reshape as rs
from tallyloom.operators.quantiles import exact_quantiles
from tallyloom.operators.sequence import sequence_columns


@pytest.fixture
def small_limit(spark):
    spark.conf.set(HOT_ROWS_CONF, "40")
    yield
    spark.conf.unset(HOT_ROWS_CONF)


def skewed(spark, n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
        rows.append((i, key, rnd.randrange(10**6), rnd.choice([None, rnd.randrange(100)])))
    return spark.createDataFrame(rows, "id long, k string, o long, v long").repartition(6)


@pytest.mark.parametrize("descending", [False, True])
def test_sequence_columns_on_a_hot_series(spark, small_limit, descending):
    df = skewed(spark)
    order = [F.desc("o") if descending else F.asc("o"), F.asc("id")]
    got = sequence_columns(
        df, ["k"], order, lag={"before": "v"}, lead={"after": "v"}, running={"total": "v"}, position="pos"
    )
    w = Window.partitionBy("k").orderBy(*order)
    want = df.withColumns(
        {
            "before": F.lag("v").over(w),
            "after": F.lead("v").over(w),
            "total": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "pos": F.row_number().over(w).cast("long"),
        }
    )
    cols = want.columns
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.collect()))


def test_positions_over_a_whole_table(spark, small_limit):
    df = skewed(spark).select("id", "o")
    got = sequence_columns(df, [], ["o", "id"], position="pos")
    rows = sorted(got.collect(), key=lambda r: (r.o, r.id))
    assert [r.pos for r in rows] == list(range(1, len(rows) + 1))


def test_quantiles_of_a_hot_group(spark, small_limit):
    df = skewed(spark)
    got = {r.k: (r.q, r.m) for r in exact_quantiles(df, ["k"], "o", {"q": 0.1, "m": 0.5}).collect()}
    pdf = df.toPandas()
    for k, (q, m) in got.items():
        part = pdf[pdf.k.isna()] if k is None else pdf[pdf.k == k]
        assert np.allclose([q, m], np.quantile(part.o, [0.1, 0.5]))
    whole = exact_quantiles(df, [], "o", {"m": 0.5}).first().m
    assert np.isclose(whole, np.quantile(pdf.o, 0.5))


def test_pair_counts_with_a_large_group(spark):
    rnd = random.Random(3)
    rows = {("big", m) for m in range(40)} | {(f"g{rnd.randrange(30)}", rnd.randrange(40)) for _ in range(200)}
    df = spark.createDataFrame(list(rows) + [("big", 1), (None, 2)], "g string, m long")
    groups = {}
    for g, m in rows:
        groups.setdefault(g, set()).add(m)
    want = {}
    for ms in groups.values():
        for a in ms:
            for b in ms:
                if a < b:
                    want[(a, b)] = want.get((a, b), 0) + 1
    for least in (1, 2):
        got = rel.pair_counts(df, "g", "m", min_count=least, split_rows=7).collect()
        assert {(r.a, r.b): r.n for r in got} == {p: n for p, n in want.items() if n >= least}


def test_nest_in_chunks_keeps_all_rows(spark):
    df = skewed(spark)
    nested = rs.nest(df, ["k"], ["o", "id"], "rows", chunk_rows=25)
    assert nested.agg(F.max(F.size("rows"))).first()[0] <= 25
    back = rs.unnest(nested, "rows").select(df.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("limit", [None, 20])
def test_nearest_neighbours_equal_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    train = rng.normal(size=(220, 8)).round(2)
    test = np.vstack([rng.normal(size=(25, 8)).round(2), train[:5]])
    frame = lambda m, base: spark.createDataFrame(
        [(base + i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>"
    )
    got = ml.nearest_neighbours(frame(train, 0), frame(test, 1000), "id", "v", 4, pivots=9, limit=limit)
    found = {}
    for r in got.collect():
        found.setdefault(r.id, {})[r["rank"]] = r.neighbour
    for i, v in enumerate(test):
        d = np.sqrt(((train - v) ** 2).sum(1))
        want = sorted(range(len(train)), key=lambda j: (d[j], j))[:4]
        assert [round(d[found[1000 + i][k]], 9) for k in (1, 2, 3, 4)] == [round(d[j], 9) for j in want]


def test_nearest_centroid_with_many_labels(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 7, [float(x) for x in rng.normal(i % 7, 1.0, 4)]) for i in range(140)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    few = ml.nearest_centroid(df, "label", "v", df, "id")
    many = ml.nearest_centroid(df, "label", "v", df, "id", few=2)
    pick = lambda out: sorted((r.id, r.predicted) for r in out.collect())
    assert pick(few) == pick(many)


def test_group_function_in_chunks(spark):
    df = skewed(spark).select("k", "id", "o")
    out = ap.per_group(
        df, ["k"], ["id"], lambda p: {"n": len(p), "s": float(p["o"].sum())}, "n long, s double",
        {"n": F.sum("n"), "s": F.sum("s")}, chunk_rows=30,
    )
    got = {r.k: (r.n, r.s) for r in out.collect()}
    want = {r.k: (r.n, r.s) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("o").cast("double").alias("s")).collect()}
    assert got == want


def test_value_seen_in_previous_rows(spark):
    values = [3, 1, 3, 2, 1, 1, 5, 3]
    df = spark.createDataFrame([("s", i + 1, v) for i, v in enumerate(values)], "s string, pos long, v long")
    got = {r.pos: r.seen_at for r in rel.within_previous(df, ["s"], "pos", "v", 3).collect()}
    assert got == {3: 1, 5: 2, 6: 5}


def test_nearest_neighbours_by_blocks_of_queries_with_ties_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(ml, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(ml, "CELL_ROWS", 30)
    rng = random.Random(8)
    points = [[float(rng.randint(-3, 3)), float(rng.randint(-3, 3)), 1e3] for _ in range(120)]  # many equal ones
    train = [(2**60 + i if i else None, v) for i, v in enumerate(points[:70])] + [(5, None)]
    test = [(i, v) for i, v in enumerate(points[70:])] + [(99, None)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in ml.nearest_neighbours(frame(train), frame(test), "id", "v", 6, pivots=5).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    assert len(got) == 50
    for i, v in test[:-1]:
        near = sorted((sum((x - y) ** 2 for x, y in zip(v, w)) ** 0.5, k is not None, k or 0) for k, w in train[:-1])[:6]
        assert sorted(got[i]) == [(n, k if some else None, d) for n, (d, some, k) in enumerate(near, start=1)]
