"""Tasks follow the rows they hold, and small tables travel to large ones."""

import datetime
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyloom import core
from tallyloom.operators import relational as rel
from tallyloom.operators import series as ts
from tallyloom.operators import stats as st
from tallyloom.operators import text as tx


def plan(df):
    return df._jdf.queryExecution().toString()


def dealt(df):
    return [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan(df))]


@pytest.fixture
def small_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("split", [None, 2])
def test_pairs_get_tasks_by_their_number(spark, monkeypatch, split):
    monkeypatch.setattr(core, "TASK_ROWS", 10)
    rows = [(g, (g * 7 + m * m) % 23) for g in range(100) for m in range(4)] + [(None, 1), (3, None)]
    got = rel.pair_counts(spark.createDataFrame(rows, "g int, m int"), "g", "m", split_rows=split)
    assert min(dealt(got)) == 60  # 600 raw pairs
    held = {}
    for g, m in rows:
        if g is not None and m is not None:
            held.setdefault(g, set()).add(m)
    want = Counter(p for x in held.values() for p in combinations(sorted(x), 2))
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == dict(want)


def test_fits_of_few_groups_do_not_move_the_rows(spark, small_broadcasts):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"))
    out = st.with_fit(df, ["g"], "y", "x")
    assert "hashpartitioning" not in plan(out)
    assert out.count() == 20_000 and out.agg(F.max(F.abs("residual"))).first()[0] < 1e-6
    nulls = st.with_fit(spark.createDataFrame([(None, 1.0, 2.0), (None, 2.0, 4.0)], "g int, x double, y double"), ["g"], "y", "x")
    assert [r["residual"] for r in nulls.collect()] == [0.0, 0.0]


def test_gaps_get_tasks_by_their_candidates(spark, monkeypatch):
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    rows = [(s, day(i), float(i * i % 11 + s)) for s in range(6) for i in range(0, 40, 1 + s)]
    df = spark.createDataFrame(rows, "s int, day date, v double")
    want = sorted(map(tuple, ts.impute_gaps(df, ["s"], "day", "v").collect()))
    monkeypatch.setattr(core, "TASK_ROWS", 10)
    out = ts.impute_gaps(df, ["s"], "day", "v")
    n_days = sum((39 // (1 + s)) * (1 + s) + 1 for s in range(6))
    n_gaps = n_days - len(rows)
    assert set(dealt(out)) == {-(-n_days // 10), n_gaps}
    got = sorted(map(tuple, out.collect()))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and len(got) == n_days
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_sparse_rows_move_counts_by_document_only(spark, small_broadcasts):
    rows = [(d, f"w{(d * k) % 50}") for d in range(200) for k in range(1, 30)]
    out = tx.sparse_rows(tx.document_terms(spark.createDataFrame(rows, "doc int, word string"), "doc", 100), "doc")
    assert "hashpartitioning(word" not in plan(out)
    total = Counter(w for _, w in rows)
    ids = {w: i for i, w in enumerate(sorted(w for w in total if total[w] >= 100))}
    want = {}
    for (d, w), n in Counter(rows).items():
        if w in ids:
            want.setdefault(d, []).append((ids[w], float(n)))
    assert {r["doc"]: list(zip(r["ids"], r["counts"])) for r in out.collect()} == {d: sorted(c) for d, c in want.items()}
