"""Inputs past the sizes, depths and orders that operators once stopped at."""

import itertools

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import aggregate as ag
from tallyloom.operators import graph as gr
from tallyloom.operators import relational as rel
from tallyloom.streaming import buckets as sb


def test_long_chains_are_followed_to_the_end_or_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "id long")
    assert gr.reachable(chain, start).count() == 12
    assert gr.shortest_paths(chain, start, directed=True).agg(F.max("dist")).first()[0] == 12
    for search in (gr.reachable, lambda *a, **k: gr.shortest_paths(*a, directed=True, **k)):
        with pytest.raises(RuntimeError):
            search(chain, start, max_depth=5)
    assert gr.reachable(chain, start, max_depth=12).count() == 12


def test_label_propagation_ends_where_labels_swing(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 7)], "src long, dst long")
    labels = {r.id: r.community for r in gr.label_communities(star).collect()}
    assert len(labels) == 7 and set(labels.values()) <= set(range(7))


def test_triples_of_any_sign(spark):
    values = [0, 5, 10, -3, 8, 5, 5, 0, 20, -10]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    for target in (15, 0, 7):
        want = {}
        for t in itertools.combinations(sorted(values), 3):
            if sum(t) == target:
                want[t] = want.get(t, 0) + 1
        got = {(r.a, r.b, r.c): r.n_triples for r in rel.sum_triples(frame, "v", target).collect()}
        assert got == want


def test_counts_of_pairs_and_triples_stay_exact(spark):
    many = spark.range(3_000_000).select(F.lit(5).alias("v"))
    n = 3_000_000
    assert rel.sum_triples(many, "v", 15).first()["n_triples"] == n * (n - 1) * (n - 2) // 6
    assert rel.sum_pairs(many, "v", 10).first()["n_pairs"] == n * (n - 1) // 2
    big = 300_000_002
    pairs = f"cast({rel._choose(str(big) + 'L', 2)} as bigint)"
    assert spark.range(1).select(F.expr(pairs)).first()[0] == big * (big - 1) // 2


def test_confusion_of_very_many_rows(spark):
    counts = spark.createDataFrame([(0, 0, 6_000_000_000), (1, 1, 6_000_000_000), (0, 1, 1)], "t int, g int, n long")
    r = ag.confusion_summary(counts, "t", "g").first()
    assert r["n"] == 12_000_000_001 and abs(r["kappa"] - 1) < 1e-9


def test_longer_table_keeps_its_rest(spark):
    out = rel.bind_columns(spark.createDataFrame([(1,), (2,)], "a int"), ["a"], spark.createDataFrame([(7,), (8,), (9,)], "b int"), ["b"])
    assert {(r.a, r.b) for r in out.collect()} == {(1, 7), (2, 8), (None, 9)}


@pytest.mark.parametrize("per_trigger", [1, 64])
def test_stream_over_a_folder_of_unordered_files_equals_the_batch(spark, tmp_path, per_trigger):
    rows = [(d * 100 + i, f"2024-01-{d + 1:02d} {i % 24:02d}:{i % 60:02d}:00", "ab"[i % 2], float(i)) for d in range(5) for i in range(25)]
    events = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    for n, d in enumerate([4, 3, 2, 1, 0]):  # newest first
        part = events.filter(F.dayofmonth("ts") == d + 1).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = sb.stream_table(spark, str(tmp_path), "events", "ts", files_per_trigger=per_trigger)
    table = spark.read.parquet(str(tmp_path / "events.parquet"))
    frames = sb.windowed_totals(stream, "ts", "3 minutes", sb.replay_delay(table, "ts"), ["event_type"], n=F.count("*"))
    got = sb.run_to_table(frames, "frames-test", keys=["bucket", "event_type"])
    want = table.groupBy(F.window(F.col("ts").cast("timestamp"), "3 minutes")["start"].alias("bucket"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.select("bucket", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))
    assert got.agg(F.sum("n")).first()[0] == 125


def test_forest_takes_factors_of_many_levels(spark):
    from tallyloom.operators import ml

    rows = spark.createDataFrame([(f"level{i % 90}", float(i % 7), float(i % 90)) for i in range(900)], "c string, x double, y double")
    model = ml.forest_fit(rows, ["x"], ["c"], "y", trees=3)
    assert model.transform(rows).filter("prediction is null").isEmpty()
