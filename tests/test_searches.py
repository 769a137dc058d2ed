"""Searches of whole components in a task, beside those in rounds, and the disk that stored rounds leave."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import blocks
from tallyloom.operators import graph as gr
from tallyloom.operators import relational as rel
from tests.test_graph import brute_betweenness, edges, paths_from, random_graph

SMALL = [(100 + a, 100 + b) for a, b in random_graph(2, 20, 30)] + [(200 + i, 201 + i) for i in range(5)]


def spy(monkeypatch) -> list[list[str]]:
    """The columns of the tables that searches store from here on."""
    stored, keep = [], blocks._stored

    def noted(df):
        stored.append(df.columns)
        return keep(df)

    monkeypatch.setattr(blocks, "_stored", noted)
    return stored


@pytest.mark.parametrize("limit", [blocks.WHOLE_NODES, 22])
def test_small_components_are_searched_without_rounds_and_larger_ones_in_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(blocks, "WHOLE_NODES", limit)
    stored = spy(monkeypatch)
    pairs = random_graph(5, 25, 50) + SMALL
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    info = {s: paths_from(adj, s) for s in adj}
    frame = edges(spark, pairs)
    got = gr.shortest_paths(frame).collect()
    want = {(s, t, d[t], c[t]) for s, (d, c) in info.items() for t in d}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    nodes, links = gr.betweenness(frame)
    want = brute_betweenness(pairs)
    assert {r.id: round(r.betweenness, 8) for r in nodes.collect()} == {k: round(v, 8) for k, v in want.items()}
    through = links.agg(F.count("*"), F.sum("betweenness")).first()
    far = sum(x for d, _ in info.values() for x in d.values()) / 2
    assert through[0] == len({frozenset(p) for p in pairs}) and abs(through[1] - far) < 1e-6
    profile = {(r.id, r.dist): r.n for r in gr.distance_profile(frame).collect()}
    assert profile == {(s, x): list(d.values()).count(x) for s, (d, _) in info.items() for x in set(d.values())}
    assert any("seen" in c for c in stored) == (limit == 22)


def test_bits_of_links_give_what_lists_of_them_give(monkeypatch):
    rng = np.random.default_rng(1)
    n, lanes = blocks.BLOCK, 3
    cells = np.sort(rng.choice(n * n, 40_000, replace=False))
    cells = cells[cells // n < cells % n]
    cells = np.sort(np.r_[cells, cells % n * n + cells // n])  # both directions
    bits = blocks._packed(rng.permutation(cells))
    assert len(bits) == n * n // 8 and (blocks._cells(bits) == cells).all()
    full = np.zeros((n, n), bool)
    full[cells // n, cells % n] = True
    x = rng.integers(0, 9, (n, lanes)).astype(float)
    assert (blocks._sum_of(x, bits) == full @ x).all()
    dist = rng.integers(-1, 4, (n, lanes))
    paths, share = (np.where(dist >= 0, rng.integers(1, 5, (n, lanes)), 0.0) for _ in range(2))
    ends = [(a, a) for a in (dist, paths, share)]
    products = blocks._flows(cells, *ends, 4)
    monkeypatch.setattr(blocks, "FLOW_LEVELS", 0)
    assert np.allclose(products, blocks._flows(cells, *ends, 4))
    few = cells[:100]
    data = blocks._packed(few[::-1])
    assert len(data) == 400 and (blocks._cells(data) == few).all()
    part = np.zeros((n, n))
    part[few // n, few % n] = 1
    assert (blocks._sum_of(x, data) == part @ x).all()


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))


def test_stored_rounds_and_pair_counts_leave_no_shuffle_files(spark):
    rows = spark.range(2000).select((F.col("id") % 500).alias("g"), (F.col("id") % 7).alias("m"))
    before = shuffle_files(spark)
    pairs = rel.pair_counts(rows, "g", "m")
    kept = gr.keep(pairs)
    after = shuffle_files(spark)
    assert after <= before and kept.count() == 21
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
