"""Exact and approximate nearest rows against brute force."""

import math
import random

import numpy as np
import pytest

from tallyloom.llm import ann, topk

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, shard int, block int, x string"


def vectors(n=240, d=8, seed=2):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = [c + rng.gauss(0, 0.4) for c in centre[i % 6]]
        v = [float(np.float32(x)) for x in v]
        rows.append((i, rows[i - 1][1] if i % 9 == 5 else v, 1, 0, 0, "x"))
    rows += [(1000, None, None, None, None, None), (1001, [NAN] * d, 1, 1, 1, "x"), (1002, [INF] * d, 1, 1, 1, "x"), (1003, [1.0, None] * (d // 2), 1, 1, 1, "x"), (1004, [0.0] * d, 1, 1, 1, "x"), (None, [1.0] * d, 1, 1, 1, "x"), (1005, [1.0] * 3, 1, 1, 1, "x")]
    rows.append(rows[3])
    return rows


def usable(rows, zero):
    return {i: v for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), SCHEMA).repartition(3)


@pytest.mark.parametrize("rows, k", [(8192, 4), (40, 4), (40, 1000)])
def test_top_k_equals_brute_force(table, monkeypatch, rows, k):
    monkeypatch.setattr(topk, "SHARD_ROWS", rows)
    monkeypatch.setattr(topk, "FEW", 5)
    v = {i: [math.floor(1024 * x) for x in x_] for i, x_ in usable(vectors(), True).items()}
    want = set()
    for q in (i for i in v if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    got = topk.exact_top_k(table, table.filter("vec_id % 20 = 0"), k=k).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_reading_stops_early_when_scores_are_far_apart():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 20, (4000, 4)))
    x[:10] += 1000
    q = np.ones((1, 4))
    alive = topk.no_random_access(q.astype(np.float32), x.astype(np.float32), np.zeros((4000, 1), bool), 5)
    assert set(np.argsort(-x.sum(axis=1))[:5]) <= set(np.flatnonzero(alive[:, 0])) and alive.sum() < 400


def test_small_tables_give_all_candidates_in_order(table):
    v = {i: np.array(x) for i, x in usable(vectors(), False).items() if len(x) == 8}
    got = ann.nearest(table, table.filter("vec_id % 50 = 0 or vec_id = 1005"), k=500, beam=1000).collect()
    queries = [q for q in v if q % 50 == 0]
    assert len(got) == sum(len(v) - 1 for _ in queries)
    for q in queries:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == [c for _, c in sorted((-r["score"], r["vec_id"]) for r in mine)]
        for r in mine[:20]:
            c = v[r["vec_id"]]
            assert abs(r["score"] - c @ v[q] / np.linalg.norm(c) / np.linalg.norm(v[q])) < 1e-12


def test_recall_of_the_graph_is_above_nine_tenths(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1::7] = x[::7][: len(x[1::7])]  # equal vectors
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = ann.build_graph(unit)
    hit = 0
    for q in range(0, 3000, 30):
        best = set(np.argsort(-(unit @ unit[q]))[:6].tolist())
        hit += len(best & set(ann.search_graph(unit, graph, unit[q], ann.BEAM).tolist())) / 6
    assert hit / 100 > 0.9
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:600])], "vec_id long, embedding array<float>")
    got = ann.nearest(frame, frame.filter("vec_id % 50 = 0"), beam=60).collect()
    s = unit[:600] @ unit[:600].T
    found = sum(s[r["query_id"], r["vec_id"]] >= np.sort(np.delete(s[r["query_id"]], r["query_id"]))[-5] - 1e-6 for r in got)
    assert len(got) == 60 and found >= 54


def test_a_third_of_equal_vectors_gives_their_smallest_ids_and_hides_no_others(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32).astype(float)
    x[rng.permutation(1500)[:500]] = x[7]
    x[rng.permutation(1500)[:20]] *= 2  # equal directions, some of the group
    group = np.flatnonzero((x == x[7]).all(axis=1))
    asked = sorted({*range(0, 1500, 25), *group[:10].tolist()})
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, frame.filter(frame.vec_id.isin(asked))).collect()
    hit = 0
    for q in asked:
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        s = ann.cosine(x[q], x)
        want = [c for c in np.lexsort((np.arange(1500), -s)).tolist() if c != q][:5]
        hit += len(set(mine) & set(want))
        if q in group:
            assert mine == want
    assert hit / (5 * len(asked)) > 0.9


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.exact_top_k(none, none).collect() == [] and ann.nearest(none, none).collect() == []
