"""Graph operators against plain Python on small graphs."""

import itertools
import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import graph as gr

# two triangles joined by a bridge, and one separate edge
BRIDGE = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6), (8, 9)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def paths_from(adj, s):
    dist, count, queue = {s: 0}, {s: 1}, deque([s])
    while queue:
        u = queue.popleft()
        for v in adj[u]:
            if v not in dist:
                dist[v], count[v] = dist[u] + 1, 0
                queue.append(v)
            if dist[v] == dist[u] + 1:
                count[v] += count[u]
    return dist, count


def brute_betweenness(pairs):
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    info = {s: paths_from(adj, s) for s in adj}
    score = dict.fromkeys(adj, 0.0)
    for s, t in itertools.combinations(sorted(adj), 2):
        d, c = info[s]
        if t not in d:
            continue
        for v in adj:
            if v not in (s, t) and v in d and t in info[v][0] and d[v] + info[v][0][t] == d[t]:
                score[v] += c[v] * info[v][1][t] / c[t]
    return score


def test_components(spark):
    got = {r.id: r.component for r in gr.components(edges(spark, BRIDGE)).collect()}
    assert got == {**dict.fromkeys(range(1, 7), 1), 8: 8, 9: 8}


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(500, i) for i in range(501, 560)]
    random.Random(2).shuffle(path)
    got = {r.id: r.component for r in gr.components(edges(spark, path + hub)).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in range(500, 560)} == {500}


def test_largest_component(spark):
    got = {(r.src, r.dst) for r in gr.largest_component(edges(spark, BRIDGE)).collect()}
    assert got == set(BRIDGE) - {(8, 9)}


@pytest.mark.parametrize("pass_sources", [4096, 3])
def test_betweenness(spark, pass_sources):
    nodes, links = gr.betweenness(edges(spark, BRIDGE), pass_sources=pass_sources)
    got = {r.id: round(r.betweenness, 9) for r in nodes.collect()}
    assert got == {k: round(v, 9) for k, v in brute_betweenness(BRIDGE).items()}
    best = links.orderBy(F.desc("betweenness")).first()
    assert (best.src, best.dst, best.betweenness) == (3, 4, 9.0)


def test_distance_measures(spark):
    graph = edges(spark, BRIDGE).filter("src < 8")
    for profile in (gr.distance_profile(graph), gr.path_profile(gr.shortest_paths(graph))):
        assert gr.diameter(profile).first() == (3, 1.5)
        close = {r.id: r.closeness for r in gr.closeness(profile).collect()}
        assert close[3] == 5 / 7 and close[1] == 5 / 10
    assert gr.density(edges(spark, BRIDGE).filter("src < 8")).first().density == 14 / 30


def test_eigenvector_of_a_star(spark):
    star = edges(spark, [(0, i) for i in range(1, 5)])
    got = {r.id: r.eigen for r in gr.eigenvector(star).collect()}
    assert got[0] == 1.0 and abs(got[1] - 0.5) < 1e-9
    unit = gr.eigenvector(star, scale=False).agg(F.sum(F.col("eigen") * F.col("eigen"))).first()[0]
    assert abs(unit - 1) < 1e-9


def random_graph(seed, n, m):
    rng = random.Random(seed)
    return [tuple(rng.sample(range(n), 2)) for _ in range(m)]


@pytest.mark.parametrize("directed, pass_sources", [(False, 70), (True, 4096)])
def test_distances_and_path_counts_of_more_sources_than_a_row_holds(spark, directed, pass_sources):
    pairs = random_graph(3, 75, 170)
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).update(() if directed else {a})
    info = {s: paths_from(adj, s) for s in adj}
    frame = edges(spark, pairs)
    want = {(s, t, d[t], c[t]) for s, (d, c) in info.items() for t in d}
    got = gr.shortest_paths(frame, directed=directed, pass_sources=pass_sources).collect()
    assert {(r.source, r.id, r.dist, r.paths) for r in got} == want and len(got) == len(want)
    profile = {(r.id, r.dist): r.n for r in gr.distance_profile(frame, directed=directed, pass_sources=pass_sources).collect()}
    counts = {}
    for s, (d, _) in info.items():
        for x in d.values():
            counts[s, x] = counts.get((s, x), 0) + 1
    assert profile == counts


def test_betweenness_of_a_random_graph(spark):
    pairs = random_graph(5, 25, 50)
    nodes, links = gr.betweenness(edges(spark, pairs), pass_sources=20)
    want = brute_betweenness(pairs)
    assert {r.id: round(r.betweenness, 8) for r in nodes.collect()} == {k: round(v, 8) for k, v in want.items()}
    assert len({frozenset(p) for p in pairs}) == links.count()


def modularity_of(weights, part):
    whole = 2 * sum(weights.values())
    q = 0.0
    for c in set(part.values()):
        tot = sum(w for (a, b), w in weights.items() for x in (a, b) if part[x] == c)
        q += sum(2 * w for (a, b), w in weights.items() if part[a] == part[b] == c) / whole - (tot / whole) ** 2
    return q


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield rest[:i] + [[items[0], *rest[i]]] + rest[i + 1 :]


@pytest.mark.parametrize("seed", [None, 1])
def test_communities_by_local_moving(spark, seed):
    rng = random.Random(seed)
    pairs = BRIDGE if seed is None else [(a, b) for a, b in random_graph(seed, 8, 12)]
    rows = [(a, b, 1.0 if seed is None else float(rng.randint(1, 5))) for a, b in pairs] + [(1, 1, 9.0), (1, 2, -3.0)]
    labels, levels = gr.louvain_communities(spark.createDataFrame(rows, "src long, dst long, w double"), "w")
    part = {r.id: r.community for r in labels.collect()}
    weights = {}
    for a, b, w in rows[:-2]:
        weights[min(a, b), max(a, b)] = weights.get((min(a, b), max(a, b)), 0) + w
    q = [r.modularity for r in levels.orderBy("level").collect()]
    assert all(x <= y + 1e-12 for x, y in zip(q, q[1:])) and abs(q[-1] - modularity_of(weights, part)) < 1e-9
    nodes = sorted({x for p in weights for x in p})
    best = max(modularity_of(weights, {x: i for i, c in enumerate(p) for x in c}) for p in partitions(nodes))
    assert q[-1] >= best - (1e-9 if seed is None else 0.06)
    assert all(part[c] == c == min(x for x in part if part[x] == c) for c in part.values())
    if seed is None:
        assert part == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 8: 8, 9: 8}
        assert {(r.community, r.n_nodes) for r in gr.community_sizes(labels).collect()} == {(1, 3), (4, 3), (8, 2)}


def test_ring_of_cliques_is_told_apart(spark):
    pairs = [(10 * c + a, 10 * c + b) for c in range(8) for a, b in itertools.combinations(range(5), 2)]
    pairs += [(10 * c, 10 * ((c + 1) % 8) + 1) for c in range(8)]
    labels, levels = gr.louvain_communities(edges(spark, pairs))
    assert {r.id: r.community for r in labels.collect()} == {x: x // 10 * 10 for p in pairs for x in p}
    assert gr.louvain_communities(edges(spark, []))[0].collect() == []


def test_communities(spark):
    joined = edges(spark, BRIDGE).filter("src < 8")
    got = {r.id: r.community for r in gr.split_communities(joined, 2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    labels = {r.id: r.community for r in gr.label_communities(edges(spark, BRIDGE)).collect()}
    assert labels[8] == labels[9] == 8 and labels[1] == labels[2]


def test_directed_reachability(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",), ("x",)], "id string")
    got = {(r.source, r.id) for r in gr.reachable(loop, start).collect()}
    assert got == {("a", "b"), ("a", "c"), ("x", "a"), ("x", "b"), ("x", "c")}


def test_roles(spark):
    rows = [(1, 9.0, 0.1), (2, 0.0, 0.9), (3, 0.0, 0.1), (4, 1.0, 0.2)]
    out = gr.role_labels(spark.createDataFrame(rows, "id long, b double, e double"), "b", "e")
    assert {r.id: r.role for r in out.collect()} == {1: "gatekeeper", 2: "accessor", 3: "other", 4: "other"}


def test_searches_over_several_blocks_of_nodes(spark):
    pairs = random_graph(11, 1100, 5000) + [(5000 + i, 5001 + i) for i in range(3)]
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    info = {s: paths_from(adj, s) for s in adj}
    frame = edges(spark, pairs)
    got = gr.shortest_paths(frame).toPandas()
    assert len(got) == sum(len(d) for d, _ in info.values())
    assert all(info[s][0][t] == d and info[s][1][t] == c for s, t, d, c in got.itertuples(index=False))
    profile = {(r.id, r.dist): r.n for r in gr.distance_profile(frame).collect()}
    assert profile == {(s, x): sum(y == x for y in d.values()) for s, (d, _) in info.items() for x in set(d.values())}
    nodes, links = gr.betweenness(frame)
    scores = {r.id: r.betweenness for r in nodes.collect()}
    # each pair's inner nodes and links add up to its distance
    far = sum(x for d, _ in info.values() for x in d.values()) / 2
    count = sum(len(d) - 1 for d, _ in info.values()) / 2
    assert abs(sum(scores.values()) - (far - count)) < 1e-6 * far
    through = links.collect()
    assert abs(sum(r.betweenness for r in through) - far) < 1e-6 * far
    assert len(through) == len({frozenset(p) for p in pairs})
    assert scores[5001] == scores[5002] == 2.0 and {r.betweenness for r in through if r.src >= 5000} == {3.0, 4.0}


def plans_stored(monkeypatch) -> list[str]:
    """The optimised plans of the tables that graph operators store from here on."""
    plans, keep = [], gr.keep

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(gr, "keep", noted)
    return plans


def test_a_stored_round_of_the_eigenvector_is_one_join(spark, monkeypatch):
    """Rounds that are not stored are joined without known sizes, and run again for their maximum."""
    plans = plans_stored(monkeypatch)
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long")
    gr.eigenvector(edges).collect()
    joins = [len(re.findall(r"\w*Join\b", p.split("Subqueries")[0])) for p in plans]
    assert sum(joins) >= 8 and max(joins) == 1


def test_links_are_shuffled_once_and_lie_in_ranges_of_their_first_node(spark, monkeypatch):
    plans = plans_stored(monkeypatch)
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3), (2, 3), (None, 4)], "src long, dst long")
    links, nodes = gr._linked(edges)
    assert sorted(map(tuple, links.collect())) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert sorted(r[0] for r in nodes.collect()) == [1, 2, 3]
    assert re.findall(r"Exchange (\w+)", plans[0]) == ["rangepartitioning"]


def test_moves_join_links_with_stored_tables_only(spark, monkeypatch):
    """Joined as they are computed, the tables of nodes and communities look larger than the links."""
    plans = plans_stored(monkeypatch)
    links = spark.createDataFrame([(a, b, 1.0) for a in range(6) for b in range(6) if a != b], "src long, dst long, w double")
    own = spark.createDataFrame([(i, i) for i in range(6)], "id long, community long")
    degree = links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    moves = gr._best_moves(links, own, degree, 30.0)
    assert len(plans) == 2  # nodes, communities
    assert sorted(r["id"] for r in moves.collect()) == list(range(6))
