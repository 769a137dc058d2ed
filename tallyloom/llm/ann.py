"""Approximate nearest neighbours: one navigable small-world graph per shard.

Nodes enter a shard's graph in random order; each level links a node to diverse
near nodes that came before it and links back, so every level stays navigable.
The candidates of a node come from blocked products over the nodes before it.
Neighbours are flat arrays, -1 where a node has fewer. A query descends greedily
to the ground level, searches it with a beam, and the shards' results merge.
Equal directions of a shard are one node; a node that is found stands for all its
rows, the smallest ids of equal vectors first.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bucket, parts, stored
from tallyloom.llm.topk import best_of_shards

SHARD_ROWS = 8192
QUERY_BLOCK = 2048
WIDTH = 16
BEAM = 96
POOL = 48


def _diverse(sims: np.ndarray, cand: np.ndarray, unit: np.ndarray, m: int) -> np.ndarray:
    """Up to m candidates, nearest first, each nearer to the node than to one already taken."""
    nearer = (unit[cand] @ unit[cand].T) > sims[:, None]
    open_, taken = np.ones(len(cand), bool), []
    while len(taken) < m and open_.any():
        i = int(open_.argmax())
        taken.append(i)
        open_ &= ~nearer[:, i]
        open_[i] = False
    if len(taken) < m:  # fill up with the nearest left
        rest = np.ones(len(cand), bool)
        rest[taken] = False
        taken += np.flatnonzero(rest)[: m - len(taken)].tolist()
    return cand[taken]


def build_level(unit: np.ndarray, nodes: np.ndarray, m: int, pool: int = POOL, block: int = 512) -> np.ndarray:
    """Flat neighbour array (rows of 3 m node numbers, -1 to fill) of one level."""
    links = np.full((len(unit), 3 * m), -1, np.int32)
    degree = np.zeros(len(unit), np.int32)
    for lo in range(0, len(nodes), block):
        own, before = nodes[lo : lo + block], nodes[: lo + block]
        sims = unit[own] @ unit[before].T
        sims[np.arange(len(before))[None, :] >= (lo + np.arange(len(own)))[:, None]] = -np.inf
        take = min(pool, len(before))
        near = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        for r, node in enumerate(own):
            c = near[r][np.argsort(-sims[r, near[r]], kind="stable")]
            c = c[sims[r, c] > -np.inf]
            if not len(c):
                continue
            chosen = _diverse(sims[r, c], before[c], unit, m)
            links[node, : len(chosen)], degree[node] = chosen, len(chosen)
            for other in chosen.tolist():  # link back; a full node keeps its 2 m diverse nearest
                if degree[other] == 3 * m:
                    s = unit[links[other]] @ unit[other]
                    o = np.argsort(-s, kind="stable")
                    kept = _diverse(s[o], links[other][o], unit, 2 * m)
                    links[other] = -1
                    links[other, : len(kept)], degree[other] = kept, len(kept)
                links[other, degree[other]] = node
                degree[other] += 1
    return links


def build_graph(unit: np.ndarray, m: int = WIDTH, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the ground up: (node numbers in order of entry, neighbour array)."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(unit))
    height = np.floor(-np.log(1 - rng.random(len(unit))) / np.log(m)).astype(int)
    graph, level = [], 0
    while len(nodes := order[height[order] >= level]):
        graph.append((nodes, build_level(unit, nodes, m)))
        level += 1
    return graph


def search_graph(unit: np.ndarray, graph, q: np.ndarray, beam: int) -> np.ndarray:
    """Node numbers that a beam search of the graph ends with."""
    best = int(graph[-1][0][0])
    near = float(unit[best] @ q)
    for _, links in graph[:0:-1]:
        while True:
            c = links[best]
            c = c[c >= 0]
            if not len(c):
                break
            s = unit[c] @ q
            i = int(s.argmax())
            if s[i] <= near:
                break
            best, near = int(c[i]), float(s[i])
    links = graph[0][1]
    seen = np.zeros(len(unit), bool)
    seen[best] = True
    front, kept = [(-near, best)], [(near, best)]
    while front:
        s, node = heapq.heappop(front)
        if -s < kept[0][0] and len(kept) >= beam:
            break
        c = links[node]
        c = c[c >= 0]
        c = c[~seen[c]]
        if not len(c):
            continue
        seen[c] = True
        for t, i in zip((unit[c] @ q).tolist(), c.tolist()):
            if len(kept) < beam:
                heapq.heappush(kept, (t, i))
                heapq.heappush(front, (-t, i))
            elif t > kept[0][0]:
                heapq.heapreplace(kept, (t, i))
                heapq.heappush(front, (-t, i))
    return np.array([i for _, i in kept])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(key, x): finite vectors with an id and a length above zero, as doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("key"), F.transform(vec_col, lambda c: c.cast("double")).alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.filter("key is not null and x is not null").filter(finite & F.exists("x", lambda c: c != 0))
    return rows.groupBy("key").agg(F.min("x").alias("x"))


def index_shards(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", m: int = WIDTH) -> DataFrame:
    """One row per shard and vector length: ids, vectors and their nodes, and the graph as flat arrays.

    NULL vectors, vectors with NULL or non-finite components or of length zero,
    and rows without an id are left out; of rows that share an id, the least
    vector is indexed.
    """
    rows = usable(vectors, id_col, vec_col).withColumn("width", F.size("x"))
    n_shards = parts(vectors.count(), SHARD_ROWS)

    def build(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("key")
        x = np.array(g["x"].tolist()) + 0.0  # no negative zeros
        unit = _unit(x)
        node, same = (np.unique(v, axis=0, return_inverse=True)[1].reshape(-1) for v in (unit, x))
        order = np.lexsort((same, node))  # stable: ids stay sorted among equal vectors
        x, node = x[order], node[order]
        graph = build_graph(unit[order][np.diff(node, prepend=-1) > 0], m)
        return pd.DataFrame({
            "shard": [g["shard"].iloc[0]], "width": [g["width"].iloc[0]], "ids": [g["key"].to_numpy("<i8")[order].tobytes()],
            "vectors": [x.astype("<f8").tobytes()], "owners": [node.astype("<i4").tobytes()], "nodes": [[n.astype("<i4").tobytes() for n, _ in graph]],
            "links": [[e[n].astype("<i4").tobytes() for n, e in graph]],
        })

    return rows.withColumn("shard", bucket(n_shards, "key")).groupBy("shard", "width").applyInPandas(
        build, "shard int, width int, ids binary, vectors binary, owners binary, nodes array<binary>, links array<binary>"
    )


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision; scaling by the largest component keeps squares finite."""
    q, x = q / np.abs(q).max(), x / np.abs(x).max(axis=1, keepdims=True)
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = BEAM,
    m: int = WIDTH,
) -> DataFrame:
    """The k nearest found for each query by cosine, nearest first, ties to the smaller id.

    Every usable row is indexed and searched (see :func:`index_shards`); a query
    never meets its own id. Shards with at most ``beam`` different directions are scanned whole,
    so small tables give all candidates. Scores are cosines of the original
    vectors in double precision. Returns (query_id, rank, vec_id, score).
    """
    index = stored(index_shards(vectors, id_col, vec_col, m), "ann-index")
    n_blocks = parts(queries.count(), QUERY_BLOCK)
    asked = usable(queries, id_col, vec_col).withColumn("width", F.size("x")).withColumn("block", bucket(n_blocks, "key"))
    shards = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    places = index.select(F.col("shard").alias("place"), F.col("width").alias("own_width"))
    asked = asked.join(places, F.col("width") == F.col("own_width")).select("key", "x", "block", F.col("place").alias("shard"), "width")

    def one_group(s: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if s.empty or q.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        s, found = s.iloc[0], []
        ids = np.frombuffer(s["ids"], "<i8")
        x = np.frombuffer(s["vectors"], "<f8").reshape(len(ids), -1)
        node = np.frombuffer(s["owners"], "<i4")
        new = np.diff(node, prepend=-1) > 0
        unit, graph = _unit(x[new]), []
        new[1:] |= (x[1:] != x[:-1]).any(axis=1)
        place = np.arange(len(ids))
        few = place - place[new][np.cumsum(new) - 1] <= k  # of equal vectors no other rows can be among the k
        ids, x, node = ids[few], x[few], node[few]
        at = np.searchsorted(node, np.arange(len(unit) + 1))
        for n, e in zip(s["nodes"], s["links"]):
            n = np.frombuffer(n, "<i4")
            links = np.full((len(unit), 3 * m), -1, np.int32)
            links[n] = np.frombuffer(e, "<i4").reshape(len(n), -1)
            graph.append((n, links))
        for key, v in zip(q["key"], q["x"]):
            v = np.array(v)
            if len(unit) <= beam:
                c = np.arange(len(ids))
            else:
                c = np.concatenate([np.arange(at[i], at[i + 1]) for i in search_graph(unit, graph, _unit(v[None])[0], beam)])
            c = c[ids[c] != key]
            score = cosine(v, x[c])
            best = np.lexsort((ids[c], -score))[:k]
            found.append(pd.DataFrame({"query_id": key, "vec_id": ids[c][best], "score": score[best]}))
        return pd.concat(found)

    found = shards.groupBy("shard", "width", "block").cogroup(asked.toDF("key", "x", "block", "shard", "width").groupBy("shard", "width", "block")).applyInPandas(
        one_group, "query_id long, vec_id long, score double"
    )
    return best_of_shards(found, k, "score")
