"""Mixing sources to target weights with the cube method.

A source's rate (target over size) says how often each of its documents should
come on average; whole copies are taken outright and the fraction is an
inclusion probability. The cube method moves these probabilities along the null
space of the balancing constraints (number of documents, number of words) until
they are 0 or 1. Documents fly in shards of their source; what a shard leaves goes
on to the next level, until a source has just a few documents left. Of all ways
to round those, the landing takes the one nearest to the source's totals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import bucket, parts, stored

SHARD_ROWS = 4_000
WEIGHTS = (3.0, 1.0, 2.0)
#: Documents of a shard that the flight leaves undecided, at most.
LANDING = 14
_EPS = 1e-9


def word_count(text_col: str = "text") -> Column:
    """Runs of characters other than ASCII white space; NULL texts have none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Sources by code point, NULL last, take the weights in turn and share
    ``share`` times all sizes. A target stops at ``most`` times its source's
    size; the excess is shared again by weight until no target is above.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.get(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int"))
    rows = stored(sources.withColumn("weight", turn), "sources").withColumn("top", F.col("source_size") * F.lit(most))
    budget = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0  # words per unit of weight; only grows as sources reach their top
    while True:
        capped = F.col("weight") * level >= F.col("top")
        held, open_ = rows.agg(F.sum(F.when(capped, F.col("top"))), F.sum(F.when(~capped, F.col("weight")))).first()
        new = (budget - (held or 0.0)) / open_ if open_ else level
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", F.least("top", F.col("weight") * level).alias("target"))


# --- the cube method on one shard -------------------------------------------------


def fly(p: list[float], size: list[float], rng, leave: int = LANDING) -> list[float]:
    """Moves probabilities until at most ``leave`` lie strictly between 0 and 1.

    Three documents at a time have a direction in which neither their number
    nor their words change in total.
    """
    p = [float(round(v)) if v <= _EPS or v >= 1 - _EPS else v for v in p]
    waiting = [i for i in rng.permutation(len(p)).tolist() if 0.0 < p[i] < 1.0]
    undecided, open_ = len(waiting), []
    for i in waiting:
        if undecided <= leave:
            break
        open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)  # equal sizes: any exchange of two keeps both totals
            up = min((1 - p[j]) / d if d > 0 else p[j] / -d for j, d in zip(open_, u) if d)
            down = min(p[j] / d if d > 0 else (1 - p[j]) / -d for j, d in zip(open_, u) if d)
            step = up if rng.random() * (up + down) < down else -down
            for j, d in zip(open_, u):
                p[j] += step * d
                if p[j] <= _EPS or p[j] >= 1 - _EPS:
                    p[j] = float(round(p[j]))
            undecided += sum(0.0 < p[j] < 1.0 for j in open_) - 3
            open_ = [j for j in open_ if 0.0 < p[j] < 1.0]
    return p


def land(p: list[float], size: list[float]) -> list[float]:
    """Rounds the last probabilities: the choice nearest in words, in units of a middling document, and in number."""
    open_ = [i for i, v in enumerate(p) if 0.0 < v < 1.0]
    if not open_:
        return p
    rate, words = np.array([p[i] for i in open_]), np.array([size[i] for i in open_])
    choice = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))) & 1
    number = np.abs(choice.sum(axis=1) - rate.sum())
    off = np.abs(choice @ words - rate @ words) / max(1.0, float(np.median(words))) + number / 4
    p = list(p)
    for i, x in zip(open_, choice[int(off.argmin())]):
        p[i] = float(x)
    return p


def _level(rows: DataFrame, n_shards: int, level: int, last: bool) -> DataFrame:
    def flight(g: pd.DataFrame) -> pd.DataFrame:
        # the order is by hash and the draws by shard: reruns agree
        g = g.sort_values(["mark", "key", "size"], kind="stable")
        rng = np.random.default_rng(int(g["mark"].iloc[0]) & 0xFFFFFFFF)
        sizes = [float(x) for x in g["size"]]
        p = fly(g["p"].tolist(), sizes, rng)
        return g.assign(p=land(p, sizes) if last else p)

    shard = bucket(n_shards, "key", "size", F.lit(level))
    return rows.withColumn("shard", shard).groupBy("source", "shard").applyInPandas(
        flight, "key long, source string, size long, source_size long, target double, mark long, p double, whole int, shard int"
    ).drop("shard")


def mix_sources(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """How often each document comes in a mix of all sources.

    Returns one row per document: (id_col, size in words, source, source_size,
    target of its source in words, copies, taken = copies * size). Copies are 0
    up to the whole number at or above ``most``. The mix of each source comes
    within about one document of its target. A NULL source is a source of its
    own; documents without words are never taken; NULL ids and repeated rows
    are decided like any other row. Reruns agree.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    rows = stored(rows, "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    targets = stored(targets, "targets").withColumnRenamed("source", "__source")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("mark", F.xxhash64("key", "source", "size")).withColumn("p", rate)
    rows = rows.withColumn("whole", F.floor("p").cast("int")).withColumn("p", F.col("p") - F.col("whole"))
    n = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    level, done, shard_rows = 0, [], max(shard_rows, 4 * LANDING)  # a level has to leave less than it gets
    while True:
        n_shards = parts(n, shard_rows)
        rows = stored(_level(rows, n_shards, level, last=n_shards == 1), f"flight-{level}")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(rows.filter(~undecided))
        if n_shards == 1:
            break
        rows = rows.filter(undecided)
        n, level = LANDING * n_shards, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    copies = F.col("whole") + F.col("p").cast("int")
    return out.select(
        F.col("key").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: each row as often as :func:`mix_sources` takes it, with all its columns.

    Rows that agree in id, source and size are told apart by their text.
    """
    mark = ["__key", "__source", "__size", "__turn"]
    rows = docs.select("*", F.col(id_col).cast("long").alias("__key"), F.col(source_col).alias("__source"), word_count(text_col).alias("__size"))
    rows = rows.withColumn("__turn", F.row_number().over(Window.partitionBy(*mark[:3]).orderBy(F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))))
    taken = mix_sources(docs, share, most, weights, id_col, text_col, source_col).select(
        F.col(id_col).alias("t_key"), F.col(source_col).alias("t_source"), F.col("size").alias("t_size"), "copies"
    )
    taken = taken.withColumn("t_turn", F.row_number().over(Window.partitionBy("t_key", "t_source", "t_size").orderBy("copies"))).filter("copies > 0")
    same = [F.col(m).eqNullSafe(F.col("t" + m[1:])) for m in mark]
    found = rows.join(taken, same[0] & same[1] & same[2] & same[3])
    return found.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).drop("__copy")
