"""Packing of token pieces into sequences by a grouping genetic algorithm.

The pieces of a shard are one packing problem, evolved on several islands. A
chromosome is a list of bins. Crossover injects whole well-filled bins of one
parent into the other, removes the bins that hold injected pieces again, and
puts displaced pieces back best fit. After a round, each island's best packing
migrates to the next island, and a second round goes on from there.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bucket, give_back, id_and_text, parts, shown_id, stored
from tallyloom.llm.tokens import encode

SIZE = 1024
END = 2
SHARD_PIECES = 8192
ISLANDS = 2
POPULATION = 4
GENERATIONS = 6


# --- pieces -----------------------------------------------------------------------


def token_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``size``; only the first may be shorter.

    Returns (key, piece, start, length, ids_crc32), with ``with_ids`` also the
    ids. A NULL or empty text is one piece that holds just the end id.
    """

    def per_batch(batches):
        for b in batches:
            out, own = [], []
            for key, ids in zip(b["key"].tolist(), encode(b["text"].tolist(), vocabulary)):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                head = len(ids) % size or size
                edges = [0, *range(head, len(ids) + 1, size)]
                for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
                    out.append((key, i, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
                    if with_ids:
                        own.append(ids[lo:hi].astype("<i4"))
            made = pd.DataFrame(out, columns=["key", "piece", "start", "length", "ids_crc32"])
            yield made.assign(ids=own) if with_ids else made
            del b, out, own, made
            give_back()

    schema = "key long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return id_and_text(docs, id_col, text_col).mapInPandas(per_batch, schema)


# --- the genetic algorithm on one shard -------------------------------------------


class _Bins:
    """Bins of one chromosome, found by free room: a bit mask of the rooms in use."""

    def __init__(self, sizes: list[int], room: int):
        self.sizes, self.bins, self.free, self.by_room, self.mask = sizes, [], [], [[] for _ in range(room + 1)], 0
        self.room = room

    def add(self, items: list[int]) -> None:
        left = self.room - sum(self.sizes[i] for i in items)
        self.by_room[left].append(len(self.bins))
        self.mask |= 1 << left
        self.bins.append(items)
        self.free.append(left)

    def best_fit(self, items) -> None:
        for i in items:
            size = self.sizes[i]
            fits = self.mask >> size
            if not fits:
                self.add([i])
                continue
            left = size + (fits & -fits).bit_length() - 1
            b = self.by_room[left].pop()
            if not self.by_room[left]:
                self.mask &= ~(1 << left)
            self.bins[b].append(i)
            self.free[b] = left = left - size
            self.by_room[left].append(b)
            self.mask |= 1 << left


def _packed(sizes, room, bins, items) -> list[list[int]]:
    p = _Bins(sizes, room)
    for b in bins:
        p.add(list(b))
    p.best_fit(items)
    return p.bins


def _worth(sizes, room, bins) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean squared fill)."""
    fill = [sum(sizes[i] for i in b) / room for b in bins]
    return -len(bins), sum(f * f for f in fill) / max(1, len(fill))


def _cross(sizes, room, a, b, rng) -> list[list[int]]:
    full = sorted(b, key=lambda x: room - sum(sizes[i] for i in x))[: max(1, len(b) // 2)]
    injected = rng.sample(full, max(1, len(full) // 2))
    taken = {i for x in injected for i in x}
    kept, loose = list(injected), []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(x)
        else:
            loose += [i for i in x if i not in taken]
    # the emptiest bins are opened too, so that their pieces can move
    kept.sort(key=lambda x: sum(sizes[i] for i in x))
    for x in kept[: max(1, len(kept) // 20)]:
        loose += x
    loose.sort(key=lambda i: -sizes[i])
    return _packed(sizes, room, kept[max(1, len(kept) // 20) :], loose)


def evolve(sizes: list[int], room: int, rng: random.Random, elites: list[list[list[int]]], generations: int = GENERATIONS, population: int = POPULATION):
    """The best packing found. ``sizes`` are in descending order; ``elites`` come from other islands."""
    least = -(-sum(sizes) // room)
    people = [_packed(sizes, room, [], range(len(sizes)))] + list(elites)
    while len(people) < population and len(people[0]) > least:
        jitter = sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.85, 1.15))
        people.append(_packed(sizes, room, [], jitter))
    worth = lambda p: _worth(sizes, room, p)
    people.sort(key=worth, reverse=True)
    for _ in range(generations):
        if len(people[0]) <= least or len(people) < 2:
            break
        a, b = rng.sample(people, 2)
        child = _cross(sizes, room, a, b, rng)
        people = sorted([*people, child], key=worth, reverse=True)[:population]
    return people[0]


# --- operator ---------------------------------------------------------------------


def pack_pieces(pieces: DataFrame, size: int = SIZE, islands: int = ISLANDS) -> DataFrame:
    """Adds (sequence_id, offset) to pieces: sequences of at most ``size`` ids, gapless from 0.

    Pieces of the full size are sequences by themselves. The others are packed
    by shard, as rows of the same group, so repeated rows need no identity.
    """
    pieces = stored(pieces, "pieces")
    n_shards = parts(pieces.count(), SHARD_PIECES)
    order = ["length", "key", "piece", "ids_crc32"]
    rows = pieces.withColumn("shard", bucket(n_shards, "key", "piece", "ids_crc32"))
    own = rows.filter(F.col("length") < size).select("shard", *order)
    every = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))

    def sizes_of(g: pd.DataFrame) -> list[int]:
        return sorted(g["length"].tolist(), reverse=True)

    def flat(shard, island, bins, n) -> pd.DataFrame:
        at = np.empty(n, np.int32)
        for b, items in enumerate(bins):
            at[items] = b
        return pd.DataFrame({"shard": [shard], "island": [island], "bins": [at.tolist()]})

    def unflat(at) -> list[list[int]]:
        bins: list[list[int]] = [[] for _ in range(int(max(at)) + 1)]
        for i, b in enumerate(at):
            bins[b].append(i)
        return bins

    def first_round(g: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(g["shard"].iloc[0]), int(g["island"].iloc[0])
        bins = evolve(sizes_of(g), size, random.Random(f"{shard}-{island}-1"), [])
        return flat(shard, island, bins, len(g))

    def second_round(g: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(g["shard"].iloc[0]), int(g["island"].iloc[0])
        elites = [unflat(x) for x in came["bins"]]
        bins = evolve(sizes_of(g), size, random.Random(f"{shard}-{island}-2"), elites)
        return flat(shard, island, bins, len(g))

    def place(g: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        whole = int((g["length"] >= size).sum())
        at = np.arange(len(g), dtype=np.int64)
        if len(best):
            bins = np.array(min(best.sort_values("island")["bins"], key=max))
            at[whole:] = whole + bins
        by_bin = g["length"].groupby(at)
        g["sequence_id"], g["offset"] = at + (int(g["shard"].iloc[0]) << 32), by_bin.cumsum() - g["length"]
        return g.drop(columns="shard")

    schema = "shard int, island int, bins array<int>"
    elites = every.groupBy("shard", "island").applyInPandas(first_round, schema)
    moved = stored(elites, "elites").withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
    best = every.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island")).applyInPandas(second_round, schema)
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return rows.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(place, out)


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, islands: int = ISLANDS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as token pieces in as few sequences of at most ``size`` ids as the search finds.

    A document is its ids and the id ``end``; only longer ones are cut, into
    pieces of ``size`` of which the first may be shorter. Returns one row per
    piece: (id_col, piece, start, length, ids_crc32, sequence_id, offset), with
    ``with_ids`` also the ids. NULL texts are empty, so each row has a piece;
    repeated rows are packed each; an empty table gives no rows.
    """
    pieces = token_pieces(docs, vocabulary, size, end, id_col, text_col, with_ids)
    return pack_pieces(pieces, size, islands).withColumn("key", shown_id()).withColumnRenamed("key", id_col)
