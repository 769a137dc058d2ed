"""Source mixing: targets, the cube method's invariants, and the mix itself."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mix


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes, share=1.5, most=2.0):
    """Shares the excess again and again, as the contract words it."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    got, capped = dict.fromkeys(names, 0.0), set()
    total = share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        for s in names:
            got[s] = most * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free)
        over = {s for s in free if got[s] > most * sizes[s]}
        if not over:
            return got
        capped |= over


def check(docs, shard_rows):
    got = mix.mix_sources(docs, shard_rows=shard_rows).collect()
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    want = targets(sizes)
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((r["doc_id"], size(r["text"]), r["source"]) for r in rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    return got, taken, want


@pytest.mark.parametrize("shard_rows", [4000, 8])
def test_targets_and_totals(messy, shard_rows):
    got, taken, want = check(messy, shard_rows)
    again = mix.mix_sources(messy.repartition(2), shard_rows=shard_rows).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_each_source_comes_near_its_target(spark):
    rng = random.Random(4)
    rows = [(i, "w " * int(rng.lognormvariate(4, 1)), rng.choice(["a", "b", "c", "d", None])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for shard_rows in (4000, 50):
        _, taken, want = check(docs, shard_rows)
        for s, t in want.items():
            assert abs(taken[s] - t) <= 0.01 * t


def test_flight_keeps_number_and_words_and_leaves_few_undecided():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 400):
        p, words = rng.random(n).tolist(), rng.integers(1, 900, n).astype(float).tolist()
        out = mix.fly(p, words, rng)
        assert abs(sum(out) - sum(p)) < 1e-6 and abs(np.dot(out, words) - np.dot(p, words)) < 1e-3
        assert sum(0 < x < 1 for x in out) <= mix.LANDING and all(0 <= x <= 1 for x in out)
        landed = mix.land(out, words)
        assert set(landed) <= {0.0, 1.0} and abs(sum(landed) - sum(p)) < 6


def test_inclusion_is_right_on_average():
    p, words = [0.3] * 200, [float(i % 7 + 1) for i in range(200)]
    mean = np.mean([mix.land(x, words) for x in (mix.fly(p, words, np.random.default_rng(s)) for s in range(300))], axis=0)
    assert abs(mean.mean() - 0.3) < 0.02 and np.abs(mean - 0.3).max() < 0.15


def test_mix_repeats_whole_rows(messy):
    made = Counter((r["doc_id"], r["text"], r["source"]) for r in mix.mixed_documents(messy).collect())
    plan = mix.mix_sources(messy)
    total = plan.agg(F.sum("copies")).first()[0]
    assert sum(made.values()) == total and max(made.values()) <= 4  # a row that is there twice may come twice each
    by_id = Counter({r["doc_id"]: r["n"] for r in plan.groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()})
    assert +by_id == Counter(k for k, *_ in made.elements())


def test_no_documents_and_no_words(spark, nothing):
    assert mix.mix_sources(nothing).collect() == [] and mix.mixed_documents(nothing).collect() == []
    empty = spark.createDataFrame([(1, None, "a"), (2, " \t", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mix.mix_sources(empty).collect()] == [(0.0, 0), (0.0, 0)]
