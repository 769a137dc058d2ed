"""Near-duplicate classes against brute force, and signatures against their meaning."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import near


def shingle_set(t, width=5):
    w = (t or "").split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows):
    """Class of each id: the least id that it is connected with; equal texts or similar shingle sets connect."""
    up = {i: i for i, _ in rows if i is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i in up}


def test_classes_equal_brute_force(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    want = brute(rows)
    got = near.near_duplicate_classes(messy).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == sorted((str(i), str(want.get(i))) for i, _ in rows)
    assert len(set(want.values())) < len(want) - 5


def test_chain_of_copies_and_texts_that_share_a_long_passage(spark):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(40):  # each differs from the one before in one word: neighbours are near, the ends are not
        words = list(words)
        words[rng.randrange(len(words))] = f"new{i}"
        rows.append((i, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(90))
    rows += [(100 + i, passage + " " + " ".join(f"q{i}x{j}" for j in range(25 + i))) for i in range(30)]
    want = brute(rows)
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_pairs_with_unequal_repeats_are_linked(spark):
    rows = []
    for i in range(150):  # one text of a pair has a passage 50 times, the other once
        passage, rest = " ".join(f"p{i}x{n}" for n in range(24)), " ".join(f"r{i}x{n}" for n in range(80))
        rows.append((2 * i, f"{rest} " + " ".join([passage] * 50)))
        rows.append((2 * i + 1, f"{rest} {passage} " + " ".join(f"z{i}x{n}" for n in range(i % 18))))
    want = brute(rows)
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) == 150


def test_bands_by_equal_weights_stand_beside_those_by_weight_only_where_counts_differ():
    texts = ["a b c d e f g", "a b c d e f g " * 9 + "x y z", "", "a a a a a a a", "a b c d e f g x y z"]
    t, h, count = near.weighted_shingles(texts)
    got = [x.tolist() for x in near.text_bands(t, h, count, len(texts), 20, 4)]
    assert [len(x) for x in got] == [20, 40, 0, 20, 20]
    plain = near.band_hashes(t, h, np.ones(len(t)), len(texts), 20, 4)
    assert got[1][20:] == plain[1].tolist() and got[0] == plain[0].tolist() and got[3] == plain[3].tolist()
    assert near.text_bands(t[:0], h[:0], count[:0], 2, 20, 4)[1].tolist() == []


def test_components_agree_as_often_as_probability_jaccard_says():
    rng = np.random.default_rng(4)
    h = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    a[:60], b[-60:] = 0, 0
    text = np.repeat([0, 1], 300)
    w = np.concatenate([a, b])
    keep = w > 0
    sig = near.prob_min_hash(text[keep], np.concatenate([h, h])[keep], w[keep], 2, 4000)
    both = np.flatnonzero((a > 0) & (b > 0))
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in both)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_signature_does_not_depend_on_the_batch():
    texts = ["one two three four five six", "x", "a b c d e f g h i j k"]
    alone = [near.prob_min_hash(*(lambda t, h, c: (t, h, 1 + np.log(c)))(*near.weighted_shingles([x])), 1, 80)[0] for x in texts]
    t, h, c = near.weighted_shingles(texts)
    assert (near.prob_min_hash(t, h, 1 + np.log(c), 3, 80) == np.array(alone)).all()


def test_one_of_each_class_stays(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    got = near.keep_one_of_each(messy)
    assert got.columns == messy.columns
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) <= set(rows)
    named = [(i, t) for i, t in rows if i is not None]
    named_classes = set(brute(named).values())
    assert {i for i, _ in got if i is not None} <= named_classes


def test_rows_without_an_id_and_repeated_rows_leave_one_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near_copy = long + " end"
    other = " ".join(f"o{i}" for i in range(40))
    rows = [(None, long, "a"), (None, near_copy, "b"), (5, long, "c"), (5, long, "c"), (7, near_copy, "d"), (8, other, "e"), (8, other, "f"),
            (9, None, "g"), (10, "", "h"), (10, "", "h"), (None, None, "i"), (None, None, "i"), (None, "alone here", "j")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(map(tuple, near.keep_one_of_each(frame).collect()), key=str)
    assert sum(r[1] in (long, near_copy) for r in got) == 1
    assert next(r for r in got if r[1] in (long, near_copy))[0] is None
    rest = [r for r in got if r[1] not in (long, near_copy)]
    assert [r[0] for r in rest if r[1] == other] == [8]
    assert sorted([r[:2] for r in rest if r[1] != other], key=str) == sorted([(9, None), (10, ""), (None, None), (None, "alone here")], key=str)
    again = sorted(map(tuple, near.keep_one_of_each(frame.repartition(5, "text")).collect()), key=str)
    assert again == got


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "  ")]])
def test_nothing_to_compare(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near.near_duplicate_classes(frame).collect())) == [(i, i) for i, _ in rows]


@pytest.mark.parametrize("passed", [lambda t: near.signatures(t, 5, 4, 2), lambda t: near.shingle_sets(t, 5)])
def test_workers_give_memory_back_after_each_batch(monkeypatch, passed):
    """A worker that an earlier stage has filled keeps that memory otherwise, next to what this stage needs."""

    class Texts:
        def mapInPandas(self, per_batch, schema):
            return per_batch

    given = []
    monkeypatch.setattr(near, "give_back", lambda: given.append(1), raising=False)
    frames = [pd.DataFrame({"key": [i, i + 1], "text": ["a b c d e f", ""]}) for i in range(3)]
    rows = pd.concat(passed(Texts())(iter(frames)))
    assert rows["key"].tolist() == [0, 1, 1, 2, 2, 3] and len(given) == 3


def test_texts_without_a_wanted_key_are_dropped_before_the_shuffle(spark):
    rows = spark.range(-500, 40_000).select(F.col("id").alias("key"), F.lit("t").alias("text"))
    wanted = rows.select("key").filter("key % 40 = 0").distinct()
    left = {r["key"] for r in near._of_keys(rows, wanted).collect()}
    want = {k for k in range(-500, 40_000) if k % 40 == 0}
    assert want <= left and len(left) < len(want) + 0.1 * 40_500
    assert near._of_keys(rows, wanted.limit(0)).count() == 0
