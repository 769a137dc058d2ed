"""Collocations against brute force, with tiles of every kind."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import collocations as col
from tallyloom.llm.bytescan import column_bytes


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", low)]


def brute(rows, least, longest, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for p in pieces_of(text):
            n[lang] += len(p)
            for m in range(1, longest + 1):
                f.update((lang, tuple(p[i : i + m])) for i in range(len(p) - m + 1))
    held = {k: a for k, a in f.items() if a >= least}
    out = {}
    for (lang, w), a in held.items():
        if len(w) < 2 or any(b >= a and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), b in held.items() if x == lang):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, le, ri, n[lang], -s) for lang, x in out.items() for i, (s, a, p, le, ri) in enumerate(sorted(x)[:top], 1)
    )


def run(docs, **options):
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in names) for r in col.collocations(docs, **options).collect())


def make_rows(seed=3, n=250):
    rng = random.Random(seed)
    vocabulary = ["la", "De", "é", "ab", "to\x0bbe", "x\x00y", *("w%d" % i for i in range(40))]
    fixed = ["new york city hall is open", "of the de la", "ñandú é é é é é"]
    rows = []
    for i in range(n):
        body = [rng.choice(vocabulary[: rng.choice([4, 46])]) for _ in range(rng.randrange(25))]
        if i % 3 == 0:
            body.insert(rng.randrange(len(body) + 1), rng.choice(fixed))
        rows.append((rng.choice([" ", "\t", " , ", ".\n"]).join(body), rng.choice(["en", "en", "fr", None])))
    return rows + [("", "en"), (None, "en"), (" . ", "xx"), rows[5], rows[5]]


@pytest.mark.parametrize(
    "least, longest, top, tile, dense, chunk", [(5, 5, 2000, 1 << 20, 1 << 18, 6 << 20), (4, 5, 30, 40, 12, 900), (3, 3, 2000, 200, 1 << 18, 300), (6, 2, 5, 60, 0, 100)]
)
def test_collocations_equal_brute_force(spark, monkeypatch, least, longest, top, tile, dense, chunk):
    monkeypatch.setattr(col, "DENSE_CELLS", dense)
    monkeypatch.setattr(col, "CHUNK_BYTES", chunk)
    rows = make_rows()
    docs = spark.createDataFrame([(*r, "c", 1, 2.0) for r in rows], "text string, lang string, chunk string, id int, f double").repartition(5)
    want = brute(rows, least, longest, top)
    assert run(docs, least=least, longest=longest, top=top, tile_pairs=tile) == want
    assert len(want) > 10


def test_passage_that_a_third_of_all_rows_share(spark):
    rng = random.Random(8)
    rows = [("one of very many copies", "en") if i % 3 == 0 else (" ".join(rng.choice("abcdef") for _ in range(9)), "en") for i in range(900)]
    assert run(spark.createDataFrame(rows, "text string, lang string").repartition(6), tile_pairs=100) == brute(rows, 100, 5, 2000)


def test_scores_stay_exact_past_64_bits(spark, monkeypatch):
    big = 10**12
    sizes = spark.createDataFrame([("en", 9 * 10**14)], "lang string, n long")
    freq = spark.createDataFrame([("en", ["a"], 3 * big), ("en", ["b"], 7 * big), ("en", ["a", "b"], big)], "lang string, words array<string>, f long")
    monkeypatch.setattr(col, "frequent_phrases", lambda *a: (sizes, freq))
    assert run(None) == [("en", 1, "a b", big, 3 * big, 7 * big, 9 * 10**14, 1000 * big * 9 * 10**14 // (21 * big * big))]


def test_tiles_count_alike_in_place_and_sorted():
    rng = np.random.default_rng(4)
    cuts = np.array([0, 3, 10, 40])
    tiling = col.Tiling({"x": cuts}, {"x": cuts}, {"x": 90}, {"x": 90})
    u, v = rng.integers(0, 90, 5000) // rng.integers(1, 9, 5000), rng.integers(0, 90, 5000)
    key, tile = (u << 32) | v, tiling.tiles("x", u, v)
    kinds = set()
    for t in np.unique(tile).tolist():
        own = key[tile == t]
        kinds.add(tiling.area("x", t) is not None and len(own) * 4 >= np.prod(tiling.area("x", t)[2:]))
        for weight in (None, np.full(len(own), 3)):
            got = tiling.count("x", t, own, weight)
            want = np.unique(own, return_counts=True)
            assert (got[0] == want[0]).all() and (got[1] == want[1] * (1 if weight is None else 3)).all()
    assert kinds == {True, False}


def test_codes_of_words():
    buf, at = column_bytes(pa.array(["Ab b,c", "", "c. . b"]))
    words, counts, codes = col.coded_words(buf, at)
    assert (words, counts.tolist(), codes.tolist()) == (["ab", "b", "c"], [1, 2, 2], [0, 1, -1, 2, -1, 2, -1, 1])


def test_no_documents(nothing, spark):
    assert run(nothing) == []
    assert run(spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")) == []


def test_chunks_of_a_batch_are_read_one_at_a_time():
    place = np.arange(0, 200_000, 2)
    batch = pa.Table.from_batches([col._state(c, "en", place, place % 999, place % 77) for c in range(40)]).combine_chunks().to_batches()[0]
    tracemalloc.start()
    seen = [(c, lang, int(p[-1]), int(u.sum()), int(x.sum())) for c, lang, p, u, x in col._state_rows(batch)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [(c, "en", 199_998, int((place % 999).sum()), int((place % 77).sum())) for c in range(40)]
    assert most < 15e6


def test_state_of_words_and_pairs_take_few_bytes():
    rng = np.random.default_rng(6)
    place, unit = np.arange(50_000), rng.integers(0, 3000, 50_000)
    words, phrases = (col._state(7, "en", place, unit, last) for last in (unit, unit.copy()))
    assert words.nbytes < 0.75 * phrases.nbytes
    for b in (words, phrases):
        (_, _, p, u, x), = col._state_rows(b)
        assert (p == place).all() and (u == unit).all() and (x == unit).all()
    key = np.unique((unit[:-1] << 32) | unit[1:])
    packed = col.pair_bytes(key)
    assert (col.from_pair_bytes(packed) == key).all() and len(col.from_pair_bytes(col.pair_bytes(key[:0]))) == 0
    assert len(pa.compress(packed, "lz4", asbytes=True)) < 0.6 * len(pa.compress(key.tobytes(), "lz4", asbytes=True))
