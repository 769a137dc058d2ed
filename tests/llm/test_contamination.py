"""Benchmark passages in documents against brute force over all windows."""

import random
import re

import numpy as np
import pytest

from tallyloom.llm import contamination as con

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if (x := tuple(w[p : p + size])) in windows:
                    hit.update(range(p, p + size))
                    found |= windows[x]
        out.append((str(i), len(w), len(hit), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out)


def run(docs, items, **options):
    rows = con.find_contamination(docs, items, **options).collect()
    out = []
    for r in rows:
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        hit = tuple(p for a, b in spans for p in range(a, b))
        assert r["n_hit"] == len(hit)
        out.append((str(r["doc_id"]), r["n_words"], r["n_hit"], hit, tuple(r["items"])))
    return sorted(out)


def tables(spark, messy, seed=6):
    rng = random.Random(seed)
    texts = [r["text"] for r in messy.collect() if r["text"]]
    items = []
    for i in range(60):
        w = rng.choice(texts).split(" ")
        at = rng.randrange(len(w))
        items.append((i % 50, " ".join(w[at : at + rng.randrange(1, 30)]).upper()))
    items += [(None, "a"), (70, None), (71, ""), (72, "... !"), (73, items[3][1]), (74, "x"), (3, items[9][1]), (75, "no such words are anywhere here " * 3)]
    return spark.createDataFrame([(*x, 1, "z") for x in items], "item_id long, text string, window int, item string"), items


@pytest.mark.parametrize("width, block, size", [(10, 100_000, 4 << 20), (10, 60, 4 << 20), (4, 100_000, 300), (2, 40, 300)])
def test_hits_equal_brute_force(spark, messy, monkeypatch, width, block, size):
    monkeypatch.setattr("tallyloom.llm.bytescan.SLICE_BYTES", size)
    items, plain = tables(spark, messy)
    want = brute([(r["doc_id"], r["text"]) for r in messy.collect()], plain, width)
    assert run(messy, items, width=width, block_rows=block) == want
    assert sum(w[2] > 0 for w in want) > 20


def test_hot_passage_and_repeated_words(spark):
    passage = "the same ten words stand in very many documents of this table"
    docs = [(i, f"{i} {passage} {i}" if i % 3 else "a a a a a a a a a a a a") for i in range(300)]
    items = [(1, passage), (2, passage + " and on it goes"), (3, "a " * 11), (4, "b " * 3)]
    want = brute(docs, items, 10)
    assert run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == want


def test_prefix_is_the_rarest_shingle():
    block = con.make_block([("a b c d", "1"), ("b c d e", "2"), ("x", "3")])
    counts = np.array([5, 1, 9, 4])[: len(block.keys)]
    block.choose_prefixes(counts)
    assert len(block.shapes) == 2 + 1 or len(block.shapes) == 3
    ids, text = con.Reader(block).read(np.frombuffer(b"A b,c D e x", np.uint8), np.array([0, 11]))
    start, length, window = block.occurrences(ids, text, np.array([0]), np.array([len(ids)]))
    assert sorted(zip(start.tolist(), length.tolist())) == [(0, 4), (1, 4), (5, 1)]


def test_nothing_and_no_items(spark, messy, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    items, plain = tables(spark, messy)
    assert run(nothing, items) == []
    assert run(messy, none) == brute([(r["doc_id"], r["text"]) for r in messy.collect()], [], 10)
    with pytest.raises(ValueError):
        con.find_contamination(messy, items, block_rows=1 << 20)
