"""Line dedup and its minimal perfect hash against plain Python."""

import numpy as np
import pytest

from tallyloom.llm import lines

WHITE = " \t\n\v\f\r"


def low(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(WHITE))


def brute(rows, min_docs=3, min_points=20):
    key = lambda i: -(2**63) if i is None else i
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(low(x)) >= min_points:
                held.setdefault(low(x), set()).add(key(i))
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(held.get(low(x), ())) < min_docs or max(held[low(x)]) == key(i)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        levels = lines.build_mph(keys)
        assert sorted(lines.probe_mph(levels, keys).tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("per_shard, per_task", [(5, 1_000_000), (100_000, 1_000_000), (100_000, 40), (5, 3)])
def test_lines_equal_brute_force(messy, monkeypatch, per_shard, per_task):
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", per_shard)
    monkeypatch.setattr(lines, "ASKED_PER_TASK", per_task)
    monkeypatch.setattr(lines, "CHUNK_BYTES", 3000)
    want = brute([(r["doc_id"], r["text"]) for r in messy.collect()])
    got = sorted(map(tuple, lines.drop_repeated_lines(messy).collect()), key=str)
    assert got == want
    assert sum(r[2] for r in got) > 10


def test_repeats_inside_the_keeping_document_stay_and_copies_of_a_row_count_once(spark):
    x = "a line of more than twenty points"
    rows = [(1, x), (2, x), (2, x), (3, x + "\n" + x.upper() + "\nown")]
    got = {(r["doc_id"], r["n_dropped"], r["text"]) for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, ""), (2, 1, ""), (3, 0, rows[3][1])}
    two = spark.createDataFrame(rows[1:3] + [(5, x)], "doc_id long, text string")
    assert lines.drop_repeated_lines(two).filter("n_dropped > 0").isEmpty()


def test_rows_without_an_id_are_one_document_in_many_chunks(spark, monkeypatch):
    x, y = "a line of more than twenty points", "one more line of more than twenty points"
    rows = [(None, f"{x}\nown line {i} of the row without an id") for i in range(10_000)] + [(1, x), (2, f"{x}\n{y}"), (3, y), (None, y)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lines, "CHUNK_BYTES", 20_000)
    sizes = []
    real = lines.line_table
    monkeypatch.setattr(lines, "line_table", lambda docs, n: (sizes.extend(r["count"] for r in docs.groupBy("chunk").count().collect()), real(docs, n))[1])
    got = sorted(map(tuple, lines.drop_repeated_lines(frame).collect()), key=str)
    assert got == brute(rows)
    assert len(sizes) > 20 and max(sizes) < 1000


def test_no_documents(nothing):
    assert lines.drop_repeated_lines(nothing).collect() == []
