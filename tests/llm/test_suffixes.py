"""Repeated byte strings against brute force; suffix arrays and prefixes against sorting."""

import numpy as np
import pytest

from tallyloom.llm import suffixes


def brute(rows, length):
    key = lambda i: -(2**63) if i is None else i
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            low[b[p : p + length]] = min(key(i), low.get(b[p : p + length], key(i)))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - length + 1):
            if low[b[p : p + length]] < key(i):
                gone[p + 1 : p + 1 + length] = True
        edge = np.flatnonzero(np.diff(gone.astype(int))).tolist()
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((str(i), len(b), int(gone.sum()), list(zip(edge[::2], edge[1::2])), kept))
    return sorted(out)


def run(docs, **options):
    got = suffixes.drop_repeated_bytes(docs, **options).collect()
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], [(s["start"], s["end"]) for s in r["removed"]], bytes(r["kept"])) for r in got)


@pytest.mark.parametrize("length, hot, shard", [(50, 50_000, 5 << 19), (50, 2, 4000), (16, 3, 4000)])
def test_removal_equals_brute_force(messy, length, hot, shard):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    want = brute(rows, length)
    assert run(messy, length=length, hot=hot, shard_bytes=shard) == want
    assert sum(r[2] for r in want) > 1000


def test_periodic_texts_and_matches_that_overlap(spark):
    a = "abcdefghij" * 30
    rows = [(1, "x" * 300), (2, "y" + "x" * 120 + "z"), (3, a), (4, a[3:140] + "!" + a[:70]), (5, "x" * 49), (6, a[7:57])]
    for hot in (50_000, 1):
        assert run(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot) == brute(rows, 50)


def test_long_texts_go_in_pieces_with_the_same_result(monkeypatch):
    rng = np.random.default_rng(5)
    raw = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (5000, 30, 9000)]
    whole = suffixes.anchors(raw, 50)
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 700)
    pieces = suffixes.anchors(raw, 50)
    strings = lambda a: {(t, q, p, h) for t, q, lo, hi, h in a.itertuples(index=False) for p in range(lo, hi + 1)}
    assert strings(whole) == strings(pieces)


def test_ranges_hold_alike_many_anchors():
    rng = np.random.default_rng(9)
    a = suffixes.anchors([bytes(rng.integers(97, 123, 60_000).astype(np.uint8)) for _ in range(4)], 50)
    held = np.bincount(suffixes.range_of(a["h"].to_numpy(), 40), minlength=40)
    assert len(a) > 8000 and held.max() < 1.4 * held.mean()


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(7)
    raw = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (40, 1, 40, 7, 25)] + [b"a" * 30, b"a" * 30]
    sizes = np.array([len(x) for x in raw])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.concatenate([np.append(np.frombuffer(x, np.uint8).astype(np.uint16) + 1, 0) for x in raw])
    stop = np.repeat(starts + sizes, sizes + 1)
    sa, rank = suffixes.suffix_array(text, stop)
    suffix = [(text[i : stop[i]].tolist(), i) for i in range(len(text))]
    assert sa.tolist() == [i for _, i in sorted(suffix)]
    lcp = suffixes.common_prefixes(text, sa, starts, sizes, 12)
    for n in range(1, len(sa)):
        if text[sa[n]]:
            a, b = suffix[sa[n - 1]][0], suffix[sa[n]][0]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[n] == min(12, same)


def test_runs_merge_by_binary_search():
    a, b = np.array([b"a\1", b"c\1", b"d\1"]), np.array([b"b\1", b"c\1", b"e\1"])
    s, k = suffixes.merge_runs(a, np.array([5, 6, 7]), b, np.array([1, 2, 3]))
    assert s.tolist() == [b"a\1", b"b\1", b"c\1", b"d\1", b"e\1"] and k.tolist() == [5, 1, 2, 7, 3]


def test_no_documents(nothing, spark):
    assert suffixes.drop_repeated_bytes(nothing).collect() == []
    short = spark.createDataFrame([(1, None), (2, ""), (3, "abc")], "doc_id long, text string")
    assert [r[2] for r in run(short)] == [0, 0, 0]
    with pytest.raises(ValueError):
        suffixes.drop_repeated_bytes(nothing, length=7)
