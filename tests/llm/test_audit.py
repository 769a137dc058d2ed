"""The filter audit against plain Python, and its transducer and hash table on their own."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import pyarrow as pa

from tallyloom.llm import audit
from tallyloom.llm.bytescan import Spans, SpanTable, column_bytes, pieces, slices

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)]


def brute(rows, labels):
    """Every order, document by document."""
    key = lambda i: -(2**63) if i is None else i
    least = {}
    for i, text, _ in rows:
        least[text or ""] = min(key(i), least.get(text or "", 2**63))
    good = {i for i, g, _ in labels if g == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failing = []
    for i, text, part in rows:
        w, d, cap, points, symbols = plain(text or "")
        failing.append({f for f, x in zip("ABCDE", (w < 50, 100 * d < 65 * w, 100 * cap > 5 * points, symbols > 0, key(i) > least[text or ""])) if x})
    out, worth = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for step, f in enumerate(order, 1):
            for (i, _, part), fails in zip(rows, failing):
                c = out.setdefault((part or "", order, step), Counter())
                gone, here = bool(fails & set(order[: step - 1])), f in fails
                c["kept"] += not gone and not here
                c["removed"] += here and not gone
                c["redundant"] += here and gone
                c["unique_fails"] += fails == {f}
                c["good_lost"] += here and not gone and i in good
                c["toxic_lost"] += here and not gone and i in toxic
                worth[part or "", f] += here and not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, s, *(c[n] for n in names), worth[p, o[s - 1]]) for (p, o, s), c in out.items()}


def test_audit_equals_brute_force(spark, messy):
    rng = random.Random(2)
    words = ["ab", "Cd", "é" * 20, "x$", "long" * 12, "long" * 11 + "lone", "q"]
    extra = [(900 + i, " ".join(rng.choice(words[: 2 + i % 6]) + str(rng.randrange(9)) for _ in range(rng.randrange(40, 90))), "en", "a") for i in range(20)]
    docs = messy.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string"))
    docs = docs.withColumns({c: docs["lang"] for c in ("key", "part", "h1", "fails", "first", "good")})
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(4, 0, 0), (None, 1, 1), (901, 1, None), (903, None, 1)]
    labels = [(i, g, None if t is None else int(t)) for i, g, t in labels]
    got = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], labels)
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 600 * 4
    assert sum(r["unique_fails"] for r in got) and sum(r["good_lost"] for r in got)


@pytest.mark.parametrize("size", [7, 64, 4 << 20])
def test_counts_of_texts_cut_anywhere(monkeypatch, size):
    monkeypatch.setattr(audit, "SLICE_BYTES", size)
    rng = random.Random(4)
    texts = ["", " ", "a", "É", "\n\n", "𝒳é ß\tAB$", *("".join(rng.choice("aB é𝒳ß\t\n#z  ") for _ in range(rng.randrange(300))) for _ in range(30))]
    buf, at = column_bytes(pa.array(["skip", *texts])[1:])
    got = np.concatenate([audit.counts(buf, at[lo : hi + 1]) for lo, hi in slices(at, size)])
    assert got.tolist() == [plain(x) for x in texts]
    assert audit.counts(buf, at[:1]).shape == (0, 5)


def test_hash_table_compares_bytes(monkeypatch):
    monkeypatch.setattr("tallyloom.llm.bytescan.mix", lambda z: z & np.uint64(3) << np.uint64(62))  # nearly all hashes are equal
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 7, 8, 9, 31, 32, 33, 70]))) for _ in range(300)]
    words += [w[:-1] + "c" for w in words[:80]] + words[:50]
    buf = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    spans = Spans(buf, end - [len(w) for w in words], end)
    table = SpanTable(spans)
    assert table.owner.tolist() == [words.index(w) for w in words]
    assert table.find(spans).tolist() == table.owner.tolist()
    other = Spans(np.frombuffer(b"abzzzabab", np.uint8), np.array([0, 2, 5]), np.array([2, 5, 9]))
    assert table.find(other).tolist() == [words.index(w) if w in words else -1 for w in ("ab", "zzz", "abab")]


def test_pieces_cover_everything_and_end_where_they_may():
    rng = random.Random(3)
    may = np.zeros(256, bool)
    may[32] = True
    for _ in range(50):
        raw = np.frombuffer("".join(rng.choice("aaaaaa ") for _ in range(200)).encode(), np.uint8)
        found = list(pieces(raw, 0, 200, may, 10))
        assert [a for a, _ in found] == [0, *(b for _, b in found[:-1])] and found[-1][1] == 200
        assert all(raw[b - 1] == 32 for _, b in found[:-1])
        assert all(b <= 90 for _, b in pieces(raw, 0, 90, may, 10))


def test_no_documents(spark, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(nothing, none).collect() == []
    one = audit.filter_audit(spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string"), none).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and all(r["removed"] == (r["filter_order"][r["step"] - 1] == "A") for r in one)
