"""Sentence spans and license scans against plain Python."""

import re

import pytest

from tallyloom.llm import licenses, spans
from tests.llm.conftest import sentence


def sentences(t):
    out, cur = [], []
    for line in t.split("\n"):
        for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", line.encode()):
            cur.append((m.group().lower(), m))
            if m.group()[-1:] in b".!?":
                out.append(cur)
                cur = []
        if cur:
            out.append(cur)
            cur = []
    return [[w for w, _ in s] for s in out]


def brute(rows, least, long):
    key = lambda i: -(2**63) if i is None else i
    first, found = {}, []
    for i, t in rows:
        s = sentences(t or "")
        for a in range(len(s)):
            n = 0
            for b in range(a, len(s)):
                n += len(s[b])
                if (n >= least and b > a) or n >= long:
                    h = b" ".join(w for x in s[a : b + 1] for w in x)
                    found.append((key(i), a, b, h))
                    first[h] = min(first.get(h, (key(i), a)), (key(i), a))
                    break
    gone = {}
    for i, a, b, h in found:
        if first[h] != (i, a):
            gone.setdefault(i, set()).update(range(a, b + 1))
    return sorted((str(i), len(sentences(t or "")), len(gone.get(key(i), ()))) for i, t in rows)


@pytest.mark.parametrize("least, long", [(20, 40), (5, 9)])
def test_removed_sentences_equal_brute_force(messy, least, long):
    # ids that stand for several texts do not occur here; repeated rows do
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    got = spans.drop_repeated_spans(messy, least=least, long=long).collect()
    assert sorted((str(r["doc_id"]), r["n_sentences"], r["n_removed"]) for r in got) == brute(rows, least, long)
    text_of = {}
    for i, t in rows:
        text_of.setdefault(i, []).append((t or "").encode())
    for r in got:
        if len(text_of[r["doc_id"]]) == 1:
            raw, at, kept = text_of[r["doc_id"]][0], 0, b""
            for s in r["removed"]:
                kept, at = kept + raw[at : s["start"]], s["end"]
            assert (kept + raw[at:]).decode() == r["text"]
    assert sum(r["n_removed"] for r in got) > 20


def test_passage_goes_from_all_but_its_first_document_and_the_rest_stays(spark):
    import random

    rng = random.Random(1)
    passage = " ".join(sentence(rng, 20) for _ in range(3))
    own = [sentence(rng, 15) + " " + sentence(rng, 15) for _ in range(6)]
    rows = [(i, f"{own[i]}\n{passage}\n{own[i + 3]}") for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in spans.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for i in (1, 2):
        assert passage not in got[i] and own[i] in got[i] and own[i + 3] in got[i]


@pytest.mark.parametrize("key", [None, 5])
def test_texts_that_share_an_id_lose_only_their_own_repeats(spark, key):
    import random

    rng = random.Random(2)
    passage = " ".join(sentence(rng, 20) for _ in range(2))
    own = [sentence(rng, 15) for _ in range(14)]
    short, long = f"{passage}\n{own[0]}", "\n".join([*own[1:13], passage, own[13]])
    rows = [(key, short), (key, long), (key, long), (9, f"{own[13]} {passage}")]
    got = spans.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted(r["text"] for r in got if r["doc_id"] == key)
    whole = [short, long, long]
    cut = [t.replace(passage, "") for t in whole]
    squeeze = lambda texts: sorted(" ".join(t.split()) for t in texts)
    assert squeeze(kept) in (squeeze([short, *cut[1:]]), squeeze([cut[0], *whole[1:]]))
    assert [" ".join(r["text"].split()) for r in got if r["doc_id"] == 9] == [own[13]]


def brute_all_runs(rows, least, long):
    key = lambda i: -(2**63) if i is None else i
    first, found = {}, []
    for i, t in rows:
        s = sentences(t or "")
        for a in range(len(s)):
            for b in range(a, len(s)):
                n = sum(map(len, s[a : b + 1]))
                if (n >= least and b > a) or n >= long:
                    h = b" ".join(w for x in s[a : b + 1] for w in x)
                    found.append((key(i), a, b, h))
                    first[h] = min(first.get(h, (key(i), a)), (key(i), a))
    gone = {}
    for i, a, b, h in found:
        if first[h] != (i, a):
            gone.setdefault(i, set()).update(range(a, b + 1))
    return sorted((str(i), len(sentences(t or "")), len(gone.get(key(i), ()))) for i, t in rows)


def test_tails_cover_every_repeated_run_to_its_last_sentence(messy, spark):
    import random

    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in messy.collect() if len(r["text"] or "") < 5000]
    for lengths in ([18, 18, 10, 5], [45, 15], [20, 20, 9, 6], [41], [5, 45, 5], [9, 9], [39], [20]):
        run = " ".join(sentence(rng, n) for n in lengths)
        for _ in range(2):  # once between other sentences and once at the end
            rows.append((200 + len(rows), f"{sentence(rng, 8)} {run} {sentence(rng, 30)}"))
            rows.append((200 + len(rows), f"{sentence(rng, 8)} {run}"))
    for k in range(60):  # few different sentences, so that runs meet and overlap in many ways
        pool = [sentence(random.Random(n), n) for n in (1, 2, 5, 8, 13, 19, 22, 41)]
        rows.append((400 + k, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for least, long in ((20, 40), (9, 9)):
        got = spans.drop_repeated_spans(frame, least=least, long=long, tails=True).collect()
        assert sorted((str(r["doc_id"]), r["n_sentences"], r["n_removed"]) for r in got) == brute_all_runs(rows, least, long)


def test_no_documents(nothing, spark):
    assert spans.drop_repeated_spans(nothing).collect() == []
    assert licenses.scan_licenses(nothing, licenses.notices(spark)).collect() == []


# --- license scans ----------------------------------------------------------------


def test_notices_are_found_where_they_stand(messy, spark):
    notice = dict(licenses.NOTICES)
    bent = notice["MIT-text"].replace("free of charge", "free of any charge").replace("obtaining", "getting")
    texts = [
        "intro words here. " + notice["MIT"] + " more words", notice["GPL-3.0"].upper(), bent + " tail", "all\nrights   reserved",
        "licensed under the something else entirely", None, "", notice["MIT"] + " x " * 50 + notice["MIT"], "é " * 9 + notice["CC-BY-NC-4.0"],
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan_licenses(docs, licenses.notices(spark)).collect()
    assert sorted((r["doc_id"], r["template"]) for r in got) == [(0, "MIT"), (1, "GPL-3.0"), (2, "MIT-text"), (3, "reserved"), (7, "MIT"), (7, "MIT"), (8, "CC-BY-NC-4.0")]
    for r in got:
        part = texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
        words = lambda t: [w.strip('.,"()').lower() for w in t.split()]
        if r["template"] != "MIT-text":
            assert words(part) == words(notice[r["template"]]) and r["coverage"] == 1
        else:
            assert part == bent and 0.9 < r["coverage"] < 1
    assert licenses.scan_licenses(messy, licenses.notices(spark)).collect() == []


def test_templates_in_several_passes_give_the_same(monkeypatch, spark):
    docs = spark.createDataFrame([(i, f"see: {t} end") for i, (_, t) in enumerate(licenses.NOTICES)], "doc_id long, text string")
    one = sorted(map(tuple, licenses.scan_licenses(docs, licenses.notices(spark)).collect()))
    monkeypatch.setattr(licenses, "PASS_BYTES", 100)
    messy_templates = licenses.notices(spark).union(licenses.notices(spark)).union(spark.createDataFrame([(None, "x"), ("none", None), ("empty", "")], "name string, text string"))
    assert sorted(map(tuple, licenses.scan_licenses(docs, messy_templates).collect())) == one and len(one) >= len(licenses.NOTICES)


def test_winnowing_leaves_no_window_without_a_fingerprint():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    at = set(licenses.winnow(h, 4).tolist())
    assert all(at & set(range(i, i + 4)) for i in range(197)) and len(at) < 200
