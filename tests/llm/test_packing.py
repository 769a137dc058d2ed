"""Packing and token ids: exact round trips, valid sequences, few of them."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
HF = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab's tredvlmDé 1²,.!’\n\t\r 中<|ß"), max_size=40), max_size=6))
def test_ids_are_those_of_the_library(texts):
    assert [x.tolist() for x in tokens.encode(texts, PATH)] == [HF.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_any_text_and_of_special_strings():
    texts = ["<|endoftext|>", "a<|endoftext|> b", "日本語 text", "", "x" * 5000, "\n\n  \n x", "don't we'll"]
    assert [x.tolist() for x in tokens.encode(texts, PATH)] == [HF.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_batch_of_texts_takes_little_memory():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(30_000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1_000)]
    next(iter(tokens.encode(["warm"], PATH)))
    tracemalloc.start()
    n = sum(len(x) for x in tokens.encode(texts, PATH))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 800_000 and most < 100e6


def check(rows, docs, size):
    want = {}
    for i, t in docs:
        ids = [*HF.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) % size or size
        edges = [0, *range(head, len(ids) + 1, size)]
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            want.setdefault((i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())), []).append(ids[a:b])
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]), []).append(list(r["ids"]))
    assert got == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return len(by), -(-sum(r["length"] for r in rows) // size)


@pytest.mark.parametrize("shard, islands", [(8192, 2), (20, 3)])
def test_pieces_give_the_ids_back_and_sequences_are_gapless(messy, monkeypatch, shard, islands):
    monkeypatch.setattr(packing, "SHARD_PIECES", shard)
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    rows = packing.pack_documents(messy, PATH, size=256, islands=islands, with_ids=True).collect()
    n, least = check(rows, docs, 256)
    assert n <= least + 5 + len(rows) // shard  # a shard may leave one sequence open


def test_search_comes_near_the_bound_and_beats_a_poor_start():
    rng = random.Random(2)
    sizes = sorted((rng.randint(200, 700) for _ in range(400)), reverse=True)
    plain = packing._packed(sizes, 1024, [], range(400))
    best = packing.evolve(sizes, 1024, random.Random(1), [], generations=60, population=8)
    assert sorted(i for b in best for i in b) == list(range(400))
    assert all(sum(sizes[i] for i in b) <= 1024 for b in best) and len(best) <= len(plain)
    child = packing._cross(sizes, 1024, plain, best, random.Random(3))
    assert sorted(i for b in child for i in b) == list(range(400)) and all(sum(sizes[i] for i in b) <= 1024 for b in child)


def test_no_documents_and_no_text(spark, nothing):
    assert packing.pack_documents(nothing, PATH).collect() == []
    rows = packing.pack_documents(spark.createDataFrame([(1, None), (1, None), (2, "")], "doc_id long, text string"), PATH).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == [(1, 1), (1, 1), (2, 1)] and len({r["sequence_id"] for r in rows}) == 1
