"""Token ids of whole texts by a public byte-level BPE vocabulary, a batch at a time.

A batch is cut into words as the vocabulary's pre-tokeniser cuts it, each
distinct word is encoded once, and its ids are copied to every place where it
stands. Texts with letters outside the blocks listed below, whose Unicode
classes are not the same in all libraries, go through `tokenizers` as they are.
"""

from __future__ import annotations

import functools
import json
from array import array

import numpy as np

#: Code points below this, and general punctuation, have the same class everywhere.
PLAIN_BELOW = 0x0530
PUNCTUATION = (0x2000, 0x2070)
#: The pre-tokeniser's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 200_000
BATCH_CHARS = 500_000
WHITE, LETTER, NUMBER, OTHER, RARE = range(5)


@functools.cache
def _classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, RARE, np.uint8)
    for c in [*range(PLAIN_BELOW), *range(*PUNCTUATION)]:
        s = chr(c)
        table[c] = WHITE if regex.match(r"\s", s) else LETTER if regex.match(r"\p{L}", s) else NUMBER if regex.match(r"\p{N}", s) else OTHER
    return table


@functools.cache
def _reference(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _encoder(path: str):
    """The same vocabulary for single words; special strings are left to `tokenizers`."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    # byte-level vocabularies write bytes that do not print as code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in special}
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sorted(special)


@functools.cache
def _cache(path: str) -> dict[str, bytes]:
    """Ids of words as bytes of 32-bit numbers, a third of what lists of them hold."""
    return {}


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pre-tokeniser's words start; ``first`` marks the start of each text."""
    kind = _classes()[points]
    n = len(points)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    white = (kind[runs] == WHITE) & (ends < n)
    white &= ~first[np.minimum(ends, n - 1)]  # white space that something follows
    s, e = runs[white], ends[white]
    start[e[e - s > 1] - 1] = True  # its last character stands alone or leads the next word
    start[e[points[e - 1] == 32]] = False
    quote = np.flatnonzero(start & (points == 39))
    quote = quote[quote + 1 < n]
    after = lambda i: np.where((quote + i < n), points[np.minimum(quote + i, n - 1)], 0)
    same = lambda i: (quote + i < n) & ~first[np.minimum(quote + i, n - 1)]
    a, b = after(1), after(2)
    one = same(1) & np.isin(a, [ord(c) for c in "stmd"])
    two = same(1) & same(2) & np.logical_or.reduce([(a == ord(x)) & (b == ord(y)) for x, y in ("re", "ve", "ll")])
    for hit, size in ((one, 2), (two, 3)):
        p = quote[hit]
        start[p + 1] = False
        nxt = p + size
        nxt = nxt[nxt < n]
        start[nxt[kind[nxt] == LETTER]] = True
    return start


def _encode_plain(texts: list[str], path: str) -> list[np.ndarray]:
    joined = "".join(texts)
    if not joined:
        return [np.zeros(0, np.uint32)] * len(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in texts])
    first = np.zeros(len(points), bool)
    at = np.cumsum(sizes) - sizes
    first[at[sizes > 0]] = True
    starts = np.flatnonzero(word_starts(points, first))
    ends = np.append(starts[1:], len(points))
    # distinct words by a running hash, then checked against their first copy
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(points) + 1, 0x9E3779B97F4A7C15 | 1, np.uint64))
        run = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(77)) * power[:-1])])
        mark = (run[ends] - run[starts]) * power[::-1][starts]
    _, rep, inv = np.unique(mark, return_index=True, return_inverse=True)
    width = ends - starts
    offset = np.arange(len(points)) - np.repeat(starts, width)
    other = np.repeat(starts[rep][inv], width) + offset
    if not (np.array_equal(width, width[rep][inv]) and np.array_equal(points, points[other])):
        encoder = _encoder(path)[0]
        return [np.array(encoder.encode_ordinary(t), np.uint32) for t in texts]
    cache, encoder = _cache(path), _encoder(path)[0]
    if len(cache) > CACHE_WORDS:
        cache.clear()
    words = []
    for s, e in zip(starts[rep].tolist(), ends[rep].tolist()):
        w = joined[s:e]
        ids = cache.get(w)
        if ids is None:
            ids = cache[w] = array("I", encoder.encode_ordinary(w)).tobytes()
        words.append(ids)
    lens = np.array([len(w) for w in words], np.int64) >> 2
    flat = np.frombuffer(b"".join(words), np.uint32)
    base = np.cumsum(lens) - lens
    count = lens[inv]
    total = np.cumsum(count)
    ids = flat[np.repeat(base[inv] - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
    edge = np.searchsorted(starts, at)  # first word of each text
    bounds = np.append(0, total)[np.append(edge, len(starts))]
    return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def encode(texts: list[str], path: str):
    """Token ids (uint32 arrays) of each text, special tokens not added."""
    rare, (_, special) = _classes(), _encoder(path)
    batch, size = [], 0
    for t in texts:
        plain = t.isascii() or not (rare[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")] == RARE).any()
        if not plain or any(s in t for s in special):
            yield from _encode_plain(batch, path)
            batch, size = [], 0
            yield np.array(_reference(path).encode(t, add_special_tokens=False).ids, np.uint32)
            continue
        batch.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield from _encode_plain(batch, path)
            batch, size = [], 0
    yield from _encode_plain(batch, path)
