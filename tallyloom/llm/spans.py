"""Substring dedup by sliding sentence spans.

From every sentence starts one span: the shortest run of sentences with enough
words. With ``tails``, the shortest such run that ends at a sentence is a span
too; the two kinds together cover every sentence of every run of enough words.
Spans are hashed and counted over all documents; the first occurrence of
a span is the one in the smallest id, at the smallest place. Sentences that any
other occurrence of a repeated span covers are removed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import id_and_text, shown_id
from tallyloom.llm.words import Words, batches_of, mix, range_hashes, split_words

#: A span has at least two sentences and this many words, or one sentence of LONG words.
LEAST_WORDS = 20
LONG_WORDS = 40
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence, and the end; a sentence ends at . ! ? or at a line's end."""
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = np.cumsum(w.buf == 10)
    last = _STOPS[w.buf[w.end - 1]]
    last[:-1] |= lines[w.start[1:]] != lines[w.end[:-1] - 1]  # texts end with a line end too
    last[-1] = True
    end = np.flatnonzero(last) + 1
    return np.concatenate([[0], end[:-1]]), end


def spans(w: Words, least: int = LEAST_WORDS, long: int = LONG_WORDS, tails: bool = False) -> pd.DataFrame:
    """(text, i, j, h1, h2): each span's first and last sentence, counted from the text's first, and its hashes.

    ``tails`` adds the shortest runs that end at a sentence, where no span from a first sentence is the same.
    """
    first, end = sentences(w)
    n = len(first)
    text = w.text[first]
    at = np.searchsorted(text, np.arange(len(w.at)))  # first sentence of each text
    i = np.arange(n)
    j = np.maximum(i + 1, np.searchsorted(end, first + least))
    j = np.minimum(j, np.searchsorted(end, first + long))
    whole = j < at[text + 1]
    i, j = i[whole], j[whole]
    if tails:
        b = np.arange(n)
        a = np.minimum(b - 1, np.searchsorted(first, end - least, side="right") - 1)
        a = np.maximum(a, np.searchsorted(first, end - long, side="right") - 1)
        more = a >= at[text]
        a, b = a[more], b[more]
        same = np.full(n, -1)
        same[i] = j
        new = same[a] != b
        i, j = np.append(i, a[new]), np.append(j, b[new])
    text = text[i]
    h1 = range_hashes(w.hash, first[i], end[j])
    h2 = range_hashes(mix(w.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[i], end[j])
    return pd.DataFrame({"text": text, "i": i - at[text], "j": j - at[text], "h1": h1.view(np.int64), "h2": h2.view(np.int64)})


def span_table(texts: DataFrame, least: int, long: int, tails: bool = False) -> DataFrame:
    def per_batch(batches):
        for b in batches:
            for part in batches_of(b):
                s = spans(split_words(part["text"].tolist(), lower=True), least, long, tails)
                for c in ("key", "body"):
                    s[c] = part[c].to_numpy()[s["text"]]
                yield s[["key", "body", "i", "j", "h1", "h2"]]

    return texts.mapInPandas(per_batch, "key long, body long, i int, j int, h1 long, h2 long")


def _cut(part: pd.DataFrame) -> pd.DataFrame:
    """Texts without the sentences in ``gone`` (pairs of first and last sentence)."""
    w = split_words(part["text"].tolist())
    first, end = sentences(w)
    at = np.searchsorted(w.text[first], np.arange(len(w.at)))
    out = []
    for k, (text, gone) in enumerate(zip(part["text"], part["gone"])):
        n = int(at[k + 1] - at[k])
        if gone is None or not len(gone):
            out.append((n, 0, [], text))
            continue
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, [g["i"] for g in gone], 1)
        np.add.at(edge, [g["j"] + 1 for g in gone], -1)
        drop = np.cumsum(edge[:-1]) > 0
        lo = w.start[first[at[k] : at[k + 1]]] - w.at[k]
        hi = np.append(lo[1:], w.at[k + 1] - 1 - w.at[k])
        raw, runs, kept, place = text.encode(), [], [], 0
        change = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8)))
        for a, b in zip(change[::2], change[1::2]):
            kept.append(raw[place : lo[a]])
            place = int(hi[b - 1])
            runs.append({"start": int(lo[a]), "end": place})
        kept.append(raw[place:])
        out.append((n, int(drop.sum()), runs, b"".join(kept).decode()))
    made = pd.DataFrame(out, columns=["n_sentences", "n_removed", "removed", "text"], index=part.index)
    return made.assign(key=part["key"])[["key", "n_sentences", "n_removed", "removed", "text"]]


def drop_repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, long: int = LONG_WORDS,
    tails: bool = False,
) -> DataFrame:
    """Texts without sentences that a non-first occurrence of a repeated span covers.

    With ``tails``, these are all sentences of every repeated run of enough
    words; without, the last ones of a run stay where no span from a first
    sentence reaches them. Runs are met where they fall into the same sentences.
    Words are compared without regard to A-Z case and to white space between
    them. Returns one row per input row: (id_col, n_sentences, n_removed,
    removed: byte ranges of the input, text). NULL texts are empty and lose
    nothing. Rows with the same id are one document, so a repeated row removes
    nothing from its copy; different texts of one id, as of NULL, are documents
    of their own, in the order of their hashes. A NULL id is the smallest. No
    rows in, none out.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("body", F.xxhash64("text"))  # places belong to one text of an id
    every = span_table(texts, least, long, tails)
    first = every.groupBy("h1", "h2").agg(F.min(F.struct("key", "body", "i")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = every.join(first.select("h1", "h2", "first"), ["h1", "h2"]).filter(F.struct("key", "body", "i") != F.col("first"))
    gone = again.groupBy("key", "body").agg(F.collect_set(F.struct("i", "j")).alias("gone"))

    def per_batch(batches):
        for b in batches:
            for part in batches_of(b):
                yield _cut(part)

    schema = "key long, n_sentences int, n_removed int, removed array<struct<start:long,end:long>>, text string"
    cut = texts.join(gone, ["key", "body"], "left").mapInPandas(per_batch, schema)
    return cut.select(shown_id().alias(id_col), "n_sentences", "n_removed", "removed", F.col("text").alias(text_col))
