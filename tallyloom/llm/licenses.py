"""License scan: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates are cut into runs of words; of every few neighbouring runs the least
hash is a fingerprint, and an inverted index lists the templates and places of
each. A document looks all its runs up. Hits of a template on neighbouring
diagonals are one candidate, which is aligned with the template word by word
within a band around them.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bucket, id_and_text, parts, shown_id
from tallyloom.llm.words import Words, batches_of, range_hashes, split_words, trimmed

RUN = 3
WINDOW = 4
COVERAGE = 0.8
#: Bytes of templates that one pass over the documents carries; more templates take more passes.
PASS_BYTES = 8 << 20

#: Notices by which works state their license.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("reserved", "All rights reserved."),
]


def words_of(texts: list[str]) -> Words:
    """Words without regard to case and to punctuation at their ends."""
    return trimmed(split_words(texts, lower=True))


def _runs(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash) of every run of ``size`` words inside a text; shorter texts are one run."""
    counts = w.counts
    first = np.cumsum(counts) - counts
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(int))
    text = np.repeat(np.arange(len(counts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = first[text] + at
    return text, at, range_hashes(w.hash, start, start + np.minimum(size, counts[text]))


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: the last least hash of each window; all windows have one."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(h[::-1].argmin())]) if len(h) else np.zeros(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(seen)) + window - 1 - seen[:, ::-1].argmin(axis=1))


class Index:
    """Inverted index of template fingerprints: hash to (template, place)."""

    def __init__(self, templates: list[tuple[str, str]], run: int, window: int):
        self.names = [n for n, _ in templates]
        w = words_of([t for _, t in templates])
        self.words = np.split(w.hash, np.cumsum(w.counts)[:-1]) if templates else []
        self.run = run
        lists = defaultdict(list)
        text, at, h = _runs(w, run)
        short = {}
        for t in range(len(templates)):
            own = np.flatnonzero(text == t)
            for i in own[winnow(h[own], window)]:
                lists[int(h[i])].append((t, int(at[i])))
            if len(self.words[t]) < run and len(self.words[t]):
                short.setdefault(len(self.words[t]), True)
        self.short = sorted(short)
        self.hashes = np.array(sorted(lists), np.uint64)
        self.lists = [lists[int(x)] for x in self.hashes]

    def hits(self, w: Words):
        """(text, first word, list number) of document runs that the index holds; short templates by runs of their size."""
        for size in [self.run, *self.short]:
            text, at, h = _runs(w, size)
            if len(self.hashes):
                i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[i] == h
                yield from zip(text[hit].tolist(), at[hit].tolist(), i[hit].tolist())


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Best local alignment of template and words near diagonal ``shift``: (matches, first word, end).

    A match scores 1; a changed, missing or extra word costs 1.
    """
    none = (0, 0, 0, 0)  # score, matches, first word, end
    best, above = none, {}
    t, d = template.tolist(), words.tolist()
    for i in range(len(t)):
        row, left = {}, none
        for j in range(max(0, i + shift - band), min(len(d), i + shift + band + 1)):
            s, m, a, _ = above.get(j - 1, none)
            if t[i] == d[j]:
                cell = (s + 1, m + 1, a if s else j, j + 1)
            else:
                cell = max(none, (s - 1, m, a, j + 1), (left[0] - 1, *left[1:]), (above.get(j, none)[0] - 1, *above.get(j, none)[1:]))
                if cell[0] <= 0:
                    cell = none
            row[j] = left = cell
            best = max(best, cell, key=lambda c: (c[1], c[0], -c[2]))
        above = row
    return best[1], best[2], best[3]


def scan(index: Index, part: pd.DataFrame, coverage: float) -> pd.DataFrame:
    w = words_of(part["text"].tolist())
    counts = w.counts
    first = np.cumsum(counts) - counts
    seen = defaultdict(set)
    for text, at, number in index.hits(w):
        for t, place in index.lists[number]:
            seen[text, t].add(at - place)
    out = []
    for (text, t), shifts in seen.items():
        template, own = index.words[t], w.hash[first[text] : first[text] + counts[text]]
        band = 2 + len(template) // 8
        runs: list[list[int]] = []
        for s in sorted(shifts):
            if runs and s - runs[-1][0] <= band:
                runs[-1].append(s)
            else:
                runs.append([s])
        found = set()
        for run in runs:
            matched, lo, hi = align(template, own, run[0], 2 * band)
            if matched and matched >= coverage * len(template):
                a, b = first[text] + lo, first[text] + hi - 1
                found.add((int(w.start[a] - w.at[text]), int(w.end[b] - w.at[text]), matched / len(template)))
        out += [(part["key"].iloc[text], index.names[t], c, a, b) for a, b, c in sorted(found)]
    return pd.DataFrame(out, columns=["key", "template", "coverage", "start", "end"])


def scan_licenses(
    docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "name",
    template_col: str = "text", coverage: float = COVERAGE, run: int = RUN, window: int = WINDOW,
) -> DataFrame:
    """(id_col, template, coverage, start, end): where a document states a template.

    ``coverage`` is the share of the template's words that match in order;
    ``start`` and ``end`` are byte places of the matched words in the text. Each
    place of a text is reported. A match of ``run + window - 1`` words in a row
    is sure to be looked at. Case and punctuation around words do not count.
    NULL or empty texts and templates match nothing; repeated rows are reported
    each, repeated templates once. Templates travel with the code in passes of
    bounded size; documents are never shuffled.
    """
    own = templates.select(F.col(name_col).alias("name"), F.col(template_col).alias("text")).dropna().distinct()
    n_passes = parts(own.agg(F.sum(F.octet_length("text"))).first()[0], PASS_BYTES)
    schema = "key long, template string, coverage double, start long, end long"
    found = None
    for n in range(n_passes):
        rows = own.filter(bucket(n_passes, "name", "text") == n).collect()
        index = Index(sorted((r["name"], r["text"]) for r in rows), run, window)

        def per_batch(batches, index=index):
            for b in batches:
                for part in batches_of(b):
                    yield scan(index, part, coverage)

        one = id_and_text(docs, id_col, text_col).mapInPandas(per_batch, schema)
        found = one if found is None else found.union(one)
    return found.select(shown_id().alias(id_col), "template", "coverage", "start", "end")


def notices(spark) -> DataFrame:
    return spark.createDataFrame(NOTICES, "name string, text string")
