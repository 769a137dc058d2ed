"""Benchmark passages in documents by a prefix-filtered set join.

Benchmark texts are cut into windows of consecutive words, and a document holds
a window where all its shingles follow each other there. Shingles are ordered
by how often all documents hold them. As a window has to be contained whole,
its rarest shingle alone is the necessary prefix: a document place that holds
it proposes the window's start. Proposals whose window would begin before the
text or end behind it fall by position and length; the rest are compared with
the window word by word.

Windows go in blocks of a bounded size, each read by one scan that counts
shingles and one that joins; documents are not shuffled while there is one
block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bytescan import SLICE_BYTES, Spans, SpanTable, column_bytes, pieces, runs, slices
from tallyloom.llm.common import bucket, give_back, id_and_text_columns, parts, shown_id, stored
from tallyloom.llm.words import mix

WINDOW = 10
SHINGLE = 3
#: (window, item) rows of a block; a block's words fit the 21 bits that a shingle's key has for each.
BLOCK_ROWS = 100_000
_BITS = 21
_NONE = (1 << _BITS) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def item_windows(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(window, item): the distinct windows of ``width`` words of each item; a shorter item is one window."""

    def per_batch(batches):
        for b in batches:
            found = set()
            for item, text in zip(b["item"], b["text"]):
                words = [w.decode() for w in _WORD.findall(text.encode().lower())]
                for i in range(max(1, len(words) - width + 1) if words else 0):
                    found.add((" ".join(words[i : i + width]), item))
            yield pd.DataFrame(sorted(found), columns=["window", "item"])

    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(per_batch, "window string, item string").distinct()


@dataclass
class Block:
    """Windows of a block as rows of word numbers, their items, and an index by shingle."""

    words: list[bytes]
    ids: np.ndarray  #: word numbers of each window, -1 behind its end
    length: np.ndarray
    items: list[list[str]]  #: of each window
    keys: np.ndarray = field(init=False)  #: distinct shingles, sorted
    at: np.ndarray = field(init=False)  #: number of the shingle at each place of each window, -1 behind the last
    prefix: dict[int, list[tuple[int, np.ndarray]]] = field(default_factory=dict)

    def __post_init__(self):
        n, width = self.ids.shape
        size = np.minimum(self.length, SHINGLE)
        key = np.zeros((n, width), np.uint64)
        for i in range(SHINGLE):
            shifted = np.pad(self.ids, ((0, 0), (0, i)), constant_values=-1)[:, i:]
            part = np.where((i < size)[:, None], shifted, _NONE)
            key = (key << np.uint64(_BITS)) | part.astype(np.uint64) & np.uint64(_NONE)
        held = np.arange(width) <= (self.length - size)[:, None]
        self.keys = np.unique(key[held])
        self.at = np.where(held, np.searchsorted(self.keys, key), -1)
        self.sizes = sorted({int(s) for s in size})
        self.salt = 0
        while any(len(np.unique(self._hashes(self.ids[self.length == m], m))) < (self.length == m).sum() for m in set(self.length.tolist())):
            self.salt += 1  # windows of a length have hashes of their own
        self.lookup = {}
        for m in sorted(set(self.length.tolist())):
            some = np.flatnonzero(self.length == m)
            h = self._hashes(self.ids[some], m)
            order = np.argsort(h)
            self.lookup[m] = h[order], some[order]

    def _hashes(self, ids: np.ndarray, length: int) -> np.ndarray:
        h = np.full(len(ids), self.salt, np.uint64)
        for i in range(length):
            h = mix(h ^ (ids[:, i].astype(np.uint64) + np.uint64(1)))
        return h

    def choose_prefixes(self, counts: np.ndarray) -> None:
        """Indexes each window by its rarest shingle (the leftmost of equally rare ones)."""
        rare = np.where(self.at >= 0, np.append(counts, np.iinfo(np.int64).max)[self.at], np.iinfo(np.int64).max)
        place = rare.argmin(axis=1)
        rows = np.unique(np.column_stack([self.at[np.arange(len(place)), place], self.length, place]), axis=0)
        # by shingle: the lengths of windows and the places that it has in them
        self.starts = np.searchsorted(rows[:, 0], np.arange(len(self.keys) + 1))
        self.shapes = rows[:, 1:]

    def shingles_in(self, ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, shingle number) of the block's shingles in texts of word numbers."""
        places, numbers = [], []
        for size in self.sizes:
            n = max(0, len(ids) - size + 1)
            good = ids[:n] >= 0
            for i in range(1, size):
                good &= (ids[i : n + i] >= 0) & (text[i : n + i] == text[:n])
            p = np.flatnonzero(good)
            key = np.zeros(len(p), np.uint64)
            for i in range(SHINGLE):
                part = ids[p + i].astype(np.uint64) if i < size else np.full(len(p), _NONE, np.uint64)
                key = (key << np.uint64(_BITS)) | part
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            places.append(p[hit])
            numbers.append(at[hit])
        return np.concatenate(places), np.concatenate(numbers)

    def occurrences(self, ids: np.ndarray, text: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, window) of every window in texts whose words stand at ``first`` to ``end``."""
        p, number = self.shingles_in(ids, text)
        n = self.starts[number + 1] - self.starts[number]
        row = np.repeat(np.arange(len(p)), n)
        shape = self.shapes[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.starts[number[row]]]
        length, start = shape[:, 0], p[row] - shape[:, 1]
        inside = (start >= first[text[p[row]]]) & (start + length <= end[text[p[row]]])  # by position and length
        start, length = start[inside], length[inside]
        found = []
        for m, (hashes, windows) in self.lookup.items():
            s = np.unique(start[length == m])
            if not len(s):
                continue
            own = ids[s[:, None] + np.arange(m)]
            s, own = s[(own >= 0).all(axis=1)], own[(own >= 0).all(axis=1)]
            h = self._hashes(own, m)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = (hashes[at] == h) & (self.ids[windows[at], :m] == own).all(axis=1)
            found.append(np.column_stack([s[same], np.full(same.sum(), m), windows[at[same]]]))
        out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        return out[:, 0], out[:, 1], out[:, 2]


def make_block(rows: list[tuple[str, str]]) -> Block | None:
    if not rows:
        return None
    number: dict[bytes, int] = {}
    windows: dict[str, list[str]] = {}
    for window, item in sorted(rows):
        windows.setdefault(window, []).append(item)
    split = [[number.setdefault(w, len(number)) for w in window.encode().split(b" ")] for window in windows]
    length = np.array([len(x) for x in split])
    ids = np.full((len(split), int(length.max())), -1, np.int64)
    for i, x in enumerate(split):
        ids[i, : len(x)] = x
    return Block(list(number), ids, length, list(windows.values()))


class Reader:
    """Word numbers of documents by a block's vocabulary."""

    def __init__(self, block: Block):
        size = np.array([len(w) for w in block.words], np.int64)
        end = np.cumsum(size)
        self.table = SpanTable(Spans(np.frombuffer(b"".join(block.words), np.uint8), end - size, end))

    def read(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, or -1 for other words; text) of every word of the texts between ``at``."""
        ids, text = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for lo, hi in pieces(buf, int(at[0]), int(at[-1]), ~_IN_WORD[_LOWER]):
            low = _LOWER[buf[lo:hi]]
            edges = at[(at >= lo) & (at <= hi)] - lo
            start, end = runs(_IN_WORD[low], edges)
            ids.append(self.table.find(Spans(low, start, end)).astype(np.int32))
            text.append((np.searchsorted(at, start + lo, side="right") - 1).astype(np.int32))
        return np.concatenate(ids), np.concatenate(text)


def count_shingles(docs: DataFrame, block: Block) -> np.ndarray:
    """How often all documents hold each shingle of a block."""

    def per_task(batches):
        reader, total = Reader(block), np.zeros(len(block.keys), np.int64)
        for b in batches:
            buf, at = column_bytes(b.column("text"))
            for lo, hi in slices(at):
                _, number = block.shingles_in(*reader.read(buf, at[lo : hi + 1]))
                total += np.bincount(number, minlength=len(total))
            give_back()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"no": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    rows = docs.select("text").mapInArrow(per_task, "no long, n long").groupBy("no").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(block.keys), np.int64)
    for no, n in rows:  # one row at most for each shingle of the block
        counts[no] = n
    return counts


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scan_block(docs: DataFrame, block: Block | None) -> DataFrame:
    """(key, mark, n_words, spans, items) of every document: hit word ranges and the items with a window in it."""

    def per_task(batches):
        reader = Reader(block) if block else None
        for b in batches:
            buf, at = column_bytes(b.column("text"))
            for lo, hi in slices(at):
                yield _scan_slice(block, reader, b.slice(lo, hi - lo), buf, at[lo : hi + 1])
            give_back()

    return docs.mapInArrow(per_task, "key long, mark binary, n_words long, spans array<struct<start:int,end:int>>, items array<string>")


def _scan_slice(block: Block | None, reader: Reader | None, rows: pa.RecordBatch, buf: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    n = len(at) - 1
    spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
    if block is None:
        reader = Reader(Block([b"-"], np.zeros((1, 1), np.int64), np.ones(1, np.int64), [[]]))
    ids, text = reader.read(buf, at)
    n_words = np.bincount(text, minlength=n)
    if block is not None:
        end = np.cumsum(n_words)
        first = end - n_words
        start, length, window = block.occurrences(ids, text, first, end)
        if len(start):
            steps = np.zeros(len(ids) + 1, np.int64)
            np.add.at(steps, start, 1)
            np.add.at(steps, start + length, -1)
            a, b = runs(np.cumsum(steps[:-1]) > 0, first)
            for t, x, y in zip(text[a].tolist(), (a - first[text[a]]).tolist(), (b - first[text[a]]).tolist()):
                spans[t].append({"start": x, "end": y})
            for t, w in np.unique(np.column_stack([text[start], window]), axis=0).tolist():
                items[t] += block.items[w]
            items = [sorted(set(x)) for x in items]
    return pa.RecordBatch.from_arrays(
        [rows.column("key"), rows.column("mark"), pa.array(n_words, pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))],
        names=["key", "mark", "n_words", "spans", "items"],
    )


def _joined(blocks: list[DataFrame]) -> DataFrame:
    """What several blocks found in the same documents, as one row each; repeated rows stay repeated."""
    rows = blocks[0]
    for b in blocks[1:]:
        rows = rows.union(b)
    key = ["key", "mark", "n_words"]
    per = stored(rows, "contamination-blocks")
    base = per.groupBy(*key).agg((F.count("*") / len(blocks)).cast("int").alias("copies"))
    found = per.filter(F.size("items") > 0).groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )

    def add(done, s):  # spans that touch words of the last one become one
        last = F.element_at(done, -1)
        more = (F.size(done) > 0) & (s["start"] < last["end"])
        one = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(more, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(s)))

    empty = F.array().cast("array<struct<start:int,end:int>>")
    merged = found.withColumn("spans", F.aggregate("spans", empty, add))
    both = base.join(merged, key, "left").withColumns(
        {"spans": F.coalesce("spans", empty), "items": F.coalesce("items", F.array().cast("array<string>"))}
    )
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("__copy", "copies")


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = WINDOW, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id_col, n_words, n_hit, spans, items) of every document.

    Words are runs of letters, digits and all that is not ASCII, A-Z lower-cased.
    A word inside any occurrence of a window of ``width`` item words (all words
    of a shorter item) is hit; ``spans`` are the runs of hit words, ``items``
    the sorted ids of the items whose windows occur. NULL texts have no words,
    a NULL item id is the empty string, and items with one id are one item.
    Repeated rows and NULL ids stay as they are; without items nothing is hit.
    """
    if block_rows * width >= _NONE:
        raise ValueError("a block may hold fewer words than 2**21")
    windows = stored(item_windows(items, item_col, item_text_col, width), "windows")
    n_blocks = parts(windows.count(), block_rows)
    mark = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("binary") if n_blocks > 1 else F.lit(None).cast("binary")
    texts = docs.select(*id_and_text_columns(id_col, text_col), mark.alias("mark"))
    found = []
    for i in range(n_blocks):
        block = make_block([tuple(r) for r in windows.filter(bucket(n_blocks, "window", "item") == i).collect()])  # about block_rows
        if block:
            block.choose_prefixes(count_shingles(texts, block))
        part = scan_block(texts, block)
        found.append(part if n_blocks == 1 else stored(part, "contamination"))
    rows = found[0] if n_blocks == 1 else _joined(found)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(shown_id().alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "items")
