"""Audit of text filters in every order: what each removes, what others had removed before.

A table-driven transducer reads each text once as UTF-8 bytes. Its states say
whether a word is open and how many bytes of a code point are still due; its
outputs mark the starts of words and code points, capitals and symbols. The
marked word spans go into a hash table that compares bytes, which counts
distinct words. Filters then need a few bits per document, so all orders of
them follow from one small table of counts per part.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bytescan import SLICE_BYTES, Spans, SpanTable, column_bytes, slices
from tallyloom.llm.common import NULL_ID, give_back, stored

FILTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
SYMBOLS = b"#$%&*|"

# Byte classes, and states: no word is open; one is; one is, with 1, 2 or 3 bytes of a code point due.
WHITE, CAPITAL, SYMBOL, OTHER, TAIL, LEAD_2, LEAD_3, LEAD_4 = range(8)
BETWEEN, WORD, DUE_1, DUE_2, DUE_3 = range(5)
# Outputs of a step.
STARTS, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8
_OPEN = 255  # a state that depends on the one before


def _class_table() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    t[[9, 10, 11, 12, 13, 32]] = WHITE
    t[65:91] = CAPITAL
    t[list(SYMBOLS)] = SYMBOL
    t[0x80:0xC0], t[0xC0:0xE0], t[0xE0:0xF0], t[0xF0:] = TAIL, LEAD_2, LEAD_3, LEAD_4
    return t


def _step_tables() -> tuple[np.ndarray, np.ndarray]:
    after, out = np.full((5, 8), WORD, np.uint8), np.zeros((5, 8), np.uint8)
    after[:, WHITE], after[:, LEAD_2], after[:, LEAD_3], after[:, LEAD_4] = BETWEEN, DUE_1, DUE_2, DUE_3
    after[DUE_2, TAIL], after[DUE_3, TAIL] = DUE_1, DUE_2
    out[BETWEEN] |= STARTS
    out[:, WHITE] = 0
    out |= POINT
    out[:, TAIL] &= ~np.uint8(POINT)
    out[:, CAPITAL] |= IS_CAPITAL
    out[:, SYMBOL] |= IS_SYMBOL
    return after, out


CLASS = _class_table()
NEXT, OUTPUT = _step_tables()
_ALONE = np.where((NEXT == NEXT[0]).all(axis=0), NEXT[0], _OPEN).astype(np.uint8)  # states that the byte alone decides


def transduce(buf: np.ndarray, heads: np.ndarray, state: int = BETWEEN) -> tuple[np.ndarray, np.ndarray]:
    """States after each byte and outputs; the state is reset at ``heads``, where texts start."""
    kind = CLASS[buf]
    after = _ALONE[kind]
    due = np.flatnonzero(after == _OPEN)
    steps = np.vstack([NEXT, np.full((_OPEN - len(NEXT) + 1, 8), _OPEN, np.uint8)])[:, TAIL]
    for _ in range(3):  # a code point has three bytes after the first at most
        after[due] = steps[np.where(due > 0, after[due - 1], state)]
    after[after == _OPEN] = WORD  # bytes that are no UTF-8
    before = np.append(np.uint8(state), after[:-1])[: len(buf)]
    before[heads] = BETWEEN
    return after, OUTPUT.ravel()[before * np.uint8(8) + kind]


def _word_ends(after: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Places behind words: an open word ends before white space or at a text's end."""
    open_ = after != BETWEEN
    edge = np.zeros(len(after) + 1, bool)
    edge[edges] = True
    return np.flatnonzero(open_ & (edge[1:] | ~np.append(open_[1:], False))) + 1


def counts(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: words, distinct words, capitals, code points, symbols. ``at`` are the texts' edges in ``buf``."""
    n = len(at) - 1
    if n == 1 and at[1] - at[0] > SLICE_BYTES:
        return _counts_in_pieces(buf[at[0] : at[1]])
    base, at = at[0], at - at[0]
    buf = buf[base : base + at[-1]]
    heads = at[:-1][at[1:] > at[:-1]]
    after, out = transduce(buf, heads)
    start, end = np.flatnonzero(out & STARTS), _word_ends(after, at)
    text = np.searchsorted(at, start, side="right") - 1
    owner = SpanTable(Spans(buf, start, end, text)).owner
    per = lambda bit: np.diff(np.searchsorted(np.flatnonzero(out & bit), at))
    return np.column_stack([
        np.bincount(text, minlength=n), np.bincount(text[owner == np.arange(len(owner))], minlength=n),
        per(IS_CAPITAL), per(POINT), per(IS_SYMBOL),
    ])


def _counts_in_pieces(buf: np.ndarray) -> np.ndarray:
    """The same of one long text, piece by piece with the state carried; memory follows the distinct words."""
    total, words, state, open_at = np.zeros(5, np.int64), set(), BETWEEN, 0
    for lo in range(0, len(buf), SLICE_BYTES):
        piece = buf[lo : lo + SLICE_BYTES]
        after, out = transduce(piece, np.zeros(0, np.int64), state)
        start = np.flatnonzero(out & STARTS)
        end = _word_ends(after, np.zeros(0, np.int64))
        last = lo + len(piece) == len(buf)
        if state != BETWEEN and not (len(after) and after[0] != BETWEEN):
            words.add(buf[open_at:lo].tobytes())  # it ended with the piece before
        elif state != BETWEEN:
            ends_here = end[0] < len(piece) or last
            if ends_here:
                words.add(buf[open_at : lo + end[0]].tobytes())
            end = end[1:]
        if len(end) and end[-1] == len(piece) and not last:
            open_at, whole = lo + int(start[-1]), (start[:-1], end[:-1])
        else:
            whole = start, end
        spans = Spans(piece, *whole)
        owner = SpanTable(spans).owner
        words.update(spans.bytes(i) for i in np.flatnonzero(owner == np.arange(len(owner))).tolist())
        total += [len(start), 0, *(np.count_nonzero(out & bit) for bit in (IS_CAPITAL, POINT, IS_SYMBOL))]
        state = int(after[-1])
    total[1] = len(words)
    return total[None, :]


# --- operators --------------------------------------------------------------------


def text_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(key, part, h1, h2, n_words, n_distinct, n_capitals, n_points, n_symbols) of every whole text.

    NULL texts are empty, NULL parts the empty string, a NULL id the smallest
    id. h1 and h2 are 128 bits of the text's SHA-256.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    names = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]

    def per_batch(batches):
        for b in batches:
            buf, at = column_bytes(b.column("text"))
            found = [counts(buf, at[lo : hi + 1]) for lo, hi in slices(at)] or [np.zeros((0, 5), np.int64)]
            marks = [hashlib.sha256(buf[x:y]).digest()[:16] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            marks = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
            columns = [*np.ascontiguousarray(marks.T), *np.ascontiguousarray(np.concatenate(found).T)]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("part"), *[pa.array(c, pa.int64()) for c in columns]], names=["key", "part", "h1", "h2", *names]
            )
            give_back()

    return rows.mapInArrow(per_batch, "key long, part string, h1 long, h2 long, " + ", ".join(f"{c} long" for c in names))


def failed_filters(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", min_words: int = MIN_WORDS,
    distinct_percent: int = DISTINCT_PERCENT, capital_percent: int = CAPITAL_PERCENT,
) -> DataFrame:
    """(key, part, fails): bit i of ``fails`` is set where the text fails the filter i of ABCDE.

    A: fewer than ``min_words`` words; B: less than ``distinct_percent`` % of
    them distinct; C: over ``capital_percent`` % of the code points are A-Z; D:
    a symbol; E: the text of a smaller id, removed or not. Rows with the same
    id are no copies of each other.
    """
    bits = [
        F.col("n_words") < min_words, 100 * F.col("n_distinct") < distinct_percent * F.col("n_words"),
        100 * F.col("n_capitals") > capital_percent * F.col("n_points"), F.col("n_symbols") > 0,
    ]
    fails = sum((F.when(b, F.lit(1 << i)).otherwise(F.lit(0)) for i, b in enumerate(bits[1:], 1)), F.when(bits[0], F.lit(1)).otherwise(F.lit(0)))
    facts = stored(text_facts(docs, id_col, text_col, part_col).select("key", "part", "h1", "h2", fails.alias("fails")), "audit-facts")
    # a text that very many documents share is one row here; the join can split its documents
    firsts = facts.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last")
    both = facts.join(stored(firsts.select("h1", "h2", "first"), "audit-copies"), ["h1", "h2"], "left")
    copy = F.when(F.col("key") > F.col("first"), F.lit(16)).otherwise(F.lit(0))
    return both.select("key", "part", (F.col("fails") + copy).alias("fails"))


def _effects() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """For each order and step, the weight of each kind of document (32 sets of failed filters) in each count."""
    rows = [("".join(o), step) for o in itertools.permutations(FILTERS) for step in range(1, len(FILTERS) + 1)]
    kinds = np.arange(32)
    own = np.array([1 << FILTERS.index(o[s - 1]) for o, s in rows])[:, None]
    before = np.array([sum(1 << FILTERS.index(x) for x in o[: s - 1]) for o, s in rows])[:, None]
    fails, gone = (kinds & own) > 0, (kinds & before) > 0
    removed = fails & ~gone
    worth = np.array([removed[own[:, 0] == f].sum(axis=0) for f in own[:, 0]])
    return rows, {
        "kept": ~fails & ~gone, "removed": removed, "redundant": fails & gone, "unique_fails": np.broadcast_to(kinds == own, removed.shape),
        "shapley": worth,
    }


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    good_col: str = "quality", toxic_col: str = "toxic", **limits: int,
) -> DataFrame:
    """What five filters remove, in all 120 orders, per part: one row per part, filter_order and step.

    kept, removed, redundant (failing, but removed earlier), unique_fails
    (failing nothing else), good_lost and toxic_lost (removed here, labelled 1)
    and shapley (removed by the step's filter, summed over all orders). An id
    counts as good or toxic where any of its labels is 1; NULL ids and labels
    count as none. Without documents there are no rows.
    """
    failed = failed_filters(docs, id_col, text_col, part_col, **limits)
    is_one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    marks = labels.select(F.col(id_col).cast("long").alias("key"), F.col(good_col).alias("__g"), F.col(toxic_col).alias("__t")).dropna(subset=["key"])
    marks = stored(marks.groupBy("key").agg(is_one("__g").alias("good"), is_one("__t").alias("toxic")), "audit-labels")
    cell = F.col("fails") * 4 + F.coalesce("good", F.lit(0)) * 2 + F.coalesce("toxic", F.lit(0))
    cells = failed.join(marks, "key", "left").groupBy("part", cell.alias("cell")).agg(F.count("*").alias("n"))
    per_part = cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # 128 at most
    rows, effects = _effects()

    def per_batch(batches):
        for b in batches:
            for part, held in zip(b.column("part").to_pylist(), b.column("cells").to_pylist()):
                n = np.zeros((32, 2, 2), np.int64)
                for x in held:
                    n[x["cell"] >> 2, x["cell"] >> 1 & 1, x["cell"] & 1] = x["n"]
                out = {k: w.astype(np.int64) @ n.sum(axis=(1, 2)) for k, w in effects.items()}
                lost = effects["removed"].astype(np.int64)
                out |= {"good_lost": lost @ n[:, 1].sum(axis=1), "toxic_lost": lost @ n[:, :, 1].sum(axis=1)}
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(rows), pa.string()), "filter_order": [o for o, _ in rows],
                    "step": pa.array([s for _, s in rows], pa.int32()), **{k: out[k] for k in _COUNTS},
                })

    return per_part.mapInArrow(per_batch, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
