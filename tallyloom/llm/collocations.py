"""Phrase collocations by direct-address tiling.

Words get ids by frequency in their language. A pair of neighbours is a cell of
a square of (left id, right id), which is cut into tiles of about equal mass: a
tile of frequent ids has few cells and is counted in place with bincount, a
tile of rare ids has many and is counted as sorted coordinates. Frequent pairs
get ids by frequency in turn and become the left side of the next square, and
so on to the longest phrase; a phrase is only counted where its first and last
parts are frequent.

Texts are read once. A chunk of text keeps its words as numbers in the shared
folder; it sends the distinct pairs of each tile with their counts, and gets
back those that are frequent in the whole table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import bounded_broadcast
from tallyloom.llm.bytescan import Spans, SpanTable, column_bytes, from_planes, pieces, planes, runs, slices
from tallyloom.llm.common import give_back, stored
from tallyloom.llm.words import mix

LEAST = 100
LONGEST = 5
TOP = 2_000
CHUNK_BYTES = 6 << 20
#: Pairs that a tile should hold, and cells up to which it is counted in place.
TILE_PAIRS = 1 << 20
DENSE_CELLS = 1 << 18
#: The square of a language is cut into at least this many ranges a side.
LEAST_RANGES = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\v\f\r"]] = True
_IN_WORD = ~_BREAK
_IN_WORD[[9, 32]] = False


# --- words ------------------------------------------------------------------------


def coded_words(buf: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of the texts between ``at``, their counts, and the texts as word numbers, -1 between pieces."""
    low = _LOWER[buf[at[0] : at[-1]]]
    edges = at - at[0]
    start, end = runs(_IN_WORD[low], edges)
    if not len(start):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = Spans(low, start, end)
    owner = SpanTable(spans).owner
    first = np.flatnonzero(owner == np.arange(len(owner)))
    number = np.searchsorted(first, owner)
    # pieces end at breaks and at the ends of texts
    breaks = np.append(0, np.cumsum(_BREAK[low]))
    text = np.searchsorted(edges, start, side="right")
    new = np.append(False, (breaks[start[1:]] != breaks[start[:-1]]) | (text[1:] != text[:-1]))
    codes = np.full(len(start) + int(new.sum()), -1, np.int64)
    codes[np.arange(len(start)) + np.cumsum(new)] = number
    words = [low[a:b].tobytes().decode() for a, b in zip(start[first].tolist(), end[first].tolist())]
    return words, np.bincount(number, minlength=len(first)), codes


def coded_chunks(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(chunk, lang, words, counts, codes): texts of one language as numbers of the chunk's own words.

    A long text is cut between pieces, so no phrase is lost; a piece stays whole.
    """
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).filter("text <> ''")

    def per_task(batches):
        made = TaskContext.get().partitionId() << 32
        for b in batches:
            langs = b.column("lang")
            for lang in pc.unique(langs):
                buf, at = column_bytes(b.column("text").filter(pc.equal(langs, lang)))
                for lo, hi in slices(at, CHUNK_BYTES):
                    for x, y in pieces(buf, int(at[lo]), int(at[hi]), _BREAK, CHUNK_BYTES) if hi == lo + 1 else [(int(at[lo]), int(at[hi]))]:
                        edges = at[lo : hi + 1] if hi > lo + 1 else np.array([x, y])
                        words, counts, codes = coded_words(buf, edges)
                        if not words:
                            continue
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([made]), pa.array([lang.as_py()]), pa.array([words]), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([planes(codes + 1)])],
                            names=["chunk", "lang", "words", "counts", "codes"],
                        )
                        made += 1
            give_back()

    return rows.mapInArrow(per_task, "chunk long, lang string, words array<string>, counts array<long>, codes binary")


def ranked(rows: DataFrame, order: list, tag: str) -> DataFrame:
    """The rows with ``id``: their place from 0 in their language, by sorted partitions."""
    sorted_ = stored(rows.orderBy("lang", *order).withColumn("__at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("__at", 33).alias("__part")
    sizes = sorted_.groupBy("lang", part).agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    before = Window.partitionBy("lang").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    both = sorted_.withColumn("__part", F.shiftright("__at", 33)).join(sizes, ["lang", "__part"])
    return stored(both.withColumn("id", (F.col("__at") - F.col("__low") + F.col("__before")).cast("int")).drop("__at", "__part", "__low", "__n", "__before"), tag)


# --- tiles ------------------------------------------------------------------------


def cut_ids(units: DataFrame, ranges: dict[str, int]) -> dict[str, np.ndarray]:
    """Per language, the first ids of ranges of about equal mass; ids are by falling frequency.

    Frequencies go to the driver in steps of 3 %, a few hundred for a language.
    """
    step = F.floor(F.log(F.col("f").cast("double")) * 32).alias("step")
    rows = units.filter(F.col("lang").isin(list(ranges))).groupBy("lang", step).agg(F.count("*").alias("n"), F.sum("f").alias("mass")).collect()
    cuts = {}
    for lang, n in ranges.items():
        own = sorted(((r["step"], r["n"], r["mass"]) for r in rows if r["lang"] == lang), reverse=True)
        ids, mass = (np.append(0, np.cumsum([float(x[i]) for x in own])) for i in (1, 2))
        at = np.interp(np.arange(1, n) * mass[-1] / n, mass, ids)
        cuts[lang] = np.unique(np.append(0, np.ceil(at).astype(np.int64)))
    return cuts


class Tiling:
    """How the square of each language is cut: tile numbers of pairs, and whether a tile is counted in place."""

    def __init__(self, left: dict[str, np.ndarray], right: dict[str, np.ndarray], n_left: dict[str, int], n_right: dict[str, int]):
        self.left, self.right, self.n_left, self.n_right = left, right, n_left, n_right
        self.deals: dict[tuple[str, int], int] = {}

    def tiles(self, lang: str, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        if lang not in self.left:
            return np.zeros(len(u), np.int64)
        wide = len(self.right[lang])
        row = np.searchsorted(self.left[lang], u, side="right") - 1
        return row * wide + np.searchsorted(self.right[lang], v, side="right") - 1

    def area(self, lang: str, tile: int) -> tuple[int, int, int, int] | None:
        """(first left id, first right id, height, width) of a tile that is counted in place, else None."""
        if lang not in self.left:
            return None
        wide = len(self.right[lang])
        rows, columns = np.append(self.left[lang], self.n_left[lang]), np.append(self.right[lang], self.n_right[lang])
        i, j = divmod(tile, wide)
        high, broad = int(rows[i + 1] - rows[i]), int(columns[j + 1] - columns[j])
        return (int(rows[i]), int(columns[j]), high, broad) if high * broad <= DENSE_CELLS else None

    def count(self, lang: str, tile: int, key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (left << 32 | right) of a tile in order, and how often they occur."""
        area = self.area(lang, tile)
        if area is not None and len(key) * 4 >= area[2] * area[3]:
            u0, v0, high, broad = area
            cell = ((key >> 32) - u0) * broad + (key & 0xFFFFFFFF) - v0
            n = np.bincount(cell, weight, high * broad)
            some = np.flatnonzero(n)
            return ((some // broad + u0) << 32) | (some % broad + v0), n[some].astype(np.int64)
        if weight is None:
            return np.unique(key, return_counts=True)
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        return key[head], np.add.reduceat(weight, head) if len(head) else weight


def pairs_of(place: np.ndarray, unit: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, key): units that the next place continues, and unit << 32 | last word of the unit at the next place."""
    which = np.flatnonzero(place[1:] == place[:-1] + 1)
    return which, (unit[which].astype(np.int64) << 32) | last[which + 1]


def pair_bytes(key: np.ndarray) -> bytes:
    """Pairs in order as steps of the left ids and as right ids, by byte planes, which compress better than the pairs."""
    return planes(np.diff(key >> 32, prepend=0)) + planes(key & 0xFFFFFFFF)


def from_pair_bytes(b: bytes) -> np.ndarray:
    half = len(b) // 2
    return (np.cumsum(from_planes(b[:half])) << 32) | from_planes(b[half:])


def _state_row(b: pa.RecordBatch, i: int) -> tuple:
    chunk, lang, steps, unit, last = (b.column(c)[i].as_py() for c in ("chunk", "lang", "steps", "units", "lasts"))
    unit = from_planes(unit, np.int32)
    return chunk, lang, np.cumsum(from_planes(steps, np.int32), dtype=np.int32), unit, unit if last is None else from_planes(last, np.int32)


def _state_rows(b: pa.RecordBatch):
    for i in range(b.num_rows):  # one chunk at a time, not held here; a batch holds all chunks of a task
        yield _state_row(b, i)


def _state(chunk: int, lang: str, place: np.ndarray, unit: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    own = None if last is unit else planes(last)  # a word is its own last word
    columns = [pa.array([x], pa.binary()) for x in (planes(np.diff(place, prepend=0)), planes(unit), own)]
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([lang]), *columns], names=["chunk", "lang", "steps", "units", "lasts"])


STATE = "chunk long, lang string, steps binary, units binary, lasts binary"


def tile_sizes(state: DataFrame, tiling: Tiling) -> DataFrame:
    """(lang, tile, n): pairs of each tile."""

    def per_batch(batches):
        for b in batches:
            for _, lang, place, unit, last in _state_rows(b):
                _, key = pairs_of(place, unit, last)
                tile, n = np.unique(tiling.tiles(lang, key >> 32, key & 0xFFFFFFFF), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(tile), pa.string()), "tile": pa.array(tile, pa.int64()), "n": pa.array(n, pa.int64())})

    return state.mapInArrow(per_batch, "lang string, tile long, n long").groupBy("lang", "tile").agg(F.sum("n").alias("n"))


def frequent_pairs(state: DataFrame, tiling: Tiling, least: int) -> DataFrame:
    """(lang, tile, deal, chunk, keys, counts): frequent pairs with totals (chunk NULL), and those of each chunk.

    A tile with more pairs than planned for is dealt over several tasks by hash.
    """

    def per_batch(batches):
        for b in batches:
            for chunk, lang, place, unit, last in _state_rows(b):
                _, key = pairs_of(place, unit, last)
                del place, unit, last
                tile = tiling.tiles(lang, key >> 32, key & 0xFFFFFFFF)
                tile = tile.astype(np.min_scalar_type(tile.max(initial=0)))
                order = np.argsort(tile, kind="stable")
                tile, key = tile[order], key[order]
                del order
                head = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))[: len(tile)]
                out = []
                for x, y in zip(head.tolist(), [*head[1:].tolist(), len(tile)]):
                    own, n = tiling.count(lang, int(tile[x]), key[x:y])
                    deals = tiling.deals.get((lang, int(tile[x])), 1)
                    deal = (mix(own.astype(np.uint64)) % np.uint64(deals)).astype(np.int64)
                    for d in range(deals):
                        some = deal == d if deals > 1 else slice(None)
                        out.append((lang, int(tile[x]), d, chunk, pair_bytes(own[some]), planes(n[some])))
                if out:
                    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["lang", "tile", "deal", "chunk", "keys", "counts"]
                    )
            give_back()

    def per_tile(g: pd.DataFrame) -> pd.DataFrame:
        lang, tile, deal = g["lang"].iloc[0], int(g["tile"].iloc[0]), int(g["deal"].iloc[0])
        keys = [from_pair_bytes(x) for x in g["keys"]]
        own, n = tiling.count(lang, tile, np.concatenate(keys), np.concatenate([from_planes(x) for x in g["counts"]]))
        own, n = own[n >= least], n[n >= least]
        out = []
        if len(own):
            out.append((None, pair_bytes(own), n.astype("<i8").tobytes()))
            for chunk, k in zip(g["chunk"].tolist(), keys):
                hit = k[own[np.minimum(np.searchsorted(own, k), len(own) - 1)] == k]
                if len(hit):
                    out.append((chunk, pair_bytes(hit), None))
        give_back()
        found = pd.DataFrame(out, columns=["chunk", "keys", "counts"]).astype({"chunk": "Int64"})
        return found.assign(lang=lang, tile=tile, deal=deal)[["lang", "tile", "deal", "chunk", "keys", "counts"]]

    schema = "lang string, tile long, deal int, chunk long, keys binary, counts binary"
    return state.mapInArrow(per_batch, schema).groupBy("lang", "tile", "deal").applyInPandas(per_tile, schema)


def _unpacked(found: DataFrame) -> DataFrame:
    def per_batch(batches):
        for b in batches:
            for lang, tile, deal, keys, counts in zip(*(b.column(c).to_pylist() for c in ("lang", "tile", "deal", "keys", "counts"))):
                key = from_pair_bytes(keys)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(key), pa.string()), "tile": pa.array(np.full(len(key), tile)), "deal": pa.array(np.full(len(key), deal), pa.int32()),
                    "left": pa.array(key >> 32, pa.int32()), "right": pa.array(key & 0xFFFFFFFF, pa.int32()), "f": pa.array(np.frombuffer(counts, "<i8")),
                })

    rows = found.filter("chunk IS NULL").select("lang", "tile", "deal", "keys", "counts")
    return rows.mapInArrow(per_batch, "lang string, tile long, deal int, left int, right int, f long")


def next_state(state: DataFrame, found: DataFrame, units: DataFrame) -> DataFrame:
    """Places of frequent pairs with the pairs' ids, from what each chunk was told."""
    ids = units.groupBy("lang", "tile", "deal").agg(F.collect_list(F.struct("left", "right", "id")).alias("ids"))  # of one tile's frequent pairs
    told = found.filter("chunk IS NOT NULL").select("lang", "tile", "deal", "chunk", "keys").join(ids, ["lang", "tile", "deal"])

    def name(batches):
        for b in batches:
            own = b.column("ids")
            for i, (chunk, keys) in enumerate(zip(b.column("chunk").to_pylist(), b.column("keys").to_pylist())):
                x = own[i].values
                left, right, no = (x.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("left", "right", "id"))
                key = (left << 32) | right
                order = np.argsort(key)
                mine = from_pair_bytes(keys)
                number = no[order][np.searchsorted(key[order], mine)]
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk]), "keys": pa.array([keys]), "ids": pa.array([planes(number)])})

    answers = told.select("chunk", "keys", "ids").mapInArrow(name, "chunk long, keys binary, ids binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("keys", "ids")).alias("answers"))

    def follow(batches):
        for b in batches:
            for (chunk, lang, place, unit, last), answer in zip(_state_rows(b), b.column("answers").to_pylist()):
                known = np.concatenate([from_pair_bytes(x["keys"]) for x in answer])
                number = np.concatenate([from_planes(x["ids"]) for x in answer])
                order = np.argsort(known)
                known, number = known[order], number[order]
                which, key = pairs_of(place, unit, last)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key
                yield _state(chunk, lang, place[which[hit]], number[at[hit]], last[which[hit] + 1])
            give_back()

    # answers grow with the texts, so they are never broadcast
    return state.join(answers.hint("merge"), "chunk").mapInArrow(follow, STATE)


def first_state(coded: DataFrame, asked: DataFrame, words: DataFrame) -> DataFrame:
    """Places of frequent words with their ids; each word of a chunk is told its id, or -1."""
    ids = bounded_broadcast(words.select("lang", "word", "id"), words.count())  # a chunk's words are then not shuffled again
    told = asked.select("chunk", "lang", "no", "word").join(ids, ["lang", "word"], "left")
    told = told.select("chunk", "no", F.coalesce("id", F.lit(-1)).alias("id"))
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("no", "id")).alias("answers"))  # of one chunk's words

    def per_batch(batches):
        for b in batches:
            answers = b.column("answers")
            for i, (chunk, lang, codes) in enumerate(zip(*(b.column(c).to_pylist() for c in ("chunk", "lang", "codes")))):
                x = answers[i].values
                no, id_ = (x.field(c).to_numpy(zero_copy_only=False) for c in ("no", "id"))
                code = from_planes(codes) - 1
                known = np.full(max(int(code.max()), int(no.max())) + 2, -1, np.int32)  # the last one is for breaks
                known[no] = id_
                unit = known[code]
                place = np.flatnonzero(unit >= 0)
                unit = unit[place]
                if len(place):
                    yield _state(chunk, lang, place, unit, unit)
            give_back()

    return coded.select("chunk", "lang", "codes").join(told, "chunk").mapInArrow(per_batch, STATE)


# --- phrases ----------------------------------------------------------------------


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, tile_pairs: int = TILE_PAIRS
) -> tuple[DataFrame, DataFrame]:
    """(lang, n) with the number of words, and (lang, words, f) of all phrases of 1 to ``longest`` words that occur ``least`` times."""
    coded = stored(coded_chunks(docs, text_col, lang_col), "coded")
    asked = coded.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("no", "x")).select(
        "chunk", "lang", "no", F.col("x.words").alias("word"), F.col("x.counts").alias("n")
    )
    totals = stored(asked.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    sizes = stored(totals.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    words = ranked(totals.filter(F.col("f") >= least), [F.desc("f"), "word"], "word-ids")
    state = stored(first_state(coded, asked, words), "places")
    units = words.select("lang", "id", F.array("word").alias("words"), "f")
    levels = [units]
    for _ in range(2, longest + 1):
        tiling = make_tiling(state, levels[-1], units, tile_pairs)
        found = stored(frequent_pairs(state, tiling, least), "pairs")
        pairs = ranked(_unpacked(found), [F.desc("f"), "left", "right"], "pair-ids")
        if pairs.isEmpty():
            break
        left = levels[-1].select("lang", F.col("id").alias("left"), F.col("words").alias("__first"))
        right = units.select("lang", F.col("id").alias("right"), F.col("words").alias("__last"))
        named = pairs.join(left, ["lang", "left"]).join(right, ["lang", "right"])
        levels.append(stored(named.select("lang", "id", F.concat("__first", "__last").alias("words"), "f"), "phrases"))
        if len(levels) < longest:
            state = stored(next_state(state, found, pairs), "places")
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.union(level)
    return sizes, rows.select("lang", "words", "f")


def make_tiling(state: DataFrame, left: DataFrame, right: DataFrame, tile_pairs: int) -> Tiling:
    """Tiles for the languages with enough pairs to fill several; smaller languages are one tile each."""
    mass = {r["lang"]: (r["mass"], r["n"]) for r in _large(left, tile_pairs)}
    ranges = {lang: max(LEAST_RANGES, math.ceil(math.sqrt(m / tile_pairs))) for lang, (m, _) in mass.items()}
    if not ranges:
        return Tiling({}, {}, {}, {})
    n_right = {r["lang"]: r["n"] for r in right.filter(F.col("lang").isin(list(ranges))).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    tiling = Tiling(cut_ids(left, ranges), cut_ids(right, ranges), {k: n for k, (_, n) in mass.items()}, n_right)
    crowded = tile_sizes(state, tiling).filter(F.col("n") > 2 * tile_pairs).collect()  # fewer than pairs / tile_pairs
    tiling.deals = {(r["lang"], r["tile"]): math.ceil(r["n"] / tile_pairs) for r in crowded}
    return tiling


def _large(units: DataFrame, tile_pairs: int) -> list:
    """Languages whose frequent units stand at enough places: fewer than all places / tile_pairs * 16."""
    return units.groupBy("lang").agg(F.sum("f").alias("mass"), F.count("*").alias("n")).filter(F.col("mass") * 16 > tile_pairs).collect()


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
    covered_percent: int = 100, tile_pairs: int = TILE_PAIRS,
) -> DataFrame:
    """(lang, rank, words, phrase, a, l, r, n, score): the ``top`` phrases of each language by their weakest cut.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends
    (LF, VT, FF, CR), and those into words at spaces and tabs. ``a``, ``l``,
    ``r`` are how often the phrase, its first and its last part occur within
    pieces, ``n`` the words of the language; of all cuts the one with the least
    floor(1000 * a * n / (l * r)) counts, then the shortest first part. Phrases
    inside a longer one that occurs at least ``covered_percent`` % as often are
    left out. NULL texts are empty and a NULL language is ``und``; rows need no
    id, and repeated rows count each time. Numbers are exact to 38 digits.
    """
    sizes, rows = frequent_phrases(docs, text_col, lang_col, least, longest, tile_pairs)
    freq = stored(rows, "phrase-counts")
    phrases = freq.filter(F.size("words") > 1)
    size = F.size("words")
    # any longer phrase that covers this one has a part of one word more that covers it as well
    parts = F.array(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1))
    longer = phrases.filter(size > 2).select("lang", F.explode(F.array_distinct(parts)).alias("words"), F.col("f").alias("__f"))
    longer = longer.groupBy("lang", "words").agg(F.max("__f").alias("__f"))
    open_ = phrases.join(longer, ["lang", "words"], "left").filter(
        F.col("__f").isNull() | (100 * F.col("__f") < covered_percent * F.col("f"))
    ).select("lang", "words", F.col("f").alias("a"))
    cuts = open_.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumns(
        {"first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, size - F.col("k"))}
    )
    part = lambda c, n: freq.select("lang", F.col("words").alias(c), F.col("f").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    exact = lambda c, d: F.col(c).cast(f"decimal({d},0)")
    over = (F.lit(1000) * F.col("a")).cast("decimal(19,0)") * exact("n", 18)
    cuts = cuts.withColumns({"__over": over, "__under": exact("l", 19) * exact("r", 18)}).withColumn("score", F.expr("__over div __under"))
    best = cuts.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b")).select(
        "lang", "words", F.array_join("words", " ").alias("phrase"), "b.a", "b.l", "b.r", "b.n", "b.score"
    )
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
