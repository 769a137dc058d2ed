"""Near-duplicate documents by ProbMinHash over weighted word shingles.

Every shingle of a document is a Poisson process whose rate is its weight, one
plus the logarithm of its count. Each arrival falls on a random component of the
signature, and a component keeps the shingle that arrives first; a shingle stops
when its next arrival is later than all that the signature holds. Components of
two documents agree with probability equal to their probability Jaccard index.
Where counts are unequal, that lies below the Jaccard index of the sets, so a text with
unequal counts has a second signature with equal weights, whose components agree
as often as the sets do; with equal counts the two are the same. Bands of the
signatures pick candidates, and the shingle sets of candidates are compared exactly.

Equal texts are one candidate. Of a bucket, members are first compared with its
smallest id, then those of other classes with its most typical text. What is
left in different classes is compared where two texts have a rare shingle in
common, or where sizes allow a link without any, so a large group of copies is never paired out,
and no link between classes is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import give_back, id_and_text, shown_id, stored
from tallyloom.llm.words import batches_of, mix, shingles, split_words
from tallyloom.operators.graph import components

WIDTH = 5
SIMILAR = 0.8
BANDS = 20
#: A shingle that at most so many candidates have is rare: they are compared one by one.
RARE = 8
ROWS = 4
#: Characters whose shingles a worker holds at a time; their arrays take many times as much.
SLICE = 1 << 20
#: Bits per key of the bitmap that drops texts before they are shuffled, and its most bits (64 MB).
KEY_BITS = 16
MOST_BITS = 1 << 29


# --- signatures -------------------------------------------------------------------


def weighted_shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and hash: (text, hash, count)."""
    text, h = shingles(split_words(texts), width)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def prob_min_hash(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Signatures (n_texts, m) of shingle hashes; rows of texts without shingles are 0."""
    first = np.full(n_texts * m, np.inf)
    sig = np.zeros(n_texts * m, np.uint64)
    owner, item, rate, time = text, h, weight.astype(np.float64), np.zeros(len(h))
    arrival = 0
    while len(item):
        with np.errstate(over="ignore"):
            z = mix(item + np.uint64(arrival + 1) * np.uint64(0xD1342543DE82EF95))
        u = ((z >> np.uint64(20)).astype(np.float64) + 0.5) * 2.0**-44
        time = time - np.log(u) / rate
        cell = owner * m + ((z & np.uint64(0xFFFFF)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = time == first[cell]
        sig[cell[won]] = item[won]
        if arrival % 4 == 0 or len(item) < 4 * m:
            limit = first.reshape(n_texts, m).max(axis=1)
            go = time < limit[owner]
            owner, item, rate, time = owner[go], item[go], rate[go], time[go]
        arrival += 1
    return sig.reshape(n_texts, m)


def band_hashes(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int, bands: int, rows: int) -> np.ndarray:
    """(n_texts, bands): a hash per band of each signature."""
    sig = prob_min_hash(text, h, weight, n_texts, bands * rows).reshape(n_texts, bands, rows)
    mark = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n_texts, bands))
    for r in range(rows):
        with np.errstate(over="ignore"):
            mark = mix(mark * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
    return mark.view(np.int64)


def text_bands(text: np.ndarray, h: np.ndarray, count: np.ndarray, n_texts: int, bands: int, rows: int) -> list[np.ndarray]:
    """Hashes of each text's bands: those by weight, and those by equal weights where counts are unequal; none without shingles."""
    out = list(band_hashes(text, h, 1 + np.log(count), n_texts, bands, rows))
    for i in np.flatnonzero(np.bincount(text, minlength=n_texts) == 0):
        out[i] = out[i][:0]
    first = np.searchsorted(text, np.arange(n_texts))
    uneven = np.unique(text[count != count[first[text]]])
    own = np.isin(text, uneven)
    plain = band_hashes(np.searchsorted(uneven, text[own]), h[own], np.ones(own.sum()), len(uneven), bands, rows)
    for i, x in zip(uneven, plain):
        out[i] = np.concatenate([out[i], x])
    return out


def signatures(texts: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(key, h1, h2, bands): two hashes of the text, and the hashes of its bands (none for texts without words)."""

    def per_batch(batches):
        for b in batches:
            for part in batches_of(b, limit=SLICE):
                own = part["text"].tolist()
                t, h, count = weighted_shingles(own, width)
                ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode()) for x in own), "<i8").reshape(-1, 2)
                yield pd.DataFrame({
                    "key": part["key"].to_numpy(), "h1": ids[:, 0], "h2": ids[:, 1],
                    "bands": text_bands(t, h, count, len(own), bands, rows),
                })
                del part, own, t, h, count, ids
            del b
            give_back()

    return texts.mapInPandas(per_batch, "key long, h1 long, h2 long, bands array<long>")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(key, s): the distinct shingles of each text."""

    def per_batch(batches):
        for b in batches:
            for part in batches_of(b, limit=SLICE):
                t, h, _ = weighted_shingles(part["text"].tolist(), width)
                cuts = np.searchsorted(t, np.arange(1, len(part)))
                yield pd.DataFrame({"key": part["key"].to_numpy(), "s": np.split(h.view(np.int64), cuts)})
                del part, t, h, cuts
            del b
            give_back()

    return texts.mapInPandas(per_batch, "key long, s array<long>")


# --- operator ---------------------------------------------------------------------


def _links(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have a Jaccard index of ``similar`` or more; sets are moved for pairs of fitting sizes only."""
    fits = lambda x, y: F.least(x, y) >= similar * F.greatest(x, y)
    pairs = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").filter(fits("na", "nb")).select("a", "b").distinct()
    left = sets.select(F.col("key").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("s").alias("sb"))
    na, nb = F.size("sa"), F.size("sb")
    both = pairs.join(left, "a").join(right, "b").filter(fits(na, nb))
    shared = both.withColumn("n", F.size(F.array_intersect("sa", "sb")))
    return shared.filter(F.col("n") >= similar * (na + nb - F.col("n"))).select("a", "b").distinct()


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, width: int = WIDTH,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(id_col, class_id): the class of each document, named after its smallest id.

    Documents are linked when the sets of their shingles of ``width`` words have
    a Jaccard index of at least ``similar``; classes are connected documents. A
    text of fewer words is one shingle. Equal texts share a class if they have
    words; NULL, empty and wordless texts are alone. Rows that share an id are
    one document with all their texts. Rows without an id take no part: their
    class is NULL. One row per input row; no rows in, none out.
    """
    texts = id_and_text(docs, id_col, text_col)
    named = texts.filter(shown_id().isNotNull())
    marks = stored(signatures(named, width, bands, rows), "signatures")
    copies = stored(
        marks.filter(F.size("bands") > 0).groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.min("bands").alias("bands")), "copies"
    )
    member = copies.select(F.col("rep").alias("key"), F.explode("bands").alias("bucket")).distinct()
    shared = member.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
    member = stored(member.join(shared.select("bucket", "low"), "bucket"), "buckets")
    wanted = stored(member.select("key").distinct(), "wanted")
    sets = stored(shingle_sets(_of_keys(named, wanted).join(wanted, "key", "left_semi"), width).distinct(), "shingles")
    sizes = stored(sets.select("key", F.size("s").alias("n")).distinct(), "sizes")
    stars = stored(member.filter("key > low").select(F.col("low").alias("a"), F.col("key").alias("b")).distinct(), "stars")
    # the texts of an id belong together
    own = marks.join(copies.select("h1", "h2", "rep"), ["h1", "h2"], "left").select("key", F.coalesce("rep", "key").alias("rep"))
    several = own.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b")
    several = own.join(several.select("key", "a"), "key").select("a", F.col("rep").alias("b")).filter("a < b").distinct()
    links = stored(_links(stars, sets, sizes, similar).union(several), "links")
    found = _classes(links)
    placed = stored(_mixed(member, found), "mixed")
    facts, few = _own_shares(_of_keys(sets, placed.select("key").distinct()))
    # second pivot: the member with the least that is only its own, in most groups what the others derive from
    least = placed.join(facts.groupBy("key").agg(F.min("share").alias("share")), "key")
    core = least.groupBy("bucket").agg(F.min(F.struct("share", "key", "class")).alias("c"))
    again = placed.join(core, "bucket").filter(F.col("class") != F.col("c.class"))
    again = again.select(F.least("key", "c.key").alias("a"), F.greatest("key", "c.key").alias("b")).distinct()
    again = stored(again.join(stars, ["a", "b"], "left_anti"), "second-stars")
    second = stored(_between(_links(again, sets, sizes, similar), found), "second-links")
    # for what is left, classes that the second pivots have linked count as one
    low = second.groupBy(F.col("b").alias("class")).agg(F.min("a").alias("low"))
    joined = placed.join(low, "class", "left").select("bucket", "key", F.coalesce("low", "class").alias("class"))
    joined = stored(_still_mixed(joined), "still-mixed")
    rare = _rare_pairs(few.join(joined.select("key", "class").distinct(), "key"))
    rest = _possible_pairs(joined, facts, similar).union(rare).join(stars.union(again), ["a", "b"], "left_anti")
    between = stored(second.union(_between(_links(rest, sets, sizes, similar), found)).distinct(), "class-links")
    ends = own.distinct().join(found.withColumnRenamed("key", "rep"), "rep", "left").select("key", F.coalesce("class", "rep").alias("class"))
    if not between.isEmpty():
        roots = _classes(between).toDF("class", "root")
        ends = ends.join(roots, "class", "left").select("key", F.coalesce("root", "class").alias("class"))
    classes = ends.groupBy("key").agg(F.min("class").alias("class_id"))
    return texts.select("key").join(classes, "key", "left").select(shown_id().alias(id_col), "class_id")


def _of_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows that have one of the keys and few others, found without a shuffle by a bitmap of hashed keys."""
    slot = F.pmod(F.xxhash64("key"), F.lit(min(max(1, KEY_BITS * keys.count()), MOST_BITS))) + 1
    part, bit = F.bitmap_bucket_number(slot).alias("__part"), F.bitmap_bit_position(slot).cast("int").alias("__bit")
    maps = keys.select(part, bit).repartition("__part").groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = "cast(conv(hex(substring(__bits, __bit div 8 + 1, 1)), 16, 10) AS int)"
    near = rows.select("*", part, bit).join(F.broadcast(maps), "__part")
    return near.filter(f"getbit({byte}, __bit % 8) = 1").select(*rows.columns)


def _mixed(member: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, key, class) of the buckets whose members are in several classes."""
    placed = member.select("bucket", "key").join(found, "key", "left").withColumn("class", F.coalesce("class", "key"))
    return _still_mixed(placed)


def _still_mixed(placed: DataFrame) -> DataFrame:
    mixed = placed.groupBy("bucket").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).filter("c0 < c1")
    return placed.join(mixed.select("bucket"), "bucket", "left_semi")


def _between(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) as links between classes, the smaller first."""
    for end in "ab":
        classes = found.select(F.col("key").alias(end), F.col("class").alias(f"class_{end}"))
        links = links.join(classes, end, "left")
    ends = [F.coalesce(f"class_{end}", end) for end in "ab"]
    return links.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).filter("a < b").distinct()


def _own_shares(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shingles that at most ``RARE`` texts have.

    First (key, size, own, share): how many of a text's shingles are rare (0 for
    ids with several texts); then (s, key): the rare ones that several have.
    """
    every = sets.select("key", F.explode("s").alias("s"))
    counted = every.groupBy("s").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    few = stored(every.join(counted.filter(f"n between 2 and {RARE}").select("s"), "s"), "rare-shingles")
    alone = counted.filter("n = 1").groupBy("key").agg(F.count("*").alias("n"))
    own = alone.union(few.groupBy("key").agg(F.count("*"))).groupBy("key").agg(F.sum("n").alias("own"))
    texts = sets.groupBy("key").agg(F.count("*").alias("texts"))
    rows = sets.select("key", F.size("s").alias("size")).distinct().join(texts, "key").join(own, "key", "left")
    rows = rows.withColumn("own", F.when(F.col("texts") > 1, 0).otherwise(F.coalesce("own", F.lit(0))))
    return stored(rows.select("key", "size", "own", (F.col("own") / F.col("size")).alias("share")), "own-shares"), few


def _rare_pairs(rows: DataFrame) -> DataFrame:
    """Pairs in different classes that have a rare shingle (s, key, class) in common; at most ``RARE`` texts meet in one."""
    a, b = (rows.select("s", F.col("key").alias(k), F.col("class").alias(f"class_{k}")) for k in "ab")
    return a.join(b, "s").filter((F.col("a") < F.col("b")) & (F.col("class_a") != F.col("class_b"))).select("a", "b").distinct()


def _possible_pairs(placed: DataFrame, facts: DataFrame, similar: float) -> DataFrame:
    """Pairs of a bucket in different classes that can reach ``similar`` without a rare shingle in common.

    Sets of x and y shingles that are similar share at least
    f (x + y) with f = similar / (1 + similar), here of those that are not rare.
    So the partners of a text have sizes in a range that is often
    empty. Ranges are met by classes of sizes, so that other members of a large
    bucket are never paired.
    """
    f = similar / (1 + similar)
    slack = 1e-9
    step = lambda n: F.floor(F.log(F.greatest(n, F.lit(1.0))) * 20).cast("int")
    shared = placed.groupBy("key").agg(F.collect_set("bucket").alias("buckets"))  # at most two a band
    rows = placed.join(shared, "key").join(facts, "key").withColumn("most", (F.col("size") - F.col("own")) / F.lit(f) - F.col("size") + F.lit(slack))
    rows = rows.filter(F.col("most") >= similar * F.col("size") - slack)
    large = rows.withColumn("top", F.least("most", F.col("size").cast("double")))
    large = large.withColumn("step", F.explode(F.sequence(step(similar * F.col("size") - slack), step(F.col("top")))))
    large = large.select("bucket", "step", *[F.col(c).alias(f"x_{c}") for c in ("key", "class", "size", "most", "buckets")])
    small = rows.withColumn("step", step(F.col("size").cast("double")))
    pairs = large.join(small, ["bucket", "step"]).filter(
        (F.col("class") != F.col("x_class")) & (F.col("size") <= F.col("x_size")) & (F.col("size") <= F.col("x_most"))
        & (F.col("x_size") <= F.col("most")) & (F.col("size") >= similar * F.col("x_size") - slack)
        & (F.col("bucket") == F.array_min(F.array_intersect("buckets", "x_buckets")))  # once, in the first bucket in common
    )
    return pairs.select(F.least("key", "x_key").alias("a"), F.greatest("key", "x_key").alias("b")).distinct()


def _classes(links: DataFrame) -> DataFrame:
    """(key, class) of linked documents; the class is the smallest id."""
    labels = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return stored(labels.select(F.col("id").alias("key"), F.col("component").alias("class")), "classes")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of the smallest id of each near-duplicate class, one for each id and text.

    Rows without an id take part under a number made of their text, before all
    ids that are not negative. Of several rows with the same id and text, the
    one whose other columns have the least hash stays.
    """
    stand_in = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseOR(F.lit(-(2**63)))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), stand_in).alias("key"), F.xxhash64(text_col).alias("body"),
        F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"),
    )
    place = docs.columns.index(text_col)
    classes = near_duplicate_classes(rows.select("key", F.col(f"row.c{place}").alias("text")), "key", "text", **options)
    gone = classes.filter("class_id < key").select("key").distinct()
    kept = rows.join(gone, "key", "left_anti")
    repeats = stored(rows.groupBy("key", "body").agg(F.count("*").alias("n")).filter("n > 1").select("key", "body"), "repeats")
    if not repeats.isEmpty():
        # equal hashes are looked up only; the rows are grouped by the text itself
        several = kept.join(repeats, ["key", "body"], "left_semi").groupBy("key", F.col(f"row.c{place}").alias("text"))
        several = several.agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(repeats, ["key", "body"], "left_anti").select("row").union(several.select("row"))
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
