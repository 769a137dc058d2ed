"""Joins, set operations, sorts and limits beyond the one-line built-ins."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import dealt, hot_rows, join_on_keys, shuffles_freed, store_and_reload
from tallyloom.operators.sequence import sequence_columns

# --- joins --------------------------------------------------------------------


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all column names the two tables share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no shared columns")
    return left.join(right, shared, how)


def crossing(df: DataFrame, **grids: Sequence) -> DataFrame:
    """Every row with every combination of the literal grid values.

    A grid is a bounded parameter list; it is exploded in place, so the large
    side is neither shuffled nor joined.
    """
    for name, values in grids.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def _exact(count: str) -> str:
    """A row count as a decimal, so that products of counts stay exact."""
    return f"cast({count} as decimal(19,0))"


def _choose(count: str, k: int) -> str:
    """How many sets of ``k`` rows there are among ``count`` rows, exactly."""
    factors = " * ".join(f"cast({count} - {i} as decimal(12,0))" for i in range(k))
    return f"cast(({factors}) div {(1, 1, 2, 6)[k]} as decimal(19,0))"


def sum_pairs(df: DataFrame, value: str, target: int) -> DataFrame:
    """Pairs of rows whose values add up to a target, as value pairs.

    Rows are first counted per value; the complement is an equi-join key of
    distinct values. ``n_pairs`` says how many row pairs a value pair stands
    for, so heavily repeated values never multiply rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    counts = store_and_reload(counts, "value-counts")
    a = counts.select(F.col(value).alias("a"), F.col("n").alias("n_a"))
    b = counts.select(F.col(value).alias("b"), F.col("n").alias("n_b"))
    pairs = a.join(b, F.col("b") == F.lit(target) - F.col("a")).filter("a <= b")
    n_pairs = F.expr(f"if(a = b, {_choose('n_a', 2)}, {_exact('n_a')} * n_b)").cast("long")
    return (
        pairs.select("a", "b", n_pairs.alias("n_pairs"), (F.col("a") * F.col("b")).alias("product"))
        .filter("n_pairs > 0")
    )


def sum_triples(df: DataFrame, value: str, target: int) -> DataFrame:
    """Triples of rows whose integer values add up to a target.

    Distinct values are dealt into as many equal ranges as there are values, at
    most one for each integer. A smallest value goes to the ranges that its
    middle value can be in and meets the values there; the third value is the
    complement of both. So the work is bounded by pairs of distinct values and
    by the width of the values, whichever is less, and not by the rows. Value
    triples with repeats are counted by combinations.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    counts = store_and_reload(counts, "value-counts")
    least, most, distinct = counts.agg(F.min(F.col(value).cast("long")), F.max(F.col(value).cast("long")), F.count("*")).first()
    least, most = least or 0, most or 0
    width = -(-(most - least + 1) // max(distinct, 1))
    side = lambda v, n: counts.select(F.col(value).cast("long").alias(v), F.col("n").alias(n))
    at = lambda v: F.expr(f"({v} - {least}) div {width}")
    top = F.least(F.floor((F.lit(target).cast("long") - F.col("a")) / 2), F.lit(most).cast("long"))
    low = F.greatest(F.col("a"), F.lit(target - most) - F.col("a"))  # below, c would be above the largest value
    ab = (
        side("a", "n_a")
        .filter(F.col("a") * 3 <= target)
        .withColumns({"low": low, "top": top})
        .filter("low <= top")
        .withColumn("range", F.explode(F.sequence(at("low"), at("top"))))
        .join(side("b", "n_b").withColumn("range", at("b")), "range")
        .filter(F.col("b").between(F.col("low"), F.col("top")))
        .withColumn("c", F.lit(target).cast("long") - F.col("a") - F.col("b"))
        .join(side("c", "n_c"), "c")
    )
    n = F.expr(
        f"case when a = b and b = c then {_choose('n_a', 3)} when a = b then {_choose('n_a', 2)} * n_c"
        f" when b = c then {_choose('n_b', 2)} * n_a else {_exact('n_a')} * n_b * n_c end"
    ).cast("long")
    product = F.col("a") * F.col("b") * F.col("c")
    return ab.select("a", "b", "c", n.alias("n_triples"), product.alias("product")).filter(
        "n_triples > 0"
    )


def pair_counts(
    df: DataFrame, group: str, member: str, min_count: int = 1, split_rows: int | None = None
) -> DataFrame:
    """How many groups contain both members of a pair (``a < b``).

    Members that occur in fewer than ``min_count`` groups cannot be part of a
    result and are removed before the join. Groups with more than
    ``split_rows`` members are salted: their left members are spread over
    several salts and their right members are copied to each, so no task holds
    such a group. Pair rows are combined map-side right after the join; a raw
    pair is never shuffled. The join has as many tasks as its raw pairs need.
    """
    rows = df.select(group, member).na.drop()
    split = split_rows or max(2, int(hot_rows(df.sparkSession) ** 0.5))
    sizes = rows.groupBy(group).agg(F.count("*").alias("__size"))
    n = F.col("__size").cast("double")
    with shuffles_freed(df.sparkSession):
        largest, raw = sizes.agg(F.max("__size"), F.sum(n * (n - 1) / 2)).first()
    any_large = (largest or 0) > split
    rows = rows.distinct()
    if min_count > 1:
        often = rows.groupBy(member).agg(F.count("*").alias("__deg")).filter(F.col("__deg") >= min_count)
        rows = rows.join(often.select(member), member, "left_semi")
    if any_large:
        large = sizes.filter(F.col("__size") > split).select(
            group, F.ceil(F.col("__size") / split).cast("long").alias("__salts")
        )
        rows = rows.join(large, group, "left").withColumn("__salts", F.coalesce("__salts", F.lit(1)))
        left = rows.select(
            group, F.col(member).alias("a"), F.pmod(F.xxhash64(member), F.col("__salts")).alias("__salt")
        )
        right = rows.select(
            group,
            F.col(member).alias("b"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1)).alias("__salt"),
        )
        pairs = dealt(left, raw, group, "__salt").join(dealt(right, raw, group, "__salt"), [group, "__salt"])
    else:
        rows = dealt(rows, raw, group)
        pairs = rows.select(group, F.col(member).alias("a")).join(
            rows.select(group, F.col(member).alias("b")), group
        )
    counted = pairs.filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count) if min_count > 1 else counted


def dictionary_repair(
    df: DataFrame, raw: str, dictionary: DataFrame, name: str, code: str
) -> DataFrame:
    """Resolve values that are either names or codes to (code, name).

    Values found as a name get its code; others are taken as a code. Rows that
    match neither way are dropped, as an inner join on the code does.
    """
    by_name = dictionary.select(F.col(name).alias("__name"), F.col(code).alias("__code"))
    coded = df.join(by_name, F.col(raw) == F.col("__name"), "left")
    coded = coded.withColumn("__key", F.coalesce(F.col("__code"), F.col(raw))).drop("__name", "__code")
    return coded.join(dictionary, F.col("__key") == F.col(code)).drop("__key", raw)


def lookup_first(
    df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order: Sequence[str]
) -> DataFrame:
    """Value of the first table row with the key; NULL without a match."""
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    firsts = table.groupBy(F.col(table_key).alias(key)).agg(F.min_by(value, by).alias(value))
    return df.join(firsts, key, "left")


def bind_columns(
    left: DataFrame, left_order: Sequence[str], right: DataFrame, right_order: Sequence[str]
) -> DataFrame:
    """Put two tables side by side by row position in their given orders.

    The shorter table has NULLs beside the rest of the longer one.
    """
    a = sequence_columns(left, [], left_order, position="row_no")
    b = sequence_columns(right, [], right_order, position="row_no")
    return a.join(b, "row_no", "full")


def role_join(
    df: DataFrame, dimension: DataFrame, key: str, roles: dict[str, str]
) -> DataFrame:
    """Join one dimension several times, once per role.

    ``roles`` maps a prefix to the column of ``df`` that plays the role.
    """
    values = [c for c in dimension.columns if c != key]
    for prefix, column in roles.items():
        dim = dimension.select(
            F.col(key).alias(column), *[F.col(c).alias(f"{prefix}_{c}") for c in values]
        )
        df = df.join(dim, column)
    return df


def successors_within(df: DataFrame, keys: Sequence[str], value: str, reach: int) -> DataFrame:
    """Distinct values paired with those 1..reach above them in the series.

    The few candidate values are generated and met by an equi-join, instead of
    a range condition over all rows of the series.
    """
    distinct = df.select(*keys, value).distinct()
    steps = F.sequence(F.col(value) + 1, F.col(value) + reach)
    candidates = distinct.select(*keys, F.col(value).alias("from_value"), F.explode(steps).alias(value))
    return candidates.join(distinct, [*keys, value]).select(
        *keys, "from_value", F.col(value).alias("to_value")
    )


def within_previous(
    df: DataFrame, keys: Sequence[str], position: str, value: str, before: int
) -> DataFrame:
    """Rows whose value already occurs in the previous ``before`` rows.

    Rows meet on (keys, value, position block); a look-back of ``before`` rows
    touches at most two blocks of that length.
    """
    block = F.floor(F.col(position) / before).cast("long")
    now = df.select(*keys, position, value).withColumn(
        "__blk", F.explode(F.array(block, block - 1))
    )
    past = df.select(*keys, F.col(position).alias("__p"), value, block.alias("__blk"))
    hit = now.join(past, [*keys, value, "__blk"]).filter(
        F.col("__p").between(F.col(position) - before, F.col(position) - 1)
    )
    return hit.groupBy(*keys, position, value).agg(F.max("__p").alias("seen_at"))


# --- sets ----------------------------------------------------------------------


def missing_ids(df: DataFrame, column: str, chunk: int = 100_000) -> DataFrame:
    """Integers between the least and greatest id that do not occur.

    The range is generated in chunks spread over the cluster.
    """
    lo_hi = df.agg(F.min(column).cast("long").alias("lo"), F.max(column).cast("long").alias("hi"))
    starts = lo_hi.filter("lo IS NOT NULL").select(
        "hi", F.explode(F.sequence("lo", "hi", F.lit(chunk))).alias("__from")
    )
    spread = starts.repartition("__from")
    last = F.least(F.col("hi"), F.col("__from") + chunk - 1)
    full = spread.select(F.explode(F.sequence(F.col("__from"), last)).alias(column))
    return full.join(df.select(F.col(column).cast("long").alias(column)), column, "left_anti")


def dense_calendar(df: DataFrame, keys: Sequence[str], day: str, n_days: int | None = None) -> DataFrame:
    """Make implicit date gaps of every series explicit rows with NULLs.

    ``n_days``, where it is known, is the number of rows of the result; the join
    then has as many tasks as they need.
    """
    spans = df.groupBy(*keys).agg(F.min(day).alias("__lo"), F.max(day).alias("__hi"))
    days = spans.select(*keys, F.explode(F.sequence("__lo", "__hi", F.expr("interval 1 day"))).alias(day))
    if n_days is not None:
        days, df = (dealt(x, n_days, *keys, day) for x in (days, df))
    return days.join(df, [*keys, day], "left")


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- sorts and limits ------------------------------------------------------------


def last_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Last n rows of an order, by a reversed top-n instead of a full sort."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def top_with_ties(df: DataFrame, n: int, by: str) -> DataFrame:
    """All rows that are not below the n-th largest value."""
    best = df.select(by).filter(F.col(by).isNotNull()).orderBy(F.desc(by)).limit(n)
    return df.filter(F.col(by) >= best.agg(F.min(by)).scalar())


def top_per_group(df: DataFrame, keys: Sequence[str], by: Sequence[str | Column], n: int) -> DataFrame:
    """First n rows per group in a total order; limited before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def top_per_group_with_ties(df: DataFrame, keys: Sequence[str], by: str, n: int) -> DataFrame:
    """Rows per group that are not below the group's n-th largest value.

    The n best rows give a threshold per group, which is joined back: ties of
    any number never meet in one task.
    """
    keys = list(keys)
    best = top_per_group(df.select(*keys, by).filter(F.col(by).isNotNull()), keys, [F.desc(by)], n)
    floor = best.groupBy(*keys).agg(F.min(by).alias("__floor"))
    return join_on_keys(df, floor, keys).filter(F.col(by) >= F.col("__floor")).drop("__floor")


def rank_bands(
    df: DataFrame, order: Sequence[str | Column], key: Sequence[str], bands: Sequence[tuple[int, str]], other: str
) -> DataFrame:
    """Label rows by rank: the first m are one band, the next another, ...

    Only the rows of the bands are ranked (a top-n); all others get ``other``.
    """
    most = max(m for m, _ in bands)
    top = df.orderBy(*order).limit(most).select(*key, *[c for c in df.columns if c not in key])
    w = Window.orderBy(*order)
    label = None
    for m, name in sorted(bands):
        cond = F.col("__rn") <= m
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    ranked = top.withColumn("__rn", F.row_number().over(w)).select(*key, label.alias("band"))
    return join_on_keys(df, F.broadcast(ranked), list(key), "left").withColumn(
        "band", F.coalesce("band", F.lit(other))
    )
