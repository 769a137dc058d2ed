"""Ordered-series operators: differences, crossings, intervals, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import (
    cut_lineage,
    join_on_keys,
    store_and_reload,
    with_bounded_totals,
    with_group_totals,
    with_table_scalars,
)
from tallyloom.operators.reshape import nest
from tallyloom.operators.sequence import sequence_columns, sliding_blocks


#: Positions of a run are covered by blocks of this many, blocks of blocks and so on.
BLOCK, LEVELS = 64, 5


def differences(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "diff", **kw
) -> DataFrame:
    """Difference to the previous row, 0 on the first row of a series."""
    out = sequence_columns(df, keys, order, lag={"__p": value}, **kw)
    return out.withColumn(name, F.coalesce(F.col(value) - F.col("__p"), F.lit(0))).drop("__p")


def group_maximum_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows that attain the group maximum, ties kept."""
    best = with_group_totals(df, list(keys), F.max(value).alias("__max"))
    return best.filter(F.col(value) == F.col("__max")).drop("__max")


def half_life(
    df: DataFrame, keys: Sequence[str], time: str, value: str, key_time: str | None = None
) -> DataFrame:
    """First time a series is at or below half its peak, at or after the peak.

    Gives the time since the peak and, when ``key_time`` names a column of the
    series' own start, the time since that start.
    """
    keys = list(keys)
    per = keys + ([key_time] if key_time else [])
    df = cut_lineage(df)  # a period table, used twice
    peaks = df.groupBy(*per).agg(
        F.max(value).alias("peak"),
        F.max_by(F.col(time), F.struct(F.col(value), -F.col(time).cast("long"))).alias("peak_time"),
    )
    after = join_on_keys(df, peaks, per).filter(
        (F.col(time) >= F.col("peak_time")) & (F.col(value) <= F.col("peak") / 2)
    )
    hits = after.groupBy(*per, "peak", "peak_time").agg(F.min(time).alias("half_time"))
    out = hits.withColumn("half_life_from_peak", F.col("half_time") - F.col("peak_time"))
    if key_time:
        out = out.withColumn("half_life_from_key", F.col("half_time") - F.col(key_time))
    return out


def plot_rank(df: DataFrame, keys: Sequence[str], by: Sequence[str | Column], n: int, name: str) -> DataFrame:
    """First n rows per group, numbered from n down to 1."""
    w = Window.partitionBy(*keys).orderBy(*by)
    best = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return best.withColumn(name, F.lit(n + 1) - F.col("__rn")).drop("__rn")


def with_limits(df: DataFrame, value: str, k: float = 2.0) -> DataFrame:
    """Whole-table mean and standard deviation on each row, with limits."""
    stats = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    out = with_table_scalars(df, stats)
    return out.withColumns(
        {"lower": F.col("mean") - k * F.col("sd"), "upper": F.col("mean") + k * F.col("sd")}
    )


def top_groups(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """All rows of the n groups with the largest total (ties kept)."""
    totals = store_and_reload(df.groupBy(key).agg(F.sum(value).alias("group_total")), "group-totals")
    best = totals.select("group_total").distinct().orderBy(F.desc("group_total")).limit(n)
    kept = totals.filter(F.col("group_total") >= best.agg(F.min("group_total")).scalar())
    return df.join(kept, key)


# --- events on a series --------------------------------------------------------


def crossings(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, start: str, stop: str, **kw
) -> DataFrame:
    """Band and mean crossings of a series: short and long starts and stops.

    ``start`` and ``stop`` are columns with the band and the closing level. A
    row that crosses both ways counts as a start.
    """
    s = sequence_columns(df, keys, order, lag={"__p": value}, **kw)
    p, v, hi, mid = F.col("__p"), F.col(value), F.col(start), F.col(stop)
    short = F.when((p < hi) & (v >= hi), "short_start").when((p > mid) & (v <= mid), "short_stop")
    long = F.when((p > -hi) & (v <= -hi), "long_start").when((p < -mid) & (v >= -mid), "long_stop")
    sides = F.array(
        F.struct(F.lit("short").alias("side"), short.alias("op")),
        F.struct(F.lit("long").alias("side"), long.alias("op")),
    )
    return (
        s.withColumn("__e", F.explode(sides))
        .withColumns({"side": F.col("__e")["side"], "op": F.col("__e")["op"]})
        .drop("__e", "__p")
        .filter("op IS NOT NULL")
    )


def drop_repeats(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, keep_first: bool = True, **kw
) -> DataFrame:
    """Drop rows whose state equals that of the previous row."""
    s = sequence_columns(df, keys, order, lag={"__p": state}, **kw)
    changed = ~F.col(state).eqNullSafe(F.col("__p")) if keep_first else F.col(state) != F.col("__p")
    return s.filter(changed).drop("__p")


def start_stop_intervals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, op: str, **kw
) -> DataFrame:
    """Pair each ``x_start`` with a directly following ``x_stop``."""
    s = sequence_columns(df, keys, order, lead={"__op": op, "__t": time}, **kw)
    side = F.regexp_replace(op, "_start$", "")
    paired = F.col(op).endswith("_start") & (F.col("__op") == F.concat(side, F.lit("_stop")))
    return s.filter(paired).select(
        *keys,
        side.alias("operation"),
        F.col(time).alias("open"),
        F.col("__t").alias("close"),
        F.datediff("__t", F.col(time)).alias("days"),
    )


# --- integer series ---------------------------------------------------------------


def not_sum_of_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, before: int, strict: bool = True, **kw
) -> DataFrame:
    """Rows whose value is not the sum of two of the previous ``before`` values.

    ``strict`` wants two different values; otherwise equal values at different
    positions count as well. The look-back is a bounded array per row.
    """
    placed = sequence_columns(df, keys, order, position="pos", **kw)
    blocks = sliding_blocks(placed, keys, "pos", before)
    w = Window.partitionBy(*keys, "__blk").orderBy("pos").rowsBetween(-before, -1)
    prev = blocks.withColumn("__prev", F.collect_list(value).over(w))
    x = F.col(value)

    def makes_sum(a):
        other = F.array_contains(F.col("__prev"), x - a) & (x - a != a)
        if strict:
            return other
        twice = (x - a == a) & (F.size(F.filter(F.col("__prev"), lambda y: y == a)) > 1)
        return other | twice

    found = F.exists("__prev", makes_sum)
    return prev.filter(F.col("__own") & (F.col("pos") > before) & ~found).select(*keys, "pos", value)


def runs_with_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, target: int, **kw
) -> DataFrame:
    """Contiguous runs (two rows or more) whose sum equals the target.

    Prefix sums turn the search into an equi-join. A run is then cut into whole
    blocks of ``BLOCK`` positions, blocks of blocks and the rows at its ends, so
    that its minimum and maximum cost a few hundred rows at any length.
    """
    keys = list(keys)
    s = sequence_columns(df, keys, order, running={"__s": value}, position="pos", **kw)
    s = store_and_reload(s.select(*keys, "pos", "__s", F.col(value).alias("__v")), "prefix-sums")
    ends = s.select(*keys, F.col("pos").alias("last_pos"), F.col("__s").alias("__at"))
    starts = s.select(*keys, F.col("pos").alias("first_pos"), (F.col("__s") - F.col("__v") + target).alias("__at"))
    runs = starts.join(ends, [*keys, "__at"]).filter(F.col("last_pos") > F.col("first_pos")).drop("__at")
    level = s.select(*keys, F.lit(0).alias("__level"), F.col("pos").alias("__block"), F.col("__v").alias("lo"), F.col("__v").alias("hi"))
    blocks = level
    for n in range(1, LEVELS):
        level = level.groupBy(*keys, F.floor(F.col("__block") / BLOCK).alias("__block")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        level = level.select(*keys, F.lit(n).alias("__level"), "__block", "lo", "hi")
        blocks = blocks.union(level)
    steps = runs.withColumn("__p", F.explode(_run_blocks("first_pos", "last_pos")))
    steps = steps.select(*keys, "first_pos", "last_pos", F.col("__p.level").alias("__level"), F.explode(F.sequence("__p.from", "__p.to")).alias("__block"))
    values = steps.join(blocks, [*keys, "__level", "__block"])
    return values.groupBy(*keys, "first_pos", "last_pos").agg(
        F.min("lo").alias("min_value"), F.max("hi").alias("max_value"), (F.min("lo") + F.max("hi")).alias("min_plus_max")
    )


def _run_blocks(first: str, last: str) -> Column:
    """(level, from, to) of the whole blocks, largest inside, that make up positions ``first`` to ``last``."""
    piece = lambda n, lo, hi: F.when(
        lo <= hi, F.struct(F.lit(n).alias("level"), lo.cast("long").alias("from"), hi.cast("long").alias("to"))
    )
    lo, hi, going, pieces = F.col(first), F.col(last), F.lit(True), []
    for n in range(LEVELS):
        up_lo, up_hi = F.ceil(lo / BLOCK), F.floor((hi + 1) / BLOCK) - 1  # whole blocks of the next level
        split = (up_lo <= up_hi) if n + 1 < LEVELS else F.lit(False)
        pieces += [
            F.when(going & ~split, piece(n, lo, hi)),
            F.when(going & split, piece(n, lo, up_lo * BLOCK - 1)),
            F.when(going & split, piece(n, (up_hi + 1) * BLOCK, hi)),
        ]
        lo, hi, going = up_lo, up_hi, going & split
    return F.array_compact(F.array(*pieces))


def chain_arrangements(df: DataFrame, keys: Sequence[str], value: str, chunk_rows: int = 10_000) -> DataFrame:
    """Number of ascending chains from 0 to the greatest value with steps 1 to 3.

    Ways to reach a value depend on the three values below it, so each gap is
    a 3x3 matrix acting on those counts. Matrices are multiplied per chunk of
    the sorted series first and the products are folded, ``chunk_rows`` at a
    time, until one is left. Values that are not above 0, where the chains
    start, cannot be on one.
    """
    keys = list(keys)
    distinct = df.filter(F.col(value) > 0).select(*keys, F.col(value).cast("long").alias("v")).distinct()
    gaps = sequence_columns(distinct, keys, ["v"], lag={"__p": "v"}).select(
        *keys, "v", (F.col("v") - F.coalesce("__p", F.lit(0))).alias("gap")
    )
    chunks = nest(gaps, keys, ["v"], "steps", chunk_rows)
    d = lambda x: F.lit(float(x))
    unit = F.array(*[d(x) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])

    def step(m, s):
        # rows of m: coefficients of ways at v-1, v-2, v-3 in the start state
        at = lambda r, c: F.get(m, 3 * r + c)
        zero = F.array(d(0), d(0), d(0))
        row = lambda r: F.array(at(r, 0), at(r, 1), at(r, 2))
        add = lambda *rs: F.array(*[sum((at(r, c) for r in rs[1:]), at(rs[0], c)) for c in range(3)])
        g = s["gap"]
        return (
            F.when(g == 1, F.concat(add(0, 1, 2), row(0), row(1)))
            .when(g == 2, F.concat(add(0, 1), zero, row(0)))
            .when(g == 3, F.concat(row(0), zero, zero))
            .otherwise(F.concat(zero, zero, zero))
        )

    def times(late, early):
        cell = lambda r, c: sum(
            (F.get(late, 3 * r + k) * F.get(early, 3 * k + c) for k in (1, 2)), F.get(late, 3 * r) * F.get(early, c)
        )
        return F.array(*[cell(r, c) for r in range(3) for c in range(3)])

    products = chunks.select(*keys, "chunk", F.aggregate("steps", unit, step).alias("m"))
    while True:
        up = F.floor(F.col("chunk") / chunk_rows).cast("long").alias("__up")
        lists = products.groupBy(*keys, up).agg(F.sort_array(F.collect_list(F.struct("chunk", "m"))).alias("ms"))
        folded = F.aggregate("ms", unit, lambda acc, s: times(s["m"], acc))
        products = store_and_reload(lists.select(*keys, F.col("__up").alias("chunk"), folded.alias("m")), "chain-products")
        if not products.agg(F.max("chunk")).first()[0]:
            break
    # the chain starts with one way at 0, so the first cell is the answer
    return products.select(*keys, F.get("m", 0).alias("arrangements"))


def event_flags(
    df: DataFrame, keys: Sequence[str], time: str, event_date: Column, **kw
) -> DataFrame:
    """Elapsed index T, after-event flag D and time since the event P."""
    s = sequence_columns(df, keys, [time], position="T", **kw)
    s = s.withColumn("D", F.when(F.col(time) >= event_date, 1).otherwise(0))
    n_before = F.count_if(F.col("D") == 0)
    if kw.get("bounded"):
        before = with_bounded_totals(s, list(keys), __n0=n_before)
    else:
        before = with_group_totals(s, list(keys), n_before.alias("__n0"))
    return before.withColumn("P", F.when(F.col("D") == 1, F.col("T") - F.col("__n0")).otherwise(0)).drop("__n0")
