"""Grouped summaries beyond the one-line built-in aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import cut_lineage, join_on_keys, store_and_reload, with_group_totals, with_table_scalars
from tallyloom.functions.columns import centre_distance
from tallyloom.operators.quantiles import exact_quantiles


def six_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum."""
    return exact_quantiles(
        df,
        keys,
        value,
        {"q1": 0.25, "median": 0.5, "q3": 0.75},
        low="min",
        mean="mean",
        high="max",
    )


def standard_error(c: str) -> Column:
    return F.sqrt(F.var_samp(c) / F.count(c))


def distinct_per_group(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Distinct values per group; deduplication runs on (keys, value)."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.count(value).alias(name))


def held_by_all(df: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """Relational division: values that every member of the group has."""
    facts = store_and_reload(df.select(group, member, value).na.drop().distinct(), "facts")
    members = facts.select(group, member).distinct().groupBy(group).agg(F.count("*").alias("n_members"))
    holders = facts.groupBy(group, value).agg(F.count("*").alias("n_holders"))
    full = holders.join(members, group).filter("n_holders = n_members")
    return full.select(group, value, "n_members")


def weighted_score(
    df: DataFrame, keys: Sequence[str], code: str, weight: str, value: str = "score"
) -> DataFrame:
    """Total weight and weighted mean of a code, from tallied answers."""
    return df.groupBy(*keys).agg(
        F.sum(weight).alias("total"),
        (F.sum(F.col(code) * F.col(weight)) / F.sum(F.when(F.col(code).isNotNull(), F.col(weight)))).alias(value),
    )


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value; the smallest one wins a tie."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(1)


# --- classification quality -----------------------------------------------------


def confusion_counts(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count("*").alias("n"))


def confusion_summary(counts: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, kappa and no-information rate from confusion counts."""
    counts = cut_lineage(counts)
    rows = counts.groupBy(truth).agg(F.sum("n").alias("r")).withColumnRenamed(truth, "__c")
    cols = counts.groupBy(guess).agg(F.sum("n").alias("c")).withColumnRenamed(guess, "__c")
    margins = rows.join(cols, "__c", "full").agg(
        F.sum(F.coalesce("r", F.lit(0)).cast("double") * F.coalesce("c", F.lit(0))).alias("rc"),
        F.max("r").alias("top"),
    )
    total = counts.agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("hits"),
    )
    both = with_table_scalars(total, margins)
    accuracy = F.col("hits") / F.col("n")
    chance = F.col("rc") / (F.col("n").cast("double") * F.col("n"))
    return both.select(
        "n",
        accuracy.alias("accuracy"),
        ((accuracy - chance) / (1 - chance)).alias("kappa"),
        (F.col("top") / F.col("n")).alias("no_information_rate"),
    )


def worst_confusions(counts: DataFrame, truth: str, guess: str) -> DataFrame:
    """Most frequent wrong (truth, guess) pairs, ties kept."""
    errors = cut_lineage(counts.filter(F.col(truth) != F.col(guess)))
    return errors.filter(F.col("n") == errors.agg(F.max("n")).scalar())


# --- arrays -----------------------------------------------------------------------


def mean_vectors(df: DataFrame, keys: Sequence[str], array: str, name: str = "centroid") -> DataFrame:
    """Elementwise mean of array rows per group, combined map-side."""
    vectors = df.select(*keys, array_to_vector(F.col(array).cast("array<double>")).alias("__v"))
    means = vectors.groupBy(*keys).agg(Summarizer.mean(F.col("__v")).alias("__m"), F.count("*").alias("n"))
    return means.select(*keys, vector_to_array("__m").alias(name), "n")


def sum_vectors(df: DataFrame, keys: Sequence[str], array: str, name: str = "total") -> DataFrame:
    """Elementwise sum of array rows per group (NULL elements count as 0), long form."""
    long = df.select(*keys, F.posexplode(array).alias("dim", "__x"))
    return long.groupBy(*keys, "dim").agg(F.sum(F.coalesce("__x", F.lit(0.0))).alias(name))


# --- coverage, histograms, spread ----------------------------------------------------


def radius_counts(df: DataFrame, columns: Sequence[str], centre: float, radii: int) -> DataFrame:
    """Points within radius 1..radii of a centre in 1, 2, ... dimensions.

    The distance of a row is computed once per dimension count and put into
    the first radius that covers it; a running sum over the (bounded) radius
    table gives all counts. One dimension includes the border, more exclude it.
    """
    firsts = []
    for d in range(1, len(columns) + 1):
        dist = centre_distance(columns[:d], centre)
        first = F.ceil(dist) if d == 1 else F.floor(dist) + 1
        firsts.append(F.struct(F.lit(d).alias("dims"), F.greatest(first, F.lit(1)).cast("int").alias("radius")))
    long = df.select(F.explode(F.array(*firsts)).alias("s")).select("s.*")
    hist = long.groupBy("dims", "radius").agg(F.count("*").alias("n"))
    grid = hist.select("dims").distinct().withColumn(
        "radius", F.explode(F.sequence(F.lit(1), F.lit(radii)))
    )
    w = Window.partitionBy("dims").orderBy("radius")
    return (
        grid.join(hist, ["dims", "radius"], "left")
        .withColumn("points", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .drop("n")
    )


def bin_number(c: Column, lo: float, hi: float, bins: int) -> Column:
    """1-based bin; 0 and bins+1 collect the values outside [lo, hi)."""
    inside = (F.floor((c - lo) / (hi - lo) * bins) + 1).cast("int")
    return F.when(c < lo, 0).when(c >= hi, bins + 1).otherwise(inside)


def histogram(
    df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, bins: int, log10: bool = False
) -> DataFrame:
    """Counts per bin, on the value or on its base-10 logarithm."""
    c = F.col(value)
    if log10:
        df, c = df.filter(c > 0), F.log10(c)
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, bin_number(c, lo, hi, bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def box_stats(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends and number of outliers per group."""
    keys = list(keys)
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    joined = join_on_keys(df.select(*keys, value), q, keys)
    step = reach * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - step, F.col("q3") + step)
    return joined.groupBy(*keys).agg(
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def box_outliers(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Rows outside the whiskers."""
    q = exact_quantiles(df, keys, value, {"__q1": 0.25, "__q3": 0.75})
    joined = join_on_keys(df, q, list(keys))
    step = reach * (F.col("__q3") - F.col("__q1"))
    return joined.filter(
        ~F.col(value).between(F.col("__q1") - step, F.col("__q3") + step)
    ).drop("__q1", "__q3")


def central_intervals(
    df: DataFrame, keys: Sequence[str], value: str, widths: Sequence[float]
) -> DataFrame:
    """Central intervals of several widths per group, one row per width."""
    probs, items = {}, []
    for i, w in enumerate(widths):
        probs[f"__lo{i}"], probs[f"__hi{i}"] = (1 - w) / 2, (1 + w) / 2
        items.append(
            F.struct(F.lit(float(w)).alias("width"), F.col(f"__lo{i}").alias("low"), F.col(f"__hi{i}").alias("high"))
        )
    q = exact_quantiles(df, keys, value, probs)
    return q.select(*keys, F.explode(F.array(*items)).alias("s")).select(*keys, "s.*")


def density_grid(
    df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, bins: int, bandwidth: float
) -> DataFrame:
    """Smoothed density per group at the centres of a fixed grid.

    Rows are binned first, then every bin (a bounded table) spreads a Gaussian
    weight over the grid.
    """
    width = (hi - lo) / bins
    centre = lambda b: F.lit(lo) + (b - 0.5) * width
    hist = histogram(df, keys, value, lo, hi, bins).filter(F.col("bin").between(1, bins))
    grid = hist.withColumn("g", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    z = (centre(F.col("g")) - centre(F.col("bin"))) / bandwidth
    weight = F.exp(-0.5 * z * z) / F.lit(bandwidth * 2.5066282746310002)
    dens = grid.groupBy(*keys, "g").agg(F.sum(F.col("n") * weight).alias("__s"))
    totals = hist.groupBy(*keys).agg(F.sum("n").alias("__t"))
    out = join_on_keys(dens, totals, list(keys)) if keys else with_table_scalars(dens, totals)
    return out.select(*keys, centre(F.col("g")).alias("x"), (F.col("__s") / F.col("__t")).alias("density"))


def share_of_group(df: DataFrame, keys: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Share of the group's total, attached to each row."""
    totals = with_group_totals(df, list(keys), F.sum(value).alias("__t"))
    return totals.withColumn(name, F.col(value) / F.col("__t")).drop("__t")


def add_group_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Number of rows in the row's group, attached to each row."""
    return with_group_totals(df, list(keys), F.count(F.lit(1)).alias(name))


def count_where(conditions: dict[str, Column]) -> list[Column]:
    return [F.count_if(c).alias(k) for k, c in conditions.items()]
