"""Resampled outcomes: draw observed values again and compare sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import hash_draw
from tallyloom.operators.sequence import sequence_columns


def simulated_sums(
    observed: DataFrame, entity: str, value: str, order: list[str], roster: DataFrame, side: list[str],
    sims: int, seed: int,
) -> DataFrame:
    """Per side and simulation: sum of one redrawn value of each entity.

    Values are numbered inside their entity. A draw is a number, so drawn
    values arrive by an equi-join on (entity, number) however many values one
    entity has. Entities without observations count as 0.
    """
    placed = sequence_columns(observed.select(entity, value, *[o for o in order if o != value]), [entity], order, position="__pos")
    sizes = observed.groupBy(entity).agg(F.count(value).alias("__size"))
    known = roster.join(sizes, entity, "left")
    draws = known.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(sims)))).withColumn(
        "__pos", hash_draw(seed, entity, "sim") % F.col("__size") + 1
    )
    drawn = draws.join(placed.select(entity, "__pos", value), [entity, "__pos"], "left")
    return drawn.groupBy(*side, "sim").agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("points"))


def outcome_shares(sums: DataFrame, match: str, role: str, home: str, away: str) -> DataFrame:
    """Home, away and tie shares and the mean difference per match."""
    side = lambda s: F.sum(F.when(F.col(role) == s, F.col("points")).otherwise(0.0))
    per_sim = sums.groupBy(match, "sim").agg(side(home).alias("h"), side(away).alias("a"))
    share = lambda c: F.avg(c.cast("int"))
    return per_sim.groupBy(match).agg(
        share(F.col("h") > F.col("a")).alias("home_win"),
        share(F.col("h") < F.col("a")).alias("away_win"),
        share(F.col("h") == F.col("a")).alias("tie"),
        F.avg(F.col("h") - F.col("a")).alias("mean_difference"),
        F.stddev_samp(F.col("h") - F.col("a")).alias("sd_difference"),
    )


def simulated_differences(sums: DataFrame, match: str, role: str, home: str) -> DataFrame:
    """Score difference of every simulation of a match."""
    signed = F.when(F.col(role) == home, F.col("points")).otherwise(-F.col("points"))
    return sums.groupBy(match, "sim").agg(F.sum(signed).alias("difference"))
