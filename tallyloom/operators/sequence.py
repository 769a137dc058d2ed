"""Ordered-series columns that stay distributed when one series is huge.

`lag`, `lead`, running sums and row positions need order inside a series. A
plain window sends each series to one task. Here, series with more rows than
the session's hot limit are cut into contiguous blocks by a range exchange;
windows run per block and a small table of block edges (at most one row per
block and series) carries values across the cuts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import block_count, bounded_broadcast, cut_lineage, hot_rows, join_on_keys


def _local(df, part, order, lag, lead, running, position):
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    out.update({o: F.lag(c).over(w) for o, c in lag.items()})
    out.update({o: F.lead(c).over(w) for o, c in lead.items()})
    out.update({o: F.sum(c).over(upto) for o, c in running.items()})
    if position:
        out[position] = F.row_number().over(w).cast("long")
    return df.withColumns(out)


def sequence_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    *,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    position: str | None = None,
    bounded: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Add previous/next values, running sums and 1-based row positions.

    ``lag``, ``lead`` and ``running`` map an output name to an input column.
    ``order`` must order each series totally. ``bounded=True`` states that the
    group size is limited by the data model (for example by a calendar), which
    skips the check for hot series.
    """
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    lag, lead, running = dict(lag or {}), dict(lead or {}), dict(running or {})
    if bounded:
        return _local(df, keys, order, lag, lead, running, position)

    limit = limit or hot_rows(df.sparkSession)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    n_hot, hot_total = sizes.agg(F.count("*"), F.sum("__n")).first()
    if not n_hot:
        return _local(df, keys, order, lag, lead, running, position)

    if keys:
        hot_keys = bounded_broadcast(cut_lineage(sizes.select(*keys)), n_hot)
        cold = join_on_keys(df, hot_keys, keys, "left_anti")
        hot = join_on_keys(df, hot_keys, keys, "left_semi")
    else:
        cold, hot = None, df

    # Range exchange on (series, order): every block is contiguous and the
    # sampled bounds split hot series. The checkpoint freezes block numbers.
    blocks = block_count(hot_total, limit)
    cut = hot.repartitionByRange(blocks, *keys, *order).withColumn("__blk", F.spark_partition_id())
    cut = cut_lineage(cut)
    part = ["__blk", *keys]
    w = Window.partitionBy(*part).orderBy(*order)
    carried = sorted({*lag.values(), *lead.values()})
    local = _local(cut, part, order, lag, lead, running, "__rn").withColumns(
        {
            "__last": F.lead(F.lit(1)).over(w).isNull(),
            "__first_row": F.first(F.struct(F.lit(1).alias("__one"), *carried)).over(w),
        }
    )
    edges = local.filter("__last").select(
        *part,
        F.col("__rn").alias("__cnt"),
        F.struct(F.lit(1).alias("__one"), *carried).alias("__last_row"),
        "__first_row",
        *[F.col(o).alias(f"__tot_{o}") for o in running],
    )
    we = Window.partitionBy(*keys).orderBy("__blk")
    before = we.rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(
        *part,
        F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__before"),
        F.lag("__last_row").over(we).alias("__prev_row"),
        F.lead("__first_row").over(we).alias("__next_row"),
        *[F.sum(f"__tot_{o}").over(before).alias(f"__pre_{o}") for o in running],
    )
    carry = bounded_broadcast(carry, blocks + n_hot)
    joined = join_on_keys(local.drop("__first_row"), carry, part)
    final = {}
    for o, c in lag.items():
        final[o] = F.when(F.col("__rn") == 1, F.col("__prev_row")[c]).otherwise(F.col(o))
    for o, c in lead.items():
        final[o] = F.when(F.col("__last"), F.col("__next_row")[c]).otherwise(F.col(o))
    for o in running:
        final[o] = F.coalesce(F.col(o) + F.col(f"__pre_{o}"), F.col(o), F.col(f"__pre_{o}"))
    if position:
        final[position] = (F.col("__rn") + F.col("__before")).cast("long")
    added = [*lag, *lead, *running, *([position] if position else [])]
    result = joined.withColumns(final).select(*[c for c in df.columns if c not in added], *added)
    return result if cold is None else result.unionByName(
        _local(cold, keys, order, lag, lead, running, position)
    )


def sliding_blocks(
    df: DataFrame, keys: Sequence[str], position: str, before: int, block_rows: int = 100_000
) -> DataFrame:
    """Copy the last ``before`` rows of a block to the next one.

    Adds ``__blk`` and ``__own``. A window of at most ``before`` preceding rows
    can then run per ``(keys, __blk)``; only rows with ``__own`` are results.
    Every block holds at most ``block_rows + before`` rows of a series.
    """
    step = max(block_rows, before)
    own = F.floor((F.col(position) - 1) / step).cast("long")
    spill = F.floor((F.col(position) - 1 + before) / step).cast("long")
    return (
        df.withColumn("__home", own)
        .withColumn("__blk", F.explode(F.array_distinct(F.array(own, spill))))
        .withColumn("__own", F.col("__blk") == F.col("__home"))
        .drop("__home")
    )
