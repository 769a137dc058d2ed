"""Projections and reshaping: splitting, pivoting, nesting, categories."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import cut_lineage, join_on_keys, store_and_reload
from tallyloom.functions.columns import hash_draw
from tallyloom.operators.quantiles import exact_quantiles
from tallyloom.operators.sequence import sequence_columns

# --- choosing and renaming columns -------------------------------------------


def pick(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns that match a regular expression."""
    return [c for c in df.columns if re.search(pattern, c)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def rename_all(df: DataFrame, rule: Callable[[str], str]) -> DataFrame:
    return df.toDF(*[rule(c) for c in df.columns])


def change_columns(df: DataFrame, columns: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one function to each of the columns, keeping the column order."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})


# --- splitting and joining text columns --------------------------------------


def split_columns(
    df: DataFrame,
    column: str,
    into: Mapping[str, str],
    pattern: str,
    merge_rest: bool = True,
    keep: bool = False,
) -> DataFrame:
    """Split a text column into typed columns.

    ``into`` maps new names to types. Too many pieces stay in the last column
    (``merge_rest``) or are dropped; missing pieces are NULL.
    """
    parts = F.split(F.col(column), pattern, len(into) if merge_rest else -1)
    new = [F.get(parts, i).try_cast(t).alias(c) for i, (c, t) in enumerate(into.items())]
    kept = [c for c in df.columns if keep or c != column]
    return df.select(*kept, *new)


def split_rows(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """One row per piece of a delimited column."""
    return df.withColumn(column, F.explode(F.split(F.col(column), pattern)))


def extract_columns(df: DataFrame, column: str, into: Mapping[str, str], pattern: str) -> DataFrame:
    """Regex capture groups into typed columns; NULL when nothing matches."""
    hit = F.col(column).rlike(pattern)
    return df.withColumns(
        {
            c: F.when(hit, F.regexp_extract(column, pattern, i)).try_cast(t)
            for i, (c, t) in enumerate(into.items(), start=1)
        }
    )


def unite(df: DataFrame, name: str, columns: Sequence[str], sep: str) -> DataFrame:
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]).alias(name))


def key_value_columns(
    df: DataFrame, column: str, keys: Sequence[str], pair_sep: str = r"\s+", value_sep: str = ":"
) -> DataFrame:
    """``key:value`` tokens into one column per key; absent keys are NULL."""
    pairs = F.str_to_map(F.col(column), F.lit(pair_sep), F.lit(value_sep))
    return df.withColumn("__m", pairs).select(
        *[c for c in df.columns if c != column], *[F.col("__m")[k].alias(k) for k in keys]
    )


# --- long and wide -------------------------------------------------------------


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def to_wide(
    df: DataFrame, ids: Sequence[str], name: str, value: str, levels: Sequence, fill=None
) -> DataFrame:
    """One column per listed level. The list is explicit, so no extra job runs."""
    wide = df.groupBy(*ids).pivot(name, list(levels)).agg(F.first(value, ignorenulls=True))
    return wide if fill is None else wide.na.fill(fill, [str(x) for x in levels])


def nest(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, chunk_rows: int = 10_000
) -> DataFrame:
    """Rows of a key as an array of structs.

    A key with more than ``chunk_rows`` rows gets several nest rows (``chunk``
    0, 1, ...) instead of one array that outgrows a task.
    """
    inner = [c for c in df.columns if c not in keys]
    placed = sequence_columns(df, keys, order, position="__pos")
    chunk = F.floor((F.col("__pos") - 1) / chunk_rows).cast("long")
    packed = placed.select(*keys, chunk.alias("chunk"), F.struct("__pos", *inner).alias("__s"))
    lists = packed.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("__s")).alias("__l"))
    clean = F.transform("__l", lambda s: F.struct(*[s[c].alias(c) for c in inner]))
    return lists.select(*keys, "chunk", clean.alias(name))


def unnest(df: DataFrame, name: str, sep: str | None = None) -> DataFrame:
    """Array of structs back to rows; ``sep`` prefixes names with the column."""
    keep = [c for c in df.columns if c not in (name, "chunk")]
    rows = df.select(*keep, F.explode_outer(name).alias("__s"))
    fields = rows.schema["__s"].dataType.names
    label = (lambda f: f"{name}{sep}{f}") if sep else (lambda f: f)
    return rows.select(*keep, *[F.col("__s")[f].alias(label(f)) for f in fields])


# --- keys and categories --------------------------------------------------------


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key. Spark limits each key before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def lump_rare(df: DataFrame, column: str, n: int, other: str = "Other", name: str | None = None) -> DataFrame:
    """Keep the n most frequent categories (ties kept), the rest become other."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).filter(F.col(column).isNotNull())
    counts = store_and_reload(counts, "category-counts")
    floor = counts.select("__n").orderBy(F.desc("__n")).limit(n).agg(F.min("__n").alias("__floor"))
    top = counts.filter(F.col("__n") >= floor.scalar()).select(column, F.lit(True).alias("__top"))
    lumped = F.when(F.col("__top"), F.col(column)).when(F.col(column).isNotNull(), F.lit(other))
    return df.join(top, column, "left").withColumn(name or column, lumped).drop("__top")


def order_by_median(df: DataFrame, category: str, value: str, name: str) -> DataFrame:
    """Category table with its exact median and the rank of that median."""
    medians = cut_lineage(exact_quantiles(df, [category], value, {"median": 0.5}))
    ranks = sequence_columns(medians.select("median").distinct(), [], ["median"], position=name)
    return join_on_keys(medians, ranks, ["median"])


def surrogate_ids(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Consecutive ids for the sorted distinct combinations of the columns."""
    distinct = df.select(*columns).distinct()
    return sequence_columns(distinct, [], list(columns), position=name)


def sample_rows(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly n rows without replacement; the same rows on every run."""
    draw = hash_draw(seed, *keys)
    return df.withColumn("__d", draw).orderBy("__d", *keys).limit(n).drop("__d")


def hash_split(df: DataFrame, share: float, seed: int, *keys: str, name: str = "is_train") -> DataFrame:
    """Flag a repeatable random share of the rows."""
    return df.withColumn(name, hash_draw(seed, *keys) % 1000 < int(round(share * 1000)))
