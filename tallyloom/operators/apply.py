"""Functions over groups of rows, with failures kept as data."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import hot_rows
from tallyloom.operators.sequence import sequence_columns


def per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[pd.DataFrame], dict],
    schema: str,
    merge: Mapping[str, Column],
    chunk_rows: int | None = None,
) -> DataFrame:
    """Call a Python function per group, in chunks; one result row per group.

    For functions without a built-in form. ``fn`` sees at most ``chunk_rows``
    rows of a key, consecutive in ``order`` (a unique order inside the key),
    and gives partial results, which the ``merge`` aggregates combine: no task
    ever needs a whole large group. An error in a chunk gives NULL results and
    its text in ``error`` for that key; other keys are not affected.
    """
    keys = list(keys)
    limit = chunk_rows or hot_rows(df.sparkSession)
    fields = T.StructType.fromDDL(schema).fieldNames()
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {schema}, error string"

    def safe(key, pdf):
        row = dict(zip(keys, key))
        try:
            row.update(fn(pdf.drop(columns=["__chunk", "__pos"])), error=None)
        except Exception as e:
            row.update({f: None for f in fields}, error=f"{type(e).__name__}: {e}")
        return pd.DataFrame([row], columns=[*keys, *fields, "error"])

    rows = sequence_columns(df, keys, order, position="__pos")
    chunk = F.floor((F.col("__pos") - 1) / limit).cast("long")
    parts = rows.withColumn("__chunk", chunk).groupBy(*keys, "__chunk").applyInPandas(safe, out)
    failed = F.max("error")
    merged = parts.groupBy(*keys).agg(*[m.alias(c) for c, m in merge.items()], failed.alias("error"))
    return merged.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in merge})


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One function from several table steps, applied left to right."""
    return lambda df: functools.reduce(lambda acc, step: acc.transform(step), steps, df)
