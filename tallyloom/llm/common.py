"""What the training-data operators share: input columns, sizes, stored tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import store_and_reload

#: A NULL id takes part as the smallest id.
NULL_ID = -(2**63)


def id_and_text_columns(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """(key, text): the id as a long, NULL ids as the smallest, NULL texts as empty."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ]


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(*id_and_text_columns(id_col, text_col))


def shown_id(key: str = "key") -> Column:
    """The id as it was given: NULL again where it was NULL."""
    return F.when(F.col(key) != NULL_ID, F.col(key))


def bucket(n: int, *cols) -> Column:
    """A number from 0 to n - 1 by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def parts(total: int | None, per_part: int) -> int:
    """How many parts of about ``per_part`` units hold ``total`` units."""
    return max(1, math.ceil((total or 0) / per_part))


def text_bytes(texts: DataFrame) -> int:
    """Bytes of all texts, from one scan of the text column."""
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The table written once to the shared folder and read back."""
    return store_and_reload(df, f"llm-{tag}")


def give_back(cycles: bool = True) -> None:
    """Returns freed memory of a Python worker to the system; idle workers keep it otherwise.

    Looking for ``cycles`` takes tens of milliseconds, which is much for a small group.
    """
    import ctypes
    import gc

    import pyarrow as pa

    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
