"""Readers for delimited, ragged and plain-text files, and table storage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.columns import snake_name
from tallyloom.operators.sequence import sequence_columns


def read_header_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line; the schema is given, never inferred."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_single_column(spark: SparkSession, path: str, schema: str = "v string") -> DataFrame:
    """File without header and with one column."""
    return spark.read.schema(schema).csv(path)


def read_delimited_parts(
    spark: SparkSession, paths: str | list[str], schema: str, comment: str | None = None
) -> DataFrame:
    """Tab-separated part files as one table; comment lines are skipped.

    A filter applied to the result runs in the scan stage of every part.
    """
    reader = spark.read.schema(schema).option("sep", "\t").option("quote", "")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(paths)


def read_messy_header(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Header file whose column names are brought to snake_case.

    Only the header is looked at; all columns arrive as text.
    """
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return df.toDF(*[snake_name(c) for c in df.columns])


def read_ragged_records(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str],
    record_sep: str = "\t",
    field_sep: str = ",",
) -> DataFrame:
    """Lines that hold many records each; records become typed rows."""
    record = F.explode(F.split(F.trim(F.col("value"), F.lit(f" {record_sep}")), record_sep))
    records = spark.read.text(path).select(record.alias("r"))
    fields = records.select(F.split("r", field_sep).alias("f"))
    return fields.select(
        *[F.get("f", i).try_cast(t).alias(c) for i, (c, t) in enumerate(columns.items())]
    )


def read_typed_lines(spark: SparkSession, path: str, as_type: str = "string") -> DataFrame:
    """One value per line; lines that do not parse give NULL."""
    return spark.read.text(path).select(F.trim("value").try_cast(as_type).alias("v"))


def read_blank_line_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of several lines, separated by a blank line."""
    text = spark.read.option("lineSep", "\n\n").text(path)
    return text.select(F.trim("value", F.lit(" \n")).alias("record")).filter("record <> ''")


def marker_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], is_marker: Column, name: str
) -> DataFrame:
    """Number the groups that start at marker rows of an ordered table."""
    flagged = df.withColumn("__m", F.when(is_marker, 1).otherwise(0))
    return sequence_columns(flagged, keys, order, running={name: "__m"}).drop("__m")


def read_word_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Words separated by any white space."""
    words = F.explode(F.split(F.trim("value"), r"\s+"))
    return spark.read.text(path).select(words.alias("word")).filter("word <> ''")


def stack_layouts(
    frames: Sequence[DataFrame], renames: Sequence[Mapping[str, str]], columns: Sequence[str]
) -> DataFrame:
    """Bring tables with drifting column names to one layout and stack them.

    Column names are normalised first (snake_case), then each layout's rename
    map is applied; columns a layout lacks become NULL.
    """
    out = None
    for df, names in zip(frames, renames):
        df = df.toDF(*[snake_name(c) for c in df.columns]).withColumnsRenamed(dict(names))
        df = df.select(*[c for c in columns if c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select(*[c for c in columns if c in out.columns])


def file_date(pattern: str = r"(\d{4}-\d{2}-\d{2})") -> Column:
    """Date in the name of the file (or folder) a row was read from."""
    return F.regexp_extract(F.input_file_name(), pattern, 1).try_cast("date")
