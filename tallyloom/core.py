"""Session-level helpers shared by every operator."""

from __future__ import annotations

import contextlib
import functools
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Session setting: a group with more rows than this never goes to one task.
HOT_ROWS_CONF = "tallyloom.hotRows"
HOT_ROWS_DEFAULT = 2_000_000

#: Tables whose row count is proven to be at most this many may be broadcast.
BROADCAST_ROWS = 200_000


def hot_rows(spark: SparkSession) -> int:
    """Largest number of rows of one group that a single task may hold."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="tallyloom-")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is
    used only when nothing is set and the master is local (tests).
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_scratch()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tallyloom/{tag}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_dir(spark)}/tallyloom/checkpoints")
    return df.checkpoint(eager=True)


def store_and_reload(df: DataFrame, tag: str, fmt: str = "parquet") -> DataFrame:
    """Write an intermediate table once and go on from the stored copy.

    For results of a long computation that several branches use: optimised
    apart, the branches would each repeat it. The copy is columnar, so every
    branch reads just its columns.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.format(fmt).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


#: Spark removes the shuffle files of a query when it ends, not when the driver collects its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries that run here leave no shuffle files: many rounds need the disk of the largest one."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def join_on_keys(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", nulls: bool = True
) -> DataFrame:
    """Equi-join in which NULL keys match each other; the left keys are kept.

    The join stays hash- or sort-merge-based (`<=>` is an equi-join key), so
    adaptive skew handling can split a hot left side. ``nulls=False`` says that
    keys are never NULL; plain equality can then reuse an existing partitioning.
    """
    if not nulls:
        return left.join(right, list(keys), how).select(
            *left.columns, *([] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in keys])
        )
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = functools.reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def spread(table: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work on a freshly read table.

    Files with few splits would leave cores idle. Tables with at least one
    split per core, as any large table has, are returned as they are.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def bounded_broadcast(df: DataFrame, max_rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the caller's proven row bound is small enough."""
    return F.broadcast(df) if max_rows <= limit else df


def with_group_totals(df: DataFrame, keys: list[str], *aggs: Column, nulls: bool = True) -> DataFrame:
    """Attach group aggregates to every row without one task per group.

    The aggregate is combined map-side to one row per group and joined back;
    an analytic window would pull a hot group into a single task instead.
    """
    if not keys:
        return with_table_scalars(df, df.agg(*aggs))
    return join_on_keys(df, df.groupBy(*keys).agg(*aggs), keys, nulls=nulls)


def with_bounded_totals(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Same as :func:`with_group_totals` for groups of a limited size.

    For groups that the data model bounds (for example by a calendar), an
    analytic window reads the input once and needs no join.
    """
    w = Window.partitionBy(*keys)
    return df.withColumns({name: a.over(w) for name, a in aggs.items()})


def with_table_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table as scalar subqueries."""
    packed = one_row.select(F.struct(*one_row.columns).alias("__s"))
    return df.withColumn("__s", packed.scalar()).select(
        *df.columns, *[F.col("__s")[c].alias(c) for c in one_row.columns]
    )


#: Rows that one task of :func:`dealt` holds.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int | None, *keys: str, per_task: int | None = None) -> DataFrame:
    """Hash-partitioned by ``keys`` so that a task gets about ``per_task`` of ``rows``.

    Partitions merged by their compressed bytes would put ever more rows into one
    task where rows compress well, or where each becomes many; a number that is
    given is kept.
    """
    at_least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(at_least, math.ceil((rows or 0) / (per_task or TASK_ROWS))), *keys)


def block_count(rows: int, per_block: int) -> int:
    return max(2, math.ceil(rows / max(1, per_block)))


class Tables:
    """Lazy access to the parquet tables below one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
