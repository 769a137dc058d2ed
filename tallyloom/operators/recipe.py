"""Fitted preprocessing as stages of a Spark ML pipeline, saved and loaded with it.

Every stage works on those of its ``inputCols`` that are still there, so columns
that an earlier stage drops are skipped. Statistics come from one aggregate per
pass; nothing but a few numbers per column is kept in a fitted stage.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import store_and_reload
from tallyloom.operators.stats import near_zero_variance


class _Stage(HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """What all stages share: input columns, of which some may be gone."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=list(inputCols))

    def present(self, df: DataFrame) -> list[str]:
        return [c for c in self.getInputCols() if c in df.columns]


def _floats(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=TypeConverters.toListFloat)


def _strings(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=TypeConverters.toListString)


# --- near-zero variance ---------------------------------------------------------------


class NearZeroVariance(_Stage, Estimator):
    """Drops columns with one dominant value and few distinct ones."""

    def _fit(self, df: DataFrame) -> NearZeroVarianceModel:
        found = near_zero_variance(df, self.present(df)).filter("drop").select("column").collect()
        model = NearZeroVarianceModel(inputCols=self.getInputCols())
        return model._set(dropped=sorted(r["column"] for r in found))


class NearZeroVarianceModel(_Stage, Model):
    dropped = _strings("dropped", "columns to drop")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.getOrDefault(self.dropped))


# --- Box-Cox ----------------------------------------------------------------------------


def box_cox(value: Column, power: float) -> Column:
    """The transform with the given power; values of 0 or less give NULL."""
    x = value.cast("double")
    out = F.ln(x) if power == 0 else (F.pow(x, F.lit(power)) - 1) / power
    return F.when(x > 0, out)


def power_moments(df: DataFrame, columns: Sequence[str], tried: dict[str, range], step: float) -> DataFrame:
    """(i, k, n, m, m2, logs): number, mean and squared deviations of the transforms with power k * step of column i.

    ``logs`` is the sum of logarithms. Columns hold positive doubles or NULL. The
    powers of a column are one chain of products, and a task hands on one row
    for each of them.
    """

    def joined(a, b):
        n, d = a[0] + b[0], b[1] - a[1]
        return (n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n) if n else a

    def per_task(batches):
        found, logs = {}, dict.fromkeys(range(len(columns)), 0.0)
        for b in batches:
            for i, c in enumerate(columns):
                x = np.log(b.column(c).drop_null().to_numpy(zero_copy_only=False))
                if not len(x):
                    continue
                logs[i] += float(x.sum())
                ks, by = tried[c], np.exp(x * step)
                z = np.exp(x * (ks[0] * step))
                for k in ks:
                    y = z if k else x
                    mean = float(y.mean())
                    d = y - mean
                    own = (len(y), (mean - 1) / (k * step), float(d @ d) / (k * step) ** 2) if k else (len(y), mean, float(d @ d))
                    found[i, k] = joined(found.get((i, k), (0, 0.0, 0.0)), own)
                    z = z * by
        rows = [(i, k, *v, logs[i]) for (i, k), v in found.items()]
        names = ["i", "k", "n", "m", "m2", "logs"]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

    def of_all_tasks(key, g: pd.DataFrame) -> pd.DataFrame:
        total = (0, 0.0, 0.0)
        for own in zip(g["n"].tolist(), g["m"].tolist(), g["m2"].tolist()):
            total = joined(total, own)
        return pd.DataFrame([(*key, *total, g["logs"].sum())], columns=list(g.columns))

    schema = "i int, k int, n long, m double, m2 double, logs double"
    return df.select(*columns).mapInArrow(per_task, schema).groupBy("i", "k").applyInPandas(of_all_tasks, schema)


class BoxCox(_Stage, Estimator):
    """Box-Cox by the power with the largest profile likelihood.

    A grid over [-5, 5] is refined twice around its best power, to steps of
    1/1600; each round is one pass over the stored columns. Columns with values of
    0 or less, or without variance, stay as they are.
    """

    STEPS = (1 / 4, 1 / 80, 1 / 1600)
    SIDE = 20

    def _fit(self, df: DataFrame) -> BoxCoxModel:
        columns = self.present(df)
        model = BoxCoxModel(inputCols=self.getInputCols())
        df = store_and_reload(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "box-cox") if columns else df
        least = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        columns = [c for i, c in enumerate(columns) if (least[f"lo{i}"] or 0) > 0 and least[f"lo{i}"] < least[f"hi{i}"]]
        best = dict.fromkeys(columns, 0)  # in units of the step
        for n, step in enumerate(self.STEPS if columns else ()):
            if n:
                best = {c: k * round(self.STEPS[n - 1] / step) for c, k in best.items()}
            tried = {c: range(best[c] - self.SIDE, best[c] + self.SIDE + 1) for c in columns}
            moments = {(r["i"], r["k"]): r for r in power_moments(df, columns, tried, step).collect()}  # 41 rows for a column

            def likelihood(i, k):
                r = moments[i, k]
                return -r["n"] / 2 * _log(r["m2"] / r["n"]) + (k * step - 1) * r["logs"] if r["m2"] else float("-inf")

            best = {c: max(tried[c], key=lambda k, i=i: (likelihood(i, k), -k)) for i, c in enumerate(columns)}
        return model._set(changed=columns, powers=[best[c] * self.STEPS[-1] for c in columns])


def _log(v: float) -> float:
    import math

    return math.log(v)


class BoxCoxModel(_Stage, Model):
    changed = _strings("changed", "columns that are transformed")
    powers = _floats("powers", "their powers")

    def _transform(self, df: DataFrame) -> DataFrame:
        pairs = zip(self.getOrDefault(self.changed), self.getOrDefault(self.powers))
        return df.withColumns({c: box_cox(F.col(c), p) for c, p in pairs if c in df.columns})


# --- centre and scale ---------------------------------------------------------------------


class CentreScale(_Stage, Estimator):
    """Columns with mean 0 and standard deviation 1; a column without variance is only centred."""

    def _fit(self, df: DataFrame) -> CentreScaleModel:
        columns = self.present(df)
        aggs = [f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_samp)]
        row = df.agg(*aggs).first() if aggs else []
        means, spreads = [float(x or 0.0) for x in row[0::2]], [float(x or 0.0) or 1.0 for x in row[1::2]]
        return CentreScaleModel(inputCols=self.getInputCols())._set(changed=columns, means=means, spreads=spreads)


class CentreScaleModel(_Stage, Model):
    changed = _strings("changed", "columns that are transformed")
    means = _floats("means", "their means")
    spreads = _floats("spreads", "their standard deviations")

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = zip(*(self.getOrDefault(p) for p in (self.changed, self.means, self.spreads)))
        return df.withColumns({c: (F.col(c) - m) / s for c, m, s in rows if c in df.columns})


class KeptColumns(_Stage, HasOutputCol, Transformer):
    """The columns that are left, as one feature vector; NULL counts as 0, the mean after centring."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, outputCol: str = "features"):
        super().__init__(inputCols=inputCols)
        self._set(outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.present(df)])
        return df.withColumn(self.getOutputCol(), array_to_vector(values))


def numeric_recipe(columns: Sequence[str]) -> list:
    """Near-zero variance, Box-Cox, centre and scale, in this order."""
    return [s(inputCols=list(columns)) for s in (NearZeroVariance, BoxCox, CentreScale)]
