"""Quality classifier: held-out accuracy, the prior, and what it never reads."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def scored(tables):
    return quality.score_quality(*tables).toPandas().set_index("doc_id")


def test_held_out_documents_are_told_apart(tables, scored):
    both = scored.join(tables[1].toPandas().set_index("doc_id"), how="inner")
    held = both[both.held_out]
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad).mean() > 0.97
    assert (held.predicted == held.quality).mean() > 0.93 and (held.predicted[held.quality == 1] == 1).mean() > 0.97


def test_folds_scores_and_predictions_are_as_stated(tables, scored):
    assert len(scored) == tables[0].count()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in scored.held_out.items())
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.3)).all()


def test_scores_depend_on_the_text_alone_and_labels_of_fold_zero_are_not_read(tables):
    docs, labels = tables
    docs = docs.filter("doc_id < 300").cache()
    flipped = labels.withColumn("quality", F.when(quality.fold_zero(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a, b = quality.score_quality(docs, labels).toPandas(), quality.score_quality(other, flipped).toPandas()
    a, b = a.sort_values("doc_id"), b.sort_values("doc_id")
    assert np.allclose(a.score, b.score)


def test_prior_of_separable_scores():
    rng = np.random.default_rng(3)
    p, n = rng.normal(3, 1, 4000), rng.normal(-3, 1, 4000)
    for share in (0.3, 0.8):
        u = np.where(rng.random(4000) < share, rng.permutation(p), n)
        assert abs(quality.class_prior(rng.normal(3, 1, 4000), u) - share) < 0.05


def test_messy_rows_are_all_scored(messy, spark):
    labels = spark.createDataFrame([(i, 1, None) for i in range(20)] + [(1, 0, 1), (None, 1, 1), (30, None, 1)], "doc_id long, quality int, text string")
    got = quality.score_quality(messy, labels).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (60, 61)}
    assert len(empty) == 1  # empty and NULL texts are the same


def test_carried_columns_come_back_as_they_were(messy):
    rows = lambda df: sorted(map(str, df.select("doc_id", "text", "source", "key").collect()))
    assert rows(quality.score_texts(messy, None, carry=("text", "source", "key"))) == rows(messy)


def test_without_labels_or_documents(messy, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(messy, none).collect()} == {0.5}
    assert quality.score_quality(nothing, none).collect() == []
