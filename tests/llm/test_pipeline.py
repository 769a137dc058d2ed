"""The pipeline on the smallest tables: each stage against what it should keep, and the packing against the texts."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from tallyloom.llm import quality
from tallyloom.llm.common import stored
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_near import brute as brute_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in cp.STAGES:
        out[name] = docs = stored(stage(spark, docs, SF), name)
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].dtypes == stages["input"].dtypes


def test_classifier_drops_what_it_rejects_and_keeps_good_documents(spark, stages):
    kept = {r["doc_id"] for r in stages["quality_classifier"].collect()}
    model = quality.train_model(stages["input"], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.score_texts(stages["input"], model).collect()}
    assert kept == {i for i, s in scores.items() if s >= quality.CUT}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert len(good & kept) >= 0.97 * len(good)


def test_lines_classes_and_mix_follow_their_definitions(stages):
    before = [(r["doc_id"], r["text"]) for r in stages["quality_classifier"].collect()]
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["line_dedup"].collect()}
    assert after == {i: (t, len(t)) for i, _, _, t in brute_lines(before)}
    classes = brute_classes([(i, t) for i, (t, _) in after.items()])
    assert {r["doc_id"] for r in stages["near_dedup"].collect()} == set(classes.values())
    texts = {r["doc_id"]: r["text"] for r in stages["near_dedup"].collect()}
    mixed = Counter((r["doc_id"], r["text"]) for r in stages["source_mix"].collect())
    assert all(texts[i] == t and n <= 2 for (i, t), n in mixed.items()) and len(mixed) < sum(mixed.values())


def test_packing_covers_the_mix(stages):
    rows = stages["packing"].collect()
    firsts = Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert firsts == Counter(r["doc_id"] for r in stages["source_mix"].collect())
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 3


def test_pipeline_takes_messy_and_empty_tables(spark, messy, nothing):
    labels = f"{SF}"
    for docs in (messy.select(*cp.COLUMNS), nothing.select(*cp.COLUMNS)):
        for name, stage in cp.STAGES:
            docs = stored(stage(spark, docs, labels), name)
        assert docs.columns[0] == "doc_id"


def test_registered_queries_are_the_thirteen_and_the_pipeline():
    import __spark_entry__ as e

    mine = [q for q in e.queries() if q.startswith("op") and "_" in q and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in mine) == list(range(1, 14)) and "pipeline" in e.queries()
