"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts are all that training sees. The class
prior comes from the scores of a first model that tells positives from
unlabelled texts: the share of positives is at most the least ratio of the two
tail shares. A small network then minimises the non-negative unbiased risk

    prior * R(positives, +) + max(0, R(unlabelled, -) - prior * R(positives, -)).

Training uses a bounded sample (``max_positives``, ``max_unlabelled``: the rows
of smallest hash); scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import give_back, id_and_text
from tallyloom.llm.words import batches_of, split_words

MAX_POSITIVES = 6_000
MAX_UNLABELLED = 12_000
HIDDEN = 16
SLICE_BYTES = 1 << 20
CUT = 0.3


# --- features ---------------------------------------------------------------------


def features(texts: list[str]) -> np.ndarray:
    """Byte shares (square roots), lengths, and shares of repeated words and lines of whole texts."""
    w = split_words(texts)
    n = len(texts)
    size = np.diff(w.at)
    share = np.empty((n, 256), np.float32)
    for i, (lo, hi) in enumerate(zip(w.at[:-1], w.at[1:])):
        share[i] = np.bincount(w.buf[lo:hi], minlength=256)
    share = np.sqrt(share / size[:, None])
    counts = w.counts
    per = np.maximum(1, counts)
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    order = np.lexsort((w.hash, w.text))
    h, t = w.hash[order], w.text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    length = (w.end - w.start).astype(np.float64)
    total = np.bincount(w.text, length, n)
    spread = np.bincount(w.text, length**2, n) / per - (total / per) ** 2
    capital = (w.buf[w.start] >= 65) & (w.buf[w.start] <= 90)
    return np.column_stack([
        share, np.log1p(counts), total / per / 10, np.sqrt(np.maximum(0, spread)) / 10,
        np.bincount(w.text, again, n) / per, np.bincount(t, new, n) / per, np.bincount(w.text, capital, n) / per,
        np.log1p(np.bincount(w.text, again, n)),
    ]).astype(np.float32)


# --- model ------------------------------------------------------------------------


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x).astype(np.float64))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, rounds: int, seed: int) -> Model:
    """Minimises the non-negative risk; without a prior, tells positives from unlabelled rows."""
    both = np.concatenate([p, u])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    d = both.shape[1]
    v = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m1, m2 = [np.zeros_like(x) for x in v], [np.zeros_like(x) for x in v]
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))
    for step in range(1, rounds + 1):
        xp, xu = zp[rng.integers(len(zp), size=256)], zu[rng.integers(len(zu), size=512)]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ v[0] + v[1])
        s = _sigmoid(h @ v[2] + v[3][0])  # logistic loss: its gradient is s - 1 for +, s for -
        sp, su = s[: len(xp)], s[len(xp) :]
        g = np.empty(len(x))
        if prior is None:
            g[: len(xp)], g[len(xp) :] = (sp - 1) / len(xp), su / len(xu)
        else:
            loss = lambda q: -np.log(np.maximum(1 - q, 1e-12)).mean()
            if loss(su) - prior * loss(sp) >= 0:
                g[: len(xp)], g[len(xp) :] = (prior * (sp - 1) - prior * sp) / len(xp), su / len(xu)
            else:  # the negative part went below zero: step back along it
                g[: len(xp)], g[len(xp) :] = prior * sp / len(xp), -su / len(xu)
        gh = g[:, None] * v[2] * (1 - h * h)
        grads = [x.T @ gh + 1e-4 * v[0], gh.sum(axis=0), h.T @ g + 1e-4 * v[2], np.array([g.sum()])]
        for i, gr in enumerate(grads):
            m1[i] = 0.9 * m1[i] + 0.1 * gr
            m2[i] = 0.999 * m2[i] + 0.001 * gr * gr
            rate = 3e-3 * (1 - step / (rounds + 1))
            v[i] = v[i] - rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, v[0], v[1], v[2], float(v[3][0]), prior or 0.5)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """Share of positives among unlabelled rows: the least ratio of upper tail shares.

    Tails that hold less than ``least`` of the positives say too little and are
    left out; a slack for the sample size is added before the least is taken.
    """
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 200))
    tail = lambda s: 1 - np.searchsorted(np.sort(s), cuts, side="left") / len(s)
    p, u = tail(positive), tail(unlabelled)
    slack = np.sqrt(np.log(200) / 2) * (len(unlabelled) ** -0.5 + len(positive) ** -0.5)
    best = int(np.argmin((u + slack) / p))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def fit(positives: np.ndarray, unlabelled: np.ndarray, rounds: int = 1500, seed: int = 11) -> Model | None:
    """Prior from two halves (fit on one, measured on the other), then the network; None without rows."""
    if len(positives) < 2 or len(unlabelled) < 2:
        return None
    priors = []
    for half in (0, 1):
        first = _train(positives[half::2], unlabelled[half::2], None, rounds // 2, seed)
        priors.append(class_prior(first.margin(positives[1 - half :: 2]), first.margin(unlabelled[1 - half :: 2])))
    return _train(positives, unlabelled, float(np.mean(priors)), rounds, seed)


# --- operator ---------------------------------------------------------------------


def _feature_rows(texts: DataFrame) -> np.ndarray:
    """Features of a bounded sample of texts, in the order of their ids."""

    def per_batch(batches):
        for b in batches:
            for part in batches_of(b):
                yield pd.DataFrame({"key": part["key"], "x": [r.tobytes() for r in features(part["text"].tolist())]})

    rows = texts.mapInPandas(per_batch, "key long, x binary").collect()
    found = [np.frombuffer(x, np.float32) for _, x in sorted((r["key"], bytes(r["x"])) for r in rows)]
    return np.array(found) if found else np.zeros((0, 1), np.float32)


def train_model(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED,
) -> Model | None:
    """A model from the texts labelled 1 and the texts without a label.

    Both samples are the rows of smallest hash of the id. Where every text has
    a label, texts labelled 0 and 1 together stand for unlabelled ones. An id
    with several labels counts by its smallest; NULL labels and ids count as none.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).alias("label")).dropna()
    marked = marked.groupBy("key").agg(F.min("label").alias("label"))
    texts = id_and_text(docs, id_col, text_col)
    ids = texts.select("key").distinct()
    order = (F.xxhash64("key"), "key")
    positives = ids.join(marked.filter("label = 1"), "key", "left_semi").orderBy(*order).limit(max_positives)
    free = ids.join(marked, "key", "left_anti").orderBy(*order).limit(max_unlabelled)
    chosen = [[r[0] for r in part.collect()] for part in (positives, free)]  # bounded by the two limits
    if len(chosen[1]) < 2:
        chosen[1] = [r[0] for r in ids.orderBy(*order).limit(max_unlabelled).collect()]
    spark = docs.sparkSession
    rows = []
    for part in chosen:
        sample = spark.createDataFrame([(k,) for k in part], "key long")
        rows.append(_feature_rows(texts.join(F.broadcast(sample), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))))
    return fit(*rows)


def score_texts(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, score, columns in ``carry``): the score of each whole text, NULL texts as empty.

    Without a model every score is 0.5. Workers see texts a slice at a time and
    pass carried columns on as they came; a carried text is not sent twice.
    """
    carried = {c: f"carry_{i}" for i, c in enumerate(carry) if c != text_col}
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in carried.items()])
    kept_text = text_col in carry
    schema = T.StructType([f for f in rows.schema.fields if kept_text or f.name != "text"] + [T.StructField("score", T.DoubleType())])

    def per_batch(batches):
        for b in batches:
            for lo, hi in _slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                texts = [x or "" for x in part.column("text").to_pylist()]
                s = model.score(features(texts)) if model else np.full(hi - lo, 0.5)
                kept = [part.column(n) for n in schema.names[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(s)], names=schema.names)
            give_back()

    scored = rows.mapInArrow(per_batch, schema)
    names = carried | {text_col: "text"}
    return scored.select(F.col("key").alias(id_col), "score", *[F.col(names[c]).alias(c) for c in carry])


def _slices(texts: pa.Array):
    """Ranges of rows whose texts hold about SLICE_BYTES; a longer text is alone."""
    lo, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > lo and held + n > SLICE_BYTES:
            yield lo, i
            lo, held = i, 0
        held += n
    if len(texts) > lo:
        yield lo, len(texts)


def fold_zero(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Scores all documents with a model that learns outside fold zero of their ids.

    Returns one row per document: (id_col, held_out, score from 0 to 1,
    predicted = score >= cut, columns in ``carry``). NULL and empty texts are
    scored like any other; with no documents there are no rows.
    """
    model = train_model(docs.filter(~fold_zero(id_col)), labels.filter(~fold_zero(id_col)), id_col, text_col)
    scored = score_texts(docs, model, id_col, text_col, carry)
    return scored.select(
        id_col, fold_zero(id_col).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *carry
    )
