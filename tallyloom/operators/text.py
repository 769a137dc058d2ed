"""Text mining: tokens, stems, TF-IDF, document-term features, class similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import store_and_reload, with_group_totals
from tallyloom.operators.relational import top_per_group
from tallyloom.operators.sequence import sequence_columns

# A token is a run of letters or digits.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# Plural and ending rules of the light stemmer, tried in order.
STEM_RULES = [
    (r"(.{3,})ies$", "$1y"),
    (r"(.{3,})(?:ing|eda|ed|es)$", "$1"),
    (r"(.{3,})s$", "$1"),
]


def tokens(df: DataFrame, text: str, name: str = "word", pattern: str = TOKEN_PATTERN) -> DataFrame:
    """One row per lower-case token of the whole text."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)
    return df.withColumn(name, F.explode(found)).drop(text)


def light_stem(c: str | Column) -> Column:
    """Strip the first suffix that matches; other words stay as they are."""
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for pattern, repl in STEM_RULES:
        cond, value = c.rlike(f"^{pattern}"), F.regexp_replace(c, f"^{pattern}", repl)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(c)


def class_terms(
    df: DataFrame, class_col: str, texts: Sequence[str], stop_words: DataFrame, stem: bool = True
) -> DataFrame:
    """Counts of stemmed terms per class, stop words removed.

    Tokens are counted per class before stop words and stems are applied, so
    the join and the stemmer see distinct terms instead of running text.
    """
    joined = df.select(class_col, F.concat_ws(" ", *texts).alias("__t"))
    counts = tokens(joined, "__t").groupBy(class_col, "word").agg(F.count("*").alias("n"))
    kept = counts.join(stop_words.select("word"), "word", "left_anti")
    if stem:
        kept = kept.withColumn("word", light_stem("word"))
        kept = kept.groupBy(class_col, "word").agg(F.sum("n").alias("n"))
    return kept.select(class_col, "word", "n")


def tf_idf(counts: DataFrame, doc: str, term: str = "word", n: str = "n") -> DataFrame:
    """tf = n / total of the document, idf = ln(documents / documents with term).

    ``counts`` has one row per document and term. Document totals and document
    frequencies are aggregates of it, joined back so that neither a long
    document nor a common term is gathered in one task. The counts are stored
    first, so the text behind them is tokenised once.
    """
    counts = store_and_reload(counts, "term-counts")
    totals = counts.groupBy(doc).agg(F.sum(n).alias("__t"))
    frequency = counts.groupBy(term).agg(F.count("*").alias("__df"))
    n_docs = totals.agg(F.count("*")).scalar()
    both = counts.join(totals, doc).join(frequency, term)
    return both.withColumns(
        {"tf": F.col(n) / F.col("__t"), "idf": F.ln(n_docs / F.col("__df"))}
    ).withColumn("tf_idf", F.col("tf") * F.col("idf")).select(*counts.columns, "tf", "idf", "tf_idf")


def top_terms(weighted: DataFrame, doc: str, k: int, min_count: int = 1, term: str = "word") -> DataFrame:
    """k terms with the highest weight per class, by weight then term."""
    frequent = weighted.filter(F.col("n") >= min_count)
    best = top_per_group(frequent, [doc], [F.desc("tf_idf"), F.asc(term)], k)
    w = Window.partitionBy(doc).orderBy(F.desc("tf_idf"), F.asc(term))
    return best.withColumn("rank", F.row_number().over(w))


def shared_terms(counts: DataFrame, class_col: str, a: str, b: str, k: int) -> DataFrame:
    """Terms both classes use, by their smaller share of the class total."""
    two = store_and_reload(counts.filter(F.col(class_col).isin(a, b)), "term-counts")
    shares = with_group_totals(two, [class_col], F.sum("n").alias("__t"))
    shares = shares.withColumn("p", F.col("n") / F.col("__t"))
    both = shares.groupBy("word").agg(
        F.max(F.when(F.col(class_col) == a, F.col("p"))).alias("p_a"),
        F.max(F.when(F.col(class_col) == b, F.col("p"))).alias("p_b"),
    )
    return (
        both.filter("p_a IS NOT NULL AND p_b IS NOT NULL")
        .orderBy(F.desc(F.least("p_a", "p_b")), F.asc("word"))
        .limit(k)
    )


def separating_terms(counts: DataFrame, class_col: str, a: str, b: str, k: int) -> DataFrame:
    """Terms that set two classes apart: TF-IDF over just those two."""
    return top_terms(tf_idf(counts.filter(F.col(class_col).isin(a, b)), class_col), class_col, k)


def word_ratings(words: DataFrame, rating: str, min_support: int) -> DataFrame:
    """Support and mean rating per word."""
    return (
        words.groupBy("word")
        .agg(F.count("*").alias("n"), F.avg(rating).alias("rating"))
        .filter(F.col("n") >= min_support)
    )


def document_terms(words: DataFrame, doc: str, min_total: int, term: str = "word") -> DataFrame:
    """Counts per document of the terms with enough occurrences overall."""
    counts = store_and_reload(words.groupBy(doc, term).agg(F.count("*").alias("n")), "document-terms")
    frequent = counts.groupBy(term).agg(F.sum("n").alias("__t")).filter(F.col("__t") >= min_total)
    # stored, so that Spark knows its size and leaves the counts where they are if it is small
    frequent = store_and_reload(frequent.select(term), "frequent-terms")
    return counts.join(frequent, term, "left_semi").select(doc, term, "n")


def term_ids(counts: DataFrame, term: str = "word") -> DataFrame:
    """0-based ids of the sorted vocabulary."""
    ids = sequence_columns(counts.select(term).distinct(), [], [term], position="__p")
    return ids.select(term, (F.col("__p") - 1).cast("int").alias("term_id"))


def sparse_rows(counts: DataFrame, doc: str, term: str = "word") -> DataFrame:
    """Document rows as a sorted sparse representation (ids and counts)."""
    coded = counts.join(store_and_reload(term_ids(counts, term), "term-ids"), term)
    cells = coded.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("term_id", "n"))).alias("__c"))
    return cells.select(
        doc,
        F.transform("__c", lambda c: c["term_id"]).alias("ids"),
        F.transform("__c", lambda c: c["n"].cast("double")).alias("counts"),
    )


def feature_rows(
    df: DataFrame, key: str, columns: Sequence[str], pattern: str | None, min_support: int, words: DataFrame | None = None
) -> DataFrame:
    """``column: value`` features of any columns, with enough support.

    Multi-valued cells are split; optional ``words`` (key, word) rows join the
    same feature table as ``word: ...``.
    """
    typed = df.select(key, *[F.col(c).cast("string").alias(c) for c in columns])
    long = typed.unpivot(key, list(columns), "type", "value").filter("value IS NOT NULL")
    if pattern:
        long = long.withColumn("value", F.explode(F.split("value", pattern)))
    feats = long.select(key, F.concat_ws(": ", "type", "value").alias("feature"))
    if words is not None:
        feats = feats.unionByName(words.select(key, F.concat(F.lit("word: "), "word").alias("feature")))
    feats = store_and_reload(feats.groupBy(key, "feature").agg(F.count("*").alias("n")), "features")
    support = feats.groupBy("feature").agg(F.count("*").alias("support")).filter(F.col("support") >= min_support)
    return feats.join(support, "feature").select(key, "feature", "n", "support")


def count_vectors(df: DataFrame, text: str, vocabulary: DataFrame, name: str = "features") -> DataFrame:
    """Sparse term-count vectors over a vocabulary (term_id, word), no shuffle.

    The vocabulary holds only terms above a minimum count; like the
    coefficients of a model over it, it has to fit the driver.
    """
    words = [r["word"] for r in vocabulary.orderBy("term_id").select("word").collect()]
    model = CountVectorizerModel.from_vocabulary(words, inputCol="__w", outputCol=name)
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)
    return model.transform(df.withColumn("__w", found)).drop("__w", text)


# --- similarity of classes ----------------------------------------------------------


def class_shares(counts: DataFrame, class_col: str, min_count: int) -> DataFrame:
    """Share of each term in its class; rare terms are dropped afterwards."""
    stored = store_and_reload(counts, "term-counts")
    totals = with_group_totals(stored, [class_col], F.sum("n").alias("__t"))
    return totals.filter(F.col("n") >= min_count).select(
        class_col, "word", (F.col("n") / F.col("__t")).alias("p")
    )


def wide_shares(shares: DataFrame, class_col: str, classes: Sequence[str]) -> DataFrame:
    """One row per term and one column per class; absent shares are 0."""
    return shares.groupBy("word").pivot(class_col, list(classes)).agg(F.first("p")).na.fill(0.0)


def _pairs_to_rows(row: DataFrame, classes: Sequence[str], name: str) -> DataFrame:
    k = len(classes)
    items = F.array(
        *[
            F.struct(F.lit(classes[i]).alias("class_a"), F.lit(classes[j]).alias("class_b"),
                     F.col(f"v{i}_{j}").alias(name))
            for i in range(k)
            for j in range(i + 1, k)
        ]
    )
    return row.select(F.explode(items).alias("s")).select("s.*")


def class_correlation(shares: DataFrame, class_col: str, classes: Sequence[str]) -> DataFrame:
    """Correlation of term shares for all pairs of listed classes.

    One aggregation over the vocabulary computes all pairs; no pair rows of
    the data are built. Terms absent from a class count as zero.
    """
    wide = wide_shares(shares, class_col, classes)
    k = len(classes)
    aggs = [
        F.corr(classes[i], classes[j]).alias(f"v{i}_{j}") for i in range(k) for j in range(i + 1, k)
    ]
    return _pairs_to_rows(wide.agg(*aggs), classes, "correlation")


def class_distance(shares: DataFrame, class_col: str, classes: Sequence[str]) -> DataFrame:
    """Euclidean distance of the share vectors for all pairs of listed classes."""
    wide = wide_shares(shares, class_col, classes)
    k = len(classes)
    sq = lambda i, j: F.pow(F.col(classes[i]) - F.col(classes[j]), F.lit(2.0))
    aggs = [
        F.sqrt(F.sum(sq(i, j))).alias(f"v{i}_{j}") for i in range(k) for j in range(i + 1, k)
    ]
    return _pairs_to_rows(wide.agg(*aggs), classes, "distance")


def unit_rows(df: DataFrame, array: str, out: str) -> DataFrame:
    """Rows centred to mean 0 and scaled to length 1, as ML vectors.

    The squared distance of two such rows is 2 * (1 - correlation).
    """
    a = F.col(array).cast("array<double>")
    mean = F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    centred = df.withColumn("__m", mean).withColumn(
        "__v", array_to_vector(F.transform(a, lambda x: x - F.col("__m")))
    )
    return Normalizer(p=2.0, inputCol="__v", outputCol=out).transform(centred).drop("__m", "__v")
