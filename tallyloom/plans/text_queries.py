"""Text mining (T rows) on documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.core import spread, store_and_reload
from tallyloom.operators import classes as cl
from tallyloom.operators import text as tx
from tallyloom.plans.registry import query

LANGS = ["de", "en", "es", "fr"]
WORDS = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))"
STOP = rf"stop AS (SELECT DISTINCT word FROM (SELECT {WORDS} AS word FROM benchmark) WHERE length(word) <= 3)"
STEM = r"""CASE WHEN regexp_matches(word, '^(.{3,})ies$') THEN regexp_replace(word, '^(.{3,})ies$', '\1y')
  WHEN regexp_matches(word, '^(.{3,})(?:ing|eda|ed|es)$') THEN regexp_replace(word, '^(.{3,})(?:ing|eda|ed|es)$', '\1')
  WHEN regexp_matches(word, '^(.{3,})s$') THEN regexp_replace(word, '^(.{3,})s$', '\1') ELSE word END"""
TERMS = rf"""{STOP}, terms AS (SELECT source, {STEM} AS word, count(*) AS n FROM (SELECT source, {WORDS} AS word FROM documents)
  WHERE word NOT IN (SELECT word FROM stop) GROUP BY 1, 2)"""
TFIDF = f"""{TERMS}, w AS (SELECT source, word, n, n / sum(n) OVER (PARTITION BY source) AS tf,
  ln((SELECT count(DISTINCT source) FROM terms)::DOUBLE / count(*) OVER (PARTITION BY word)) AS idf FROM terms)"""
LANG_TERMS = f"lt AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, {WORDS} AS word FROM documents) GROUP BY 1, 2)"


def stop_words(t):
    words = tx.tokens(t.benchmark.select("text"), "text").filter(F.length("word") <= 3)
    return words.distinct()


def texts(t, key):
    return spread(t.documents.select(key, "text"))


def source_terms(t):
    return tx.class_terms(texts(t, "source"), "source", ["text"], stop_words(t))


def lang_terms(t):
    words = tx.tokens(texts(t, "lang"), "text")
    return words.groupBy("lang", "word").agg(F.count("*").alias("n"))


@query("T01_tokens", f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, {WORDS} AS word FROM documents) GROUP BY 1, 2")
def _(t):
    words = tx.tokens(texts(t, "doc_id"), "text")
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("T02_class_terms", f"WITH {TERMS} SELECT source, word, n FROM terms")
def _(t):
    return source_terms(t)


@query("T03_light_stem", f"SELECT DISTINCT word, {STEM} AS stem FROM (SELECT {WORDS} AS word FROM benchmark)")
def _(t):
    words = tx.tokens(t.benchmark.select("text"), "text").distinct()
    return words.withColumn("stem", tx.light_stem("word"))


@query("T04_tf_idf", f"WITH {TFIDF} SELECT source, word, n, round(tf, 10) AS tf, round(idf, 10) AS idf, round(tf * idf, 10) AS tf_idf FROM w")
def _(t):
    out = tx.tf_idf(source_terms(t), "source")
    return out.withColumns({c: F.round(c, 10) for c in ("tf", "idf", "tf_idf")})


@query(
    "T05_top_terms",
    f"""WITH {TFIDF} SELECT source, word, n, round(tf_idf, 10) AS tf_idf, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY tf_idf DESC, word) AS rank FROM (
            SELECT source, word, n, round(tf * idf, 12) AS tf_idf FROM w WHERE n >= 3)) WHERE rank <= 10""",
)
def top_terms_per_source(t):
    """Flagship: the ten most typical terms of each source."""
    weighted = tx.tf_idf(source_terms(t), "source").withColumn("tf_idf", F.round("tf_idf", 12))
    out = tx.top_terms(weighted, "source", 10, min_count=3)
    return out.select("source", "word", "n", F.round("tf_idf", 10).alias("tf_idf"), "rank")


@query(
    "T06_shared_terms",
    f"""WITH {LANG_TERMS}, s AS (SELECT lang, word, round(n / sum(n) OVER (PARTITION BY lang), 10) AS p FROM lt WHERE lang IN ('en', 'fr')),
        b AS (SELECT word, max(p) FILTER (lang = 'en') AS p_a, max(p) FILTER (lang = 'fr') AS p_b FROM s GROUP BY 1)
        SELECT word, p_a, p_b FROM b WHERE p_a IS NOT NULL AND p_b IS NOT NULL ORDER BY least(p_a, p_b) DESC, word LIMIT 15""",
)
def _(t):
    out = tx.shared_terms(lang_terms(t), "lang", "en", "fr", 15)
    return out.withColumns({c: F.round(c, 10) for c in ("p_a", "p_b")})


@query(
    "T06_separating_terms",
    f"""WITH {LANG_TERMS}, w AS (SELECT lang, word, n, n / sum(n) OVER (PARTITION BY lang) AS tf, ln(2.0::DOUBLE / count(*) OVER (PARTITION BY word)) AS idf
          FROM lt WHERE lang IN ('de', 'es'))
        SELECT lang, word, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY tf * idf DESC, word) AS INTEGER) AS rank, round(tf * idf, 10) AS tf_idf
        FROM w QUALIFY rank <= 10""",
)
def _(t):
    out = tx.separating_terms(lang_terms(t), "lang", "de", "es", 10)
    return out.select("lang", "word", "n", "rank", F.round("tf_idf", 10).alias("tf_idf"))


@query(
    "T07_word_rating",
    f"""SELECT word, count(*) AS n, round(avg(quality), 8) AS rating FROM (SELECT quality, {WORDS} AS word FROM documents JOIN labels USING (doc_id))
        GROUP BY 1 HAVING count(*) >= 20""",
)
def _(t):
    rated = texts(t, "doc_id").join(t.labels.select("doc_id", "quality"), "doc_id")
    out = tx.word_ratings(tx.tokens(rated, "text"), "quality", 20)
    return out.withColumn("rating", F.round("rating", 8))


DOC_TERMS = f"""dt AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, {WORDS} AS word FROM documents) GROUP BY 1, 2),
  v AS (SELECT word FROM dt GROUP BY 1 HAVING sum(n) >= 200)"""


@query("T08_document_terms", f"WITH {DOC_TERMS} SELECT doc_id, word, n FROM dt WHERE word IN (SELECT word FROM v)")
def _(t):
    return tx.document_terms(tx.tokens(texts(t, "doc_id"), "text"), "doc_id", 200)


@query(
    "T08_sparse_rows",
    f"""WITH {DOC_TERMS}, i AS (SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS term_id FROM v)
        SELECT doc_id, list(term_id ORDER BY term_id) AS ids, list(n::DOUBLE ORDER BY term_id) AS counts FROM dt JOIN i USING (word) GROUP BY 1""",
)
def _(t):
    counts = tx.document_terms(tx.tokens(texts(t, "doc_id"), "text"), "doc_id", 200)
    return tx.sparse_rows(counts, "doc_id")


@query(
    "T09_feature_rows",
    """WITH f AS (SELECT p_partkey, 'p_brand: ' || p_brand AS feature FROM part UNION ALL SELECT p_partkey, 'p_type: ' || p_type FROM part
         UNION ALL SELECT p_partkey, 'p_size: ' || p_size FROM part UNION ALL SELECT p_partkey, 'p_name: ' || unnest(string_split(p_name, ' ')) FROM part),
         g AS (SELECT p_partkey, feature, count(*) AS n FROM f GROUP BY 1, 2)
       SELECT *, count(*) OVER (PARTITION BY feature) AS support FROM g QUALIFY support >= 35""",
)
def _(t):
    return tx.feature_rows(t.part, "p_partkey", ["p_brand", "p_type", "p_size", "p_name"], " ", 35)


LANG_SHARES = f"""{LANG_TERMS}, s AS (SELECT lang, word, p FROM (SELECT lang, word, n, n / sum(n) OVER (PARTITION BY lang) AS p FROM lt) WHERE n >= 5),
  voc AS (SELECT word, coalesce(max(p) FILTER (lang = 'de'), 0) AS de, coalesce(max(p) FILTER (lang = 'en'), 0) AS en,
            coalesce(max(p) FILTER (lang = 'es'), 0) AS es, coalesce(max(p) FILTER (lang = 'fr'), 0) AS fr FROM s GROUP BY 1)"""
PAIRS = [(a, b) for i, a in enumerate(LANGS) for b in LANGS[i + 1 :]]


@query(
    "T10_class_correlation",
    f"WITH {LANG_SHARES} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS class_a, '{b}' AS class_b, round(corr({a}, {b}), 8) AS correlation FROM voc" for a, b in PAIRS
    ),
)
def _(t):
    shares = tx.class_shares(lang_terms(t), "lang", 5)
    return tx.class_correlation(shares, "lang", LANGS).withColumn("correlation", F.round("correlation", 8))


@query(
    "T11_class_distance",
    f"WITH {LANG_SHARES} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS class_a, '{b}' AS class_b, round(sqrt(sum(pow({a} - {b}, 2))), 8) AS distance FROM voc" for a, b in PAIRS
    ),
)
def _(t):
    shares = tx.class_shares(lang_terms(t), "lang", 5)
    return tx.class_distance(shares, "lang", LANGS).withColumn("distance", F.round("distance", 8))


def source_gram(t):
    """Term shares of the sources over the whole vocabulary, and their products."""
    shares = store_and_reload(tx.class_shares(source_terms(t), "source", 1), "source-shares")
    return shares, store_and_reload(cl.class_gram(shares, "source"), "source-gram")


SOURCE_GRAM = f"""{TERMS}, sh AS (SELECT source, word, n / sum(n) OVER (PARTITION BY source) AS p FROM terms),
  gm AS (SELECT a.source AS class_a, b.source AS class_b, sum(a.p * b.p) AS dot FROM sh a JOIN sh b USING (word) GROUP BY 1, 2)"""


@query("T12_class_gram", f"WITH {SOURCE_GRAM} SELECT class_a, class_b, round(dot, 12) AS dot FROM gm WHERE class_a <= class_b")
def _(t):
    return source_gram(t)[1].withColumn("dot", F.round("dot", 12))


@query("T12_group_classes")
def _(t):
    return cl.ward_groups(source_gram(t)[1], 4).withColumnRenamed("class", "source")


@query(
    "T13_centred_matrix",
    f"""WITH {SOURCE_GRAM}, sm AS (SELECT source AS c, sum(p) AS s, sum(p * p) AS q FROM sh GROUP BY 1), v AS (SELECT count(DISTINCT word) AS v FROM sh),
        d AS (SELECT class_a, class_b, CASE WHEN class_a = class_b THEN 0 ELSE 1 - (v * dot - a.s * b.s) / sqrt((v * a.q - a.s * a.s) * (v * b.q - b.s * b.s)) END AS d
              FROM gm, v, sm a, sm b WHERE a.c = class_a AND b.c = class_b)
        SELECT class_a, class_b, round(-(d * d - avg(d * d) OVER (PARTITION BY class_a) - avg(d * d) OVER (PARTITION BY class_b) + avg(d * d) OVER ()) / 2, 8) AS v FROM d""",
)
def _(t):
    shares, gram = source_gram(t)
    out = cl.centred_matrix(cl.class_dissimilarity(gram, shares, "source"))
    return out.withColumn("v", F.round("v", 8))


@query("T13_map_classes")
def _(t):
    shares, gram = source_gram(t)
    out = cl.map_classes(cl.class_dissimilarity(gram, shares, "source"), 3)
    return out.select(F.col("class").alias("source"), *[F.round(F.get("coords", i), 6).alias(f"axis_{i + 1}") for i in range(3)])
