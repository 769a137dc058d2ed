"""One query per operator over its whole table, next to its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tallyloom.core import Tables
from tallyloom.llm import (
    ann,
    audit,
    collocations,
    contamination,
    licenses,
    lines,
    mix,
    near,
    packing,
    quality,
    spans,
    suffixes,
    topk,
)
from tallyloom.llm.registry import LLM, query  # noqa: F401


@query(
    "op3_exact_top_k",
    """
    WITH t AS (
        SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
          AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM t q JOIN t c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
)
def op3_exact_top_k(t: Tables):
    return topk.exact_top_k(t.embeddings, t.embeddings.filter("vec_id % 100 = 0"))


@query("op6_small_world_neighbours")
def op6_small_world_neighbours(t: Tables):
    return ann.nearest(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"))


@query(
    "op7_line_dedup",
    r"""
    WITH l AS (
        SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
    ), k AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
    ), c AS (
        SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3
    ), j AS (SELECT k.*, coalesce(c.last <> k.doc_id, false) AS dropped FROM k LEFT JOIN c USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM j GROUP BY doc_id
    """,
)
def op7_line_dedup(t: Tables):
    kept = lines.drop_repeated_lines(t.documents)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op8_best_fit_packing")
def op8_best_fit_packing(t: Tables):
    return packing.pack_documents(t.documents, public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_quality_classifier")
def op2_quality_classifier(t: Tables):
    return quality.score_quality(t.documents, t.labels)


@query("op1_source_mix")
def op1_source_mix(t: Tables):
    return mix.mix_sources(t.documents).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_near_duplicates")
def op5_near_duplicates(t: Tables):
    return near.near_duplicate_classes(t.documents)


@query("op9_sentence_spans")
def op9_sentence_spans(t: Tables):
    return spans.drop_repeated_spans(t.documents, tails=True)


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(t: Tables):
    kept = suffixes.drop_repeated_bytes(t.documents)
    return kept.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op4_license_scan")
def op4_license_scan(t: Tables):
    return licenses.scan_licenses(t.documents, licenses.notices(t.spark))


@query(
    "op11_filter_audit",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), m AS (
        SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
               + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x))::INT + 8 * regexp_matches(x, '[#$%&*|]')::INT
               + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)::INT AS fails FROM d
    ), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
    c AS (
        SELECT part, fails, count(*) AS n, count(*) FILTER (good = 1) AS n_good, count(*) FILTER (toxic = 1) AS n_toxic
        FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2
    ), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    o AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e
        WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
    ), s AS (
        SELECT o, s, 1 << (ascii(substr(o, s, 1)) - 65) AS own,
               coalesce(list_sum([1 << (ascii(substr(o, i, 1)) - 65) FOR i IN range(1, s)]), 0)::INT AS before
        FROM o, (SELECT unnest(range(1, 6)) AS s)
    ), r AS (
        SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, own,
               sum(CASE WHEN fails & (own | before) = 0 THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN fails & own > 0 AND fails & before = 0 THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN fails & own > 0 AND fails & before > 0 THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN fails & own > 0 AND fails & before = 0 THEN n_good ELSE 0 END) AS good_lost,
               sum(CASE WHEN fails & own > 0 AND fails & before = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
        FROM c, s GROUP BY 1, 2, 3, 4
    )
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM r
    """,
)
def op11_filter_audit(t: Tables):
    return audit.filter_audit(t.documents, t.labels)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op12_benchmark_decontamination",
    rf"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
    k AS (
        SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[p:p + 9], ' ') AS k
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
    ), p AS (
        SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS k
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM k))
    ), h AS (SELECT doc_id, m, p, item FROM p JOIN k USING (k, m)),
    n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY 1),
    s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
    """,
)
def op12_benchmark_decontamination(t: Tables):
    found = contamination.find_contamination(t.documents, t.benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {m} AS m, array_to_string(w[i:i + {m - 1}], ' ') AS phrase, count(*) AS a"
    f" FROM (SELECT lang, w, unnest(range(1, len(w) - {m} + 2)) AS i FROM p) GROUP BY 1, 2, 3 HAVING count(*) >= 100"
    for m in range(1, 6)
)


@query(
    "op13_phrase_collocations",
    rf"""
    WITH x AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents
    ), p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM x),
    n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY 1),
    f AS MATERIALIZED ({_GRAMS}),
    o AS (
        SELECT * FROM f WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = f.lang AND g.m > f.m AND g.a >= f.a
            AND contains(' ' || g.phrase || ' ', ' ' || f.phrase || ' '))
    ), c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM o),
    s AS (
        SELECT c.lang, c.phrase, k, c.a, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
        FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:c.m], ' ') JOIN n ON n.lang = c.lang
    ), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
           a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM b QUALIFY rank <= 2000
    """,
)
def op13_phrase_collocations(t: Tables):
    return collocations.collocations(t.documents).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
