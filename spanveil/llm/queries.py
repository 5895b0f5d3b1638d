"""Registered queries of this package, each over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.audit import filter_audit
from spanveil.llm.extract import extract_text
from spanveil.llm.fingerprints import neighbours
from spanveil.llm.leaks import contamination
from spanveil.llm.lines import dedup_lines
from spanveil.llm.neardup import near_duplicates
from spanveil.llm.negatives import hard_negatives
from spanveil.llm.quality import fold_of, score_quality, train
from spanveil.llm.substrings import dedup_substrings
from spanveil.llm.tables import benchmark, documents, embeddings, labels, pages
from spanveil.llm import brown, toxicity
from spanveil.llm.tokens import count_tokens, round_trip

WORD_BPE = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_quality(docs, train(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(documents(spark, sf_dir))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(fold_of("doc_id", 7) == 2, F.lit(True))
    scored = brown.score(docs, brown.train(docs, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=4)


def op8_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), benchmark(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(pages(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("if(vec_id % 7 = 0, (cast(label AS long) + 1) % 10, label)")
    return hard_negatives(embeddings(spark, sf_dir), "vec_id % 50 = 0", label=label)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), labels(spark, sf_dir))


# Windows are compared as word lists joined by a blank, which no word holds.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM item
), places AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size
), hit AS (
  SELECT doc_id, i, p.size, item_id FROM places p JOIN item t ON t.size = p.size AND t.run = array_to_string(w[i:i + p.size - 1], ' ')
), words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingle a JOIN shingle b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b
), least_id AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), later AS (
  SELECT doc_id, i FROM places JOIN (SELECT run, min(doc_id) AS least FROM places GROUP BY run) USING (run) WHERE doc_id > least
), gone AS (
  SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM later) GROUP BY doc_id
), kept AS (
  SELECT doc_id, w, coalesce(len(ks), 0) AS n_removed,
    CASE WHEN ks IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k)), lambda k: w[k]) END AS words
  FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(words, ' '), '')) AS kept_sha256
FROM kept
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\n]+') AS l FROM documents
), places AS (
  SELECT doc_id, i, array_to_string(l[i:i + 2], chr(10)) AS run
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS n FROM places) WHERE n > 1
), gone AS (
  SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM later) GROUP BY doc_id
)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ks IS NULL THEN coalesce(text, '') ELSE coalesce(array_to_string(
    list_transform(list_filter(range(1, len(l) + 1), lambda k: NOT list_contains(ks, k)), lambda k: l[k]), chr(10)), '') END) AS text_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

# For the markup of the given pages: what stands in their article element; blocks part by any tag but b.
OP11_SQL = r"""
WITH p AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1),
    '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages
), d AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '),
    '&amp;?', '&', 'g') AS t FROM p
), w AS (
  SELECT page_id, url, trim(regexp_replace(t, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'), ' ') AS text FROM d
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM w
"""

# All pairs of an anchor and a row are scored.
OP12_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positive JOIN scored USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
) WHERE rank <= 3
"""

# One row per document with its failures; all orders by joining prefixes and letters.
OP13_SQL = r"""
WITH RECURSIVE marks AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), doc AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN marks USING (doc_id)
), cell AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM doc GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), prefix AS (
  SELECT '' AS p UNION ALL SELECT p || l FROM prefix JOIN letter ON NOT contains(p, l)
), steps AS (
  SELECT p AS filter_order, s AS step, p[s] AS l, p[1:s - 1] AS earlier
  FROM (SELECT p, unnest(range(1, 6)) AS s FROM prefix WHERE len(p) = 5)
), judged AS (
  SELECT part, filter_order, step, l, n, good, toxic, fails, contains(fails, l) AS hit,
    earlier <> '' AND fails <> '' AND len(list_intersect(string_split(earlier, ''), string_split(fails, ''))) > 0 AS gone
  FROM (SELECT part, fails, n, good, toxic FROM cell), steps
), counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, l,
    CAST(sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = l THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM counted
"""

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_spotsigs": op4_spotsigs,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_brown": op6_brown,
    "op7_minhash": op7_minhash,
    "op8_suffix_trees": op8_suffix_trees,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_html_extraction": op11_html_extraction,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}

# Queries that DuckDB can express over the same tables.
ORACLES: dict[str, str] = {
    "op7_minhash": OP7_SQL,
    "op8_suffix_trees": OP8_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_html_extraction": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
