"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import filter_audit, hash_tree, hnsw, language_id, license_scan, line_quality, mixing, near_dedup, packing, sanitise, secret_scan, training_order, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_curriculum_mix(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words().alias("size"))
    return mixing.mix(docs)


def op3_line_quality(spark, sf_dir):
    q = line_quality.quality(_table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def op4_histogram_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_unigram_language(spark, sf_dir):
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op6_disclosure_sanitising(spark, sf_dir):
    return sanitise.find_personal_data(_table(spark, sf_dir, "documents")).drop("all", "fp1", "fp2")


def op7_license_scan(spark, sf_dir):
    return license_scan.scan_licences(_table(spark, sf_dir, "documents")).drop("expressions", "parsed", "accepted")


def op8_training_order(spark, sf_dir):
    return training_order.materialise(_table(spark, sf_dir, "documents"))


def op9_hnsw_neighbours(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings")
    return hnsw.nearest(v, v.filter(F.col("vec_id") % 20 == 0), k=20)


def op10_hash_tree_shards(spark, sf_dir):
    return hash_tree.shard_documents(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.encode_vectors(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents")).drop("blob")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_curriculum_mix, op3_line_quality, op4_histogram_packing, op5_unigram_language,
        op6_disclosure_sanitising, op7_license_scan, op8_training_order, op9_hnsw_neighbours, op10_hash_tree_shards,
        op11_vector_codes, op12_filter_audit, op13_secret_scan, pipeline,
    )
}

#: Exact links of all pairs that share a shingle, and what they reach.
_OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT p.a, p.b FROM pair p JOIN size x ON x.doc_id = p.a JOIN size y ON y.doc_id = p.b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN low l ON l.a = d.doc_id
"""


def _op11() -> str:
    """Product codes by comparing every part with every entry, round by round.
    Squared distances are exact: the inner products of the given vectors stay
    far below 2^53."""
    head = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), piece AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) AS x
  FROM (SELECT *, unnest(range(4)) AS p FROM kept)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM piece QUALIFY e < 256
)"""
    assign = """, at{r} AS MATERIALIZED (
  SELECT vec_id, label, piece.p, min(256 * CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) + e) AS de
  FROM piece JOIN book{r} ON book{r}.p = piece.p GROUP BY ALL
)"""
    retrain = """, mean{s} AS (
  SELECT p, e, list(floor(total / n) ORDER BY pos) AS c FROM (
    SELECT at{r}.p, de % 256 AS e, pos, sum(x[pos]) AS total, count(*) AS n
    FROM at{r} JOIN (SELECT *, unnest(range(1, len(x) + 1)) AS pos FROM piece) w ON w.vec_id = at{r}.vec_id AND w.p = at{r}.p
    GROUP BY ALL) GROUP BY p, e
), book{s} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{s} m ON m.p = b.p AND m.e = b.e
)"""
    rounds = "".join(assign.format(r=r) + retrain.format(r=r, s=r + 1) for r in range(4)) + assign.format(r=4)
    return head + rounds + """
, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', de % 256), '' ORDER BY p) AS code, CAST(sum(de // 256) AS BIGINT) AS error
  FROM at4 GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(x, ',' ORDER BY p, e, pos)) FROM (
    SELECT p, e, unnest(range(len(c))) AS pos, CAST(CAST(unnest(c) AS BIGINT) AS VARCHAR) AS x FROM book4)) AS codebooks_sha256
FROM coded"""


#: Every order of the filters applied to the counts of every set of failed ones.
_OP12 = r"""
WITH word AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), fails AS (
  SELECT doc_id, part, [
    len(w) < 50,
    100 * len(list_distinct(w)) < 65 * len(w),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f FROM word
), label AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id
), mask AS (
  SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM fails LEFT JOIN label ON label.doc_id = fails.doc_id GROUP BY part, f
), letter AS (SELECT unnest([1, 2, 3, 4, 5]) AS i
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), step AS (SELECT o, s, o[s] AS flt FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), seen AS (
  SELECT part, o, s, flt, f, n, good, toxic, f[flt] AS failing,
    len(list_filter(o[1:s - 1], lambda x: f[x])) > 0 AS gone,
    len(list_filter(f, lambda x: x)) = 1 AS single FROM mask, step
), total AS (
  SELECT part, o, s, flt,
    sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (NOT gone AND failing) AS removed,
    sum(n) FILTER (gone AND failing) AS redundant, sum(n) FILTER (single AND failing) AS unique_fails,
    sum(good) FILTER (NOT gone AND failing) AS good_lost, sum(toxic) FILTER (NOT gone AND failing) AS toxic_lost
  FROM seen GROUP BY part, o, s, flt
)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, s::INT AS step,
  coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, flt))::BIGINT AS shapley
FROM total
"""

SQL: dict[str, str] = {"op1_minhash_near_dedup": _OP1, "op11_vector_codes": _op11(), "op12_filter_audit": _OP12}
