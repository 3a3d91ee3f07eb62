"""The named queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokens, count_links
from .decontamination import benchmark_matches
from .language import fit_languages, predict_language
from .licenses import scan_licenses
from .mining import hard_negatives
from .mixing import mix_sources
from .neighbours import nearest
from .ngram_join import ngram_components
from .quality import fit_quality, score_quality
from .scoring import score_texts
from .sharding import shard_by_tree
from .sketches import near_copies
from .tokens import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def fold() -> Column:
    """0 to 4: crc32 of the id as text, by which queries hold rows out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


@query("op1_ngram_join", """
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON l.a = r.b) SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
       (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id
""")
def op1(spark: SparkSession, root: str) -> DataFrame:
    return ngram_components(table(spark, root, "documents"), width=3, percent=90)


@query("op2_lm_scores")
def op2(spark: SparkSession, root: str) -> DataFrame:
    found = score_texts(table(spark, root, "documents"), fold() != 1)
    return found.select("doc_id", (F.coalesce(fold(), F.lit(0)) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_decontamination")
def op3(spark: SparkSession, root: str) -> DataFrame:
    return benchmark_matches(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query("op4_token_counts")
def op4(spark: SparkSession, root: str) -> DataFrame:
    return count_tokens(table(spark, root, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query("op5_mix_sources")
def op5(spark: SparkSession, root: str) -> DataFrame:
    return mix_sources(table(spark, root, "documents"), repetition_limit=2.0)


@query("op6_shard_tree")
def op6(spark: SparkSession, root: str) -> DataFrame:
    return shard_by_tree(table(spark, root, "documents"), shards=40)


@query("op7_neighbours")
def op7(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    return nearest(rows, rows.filter("vec_id % 50 = 0"), top=5)


@query("op8_language_id")
def op8(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    found = predict_language(docs, fit_languages(docs.filter(fold() != 0)))
    return found.select("doc_id", (F.coalesce(fold(), F.lit(1)) == 0).alias("held_out"), "lang_pred", "score")


@query("op9_license_scan")
def op9(spark: SparkSession, root: str) -> DataFrame:
    return scan_licenses(table(spark, root, "documents"))


@query("op10_quality")
def op10(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    model = fit_quality(table(spark, root, "labels").filter(fold() != 0), docs)
    found = score_quality(docs, model)
    return found.select("doc_id", (F.coalesce(fold(), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op11_near_copies", """
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON l.a = r.b) SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id
""")
def op11(spark: SparkSession, root: str) -> DataFrame:
    return near_copies(table(spark, root, "documents"), width=4, percent=80)


@query("op12_hard_negatives", """
WITH c AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label AS other, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
      FROM c a JOIN c b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE own = other
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (anchor_id) WHERE own <> other AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""")
def op12(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, least=30, most=90, scale=256)


@query("op13_token_alignment")
def op13(spark: SparkSession, root: str) -> DataFrame:
    aligned = align_tokens(table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.encode("groups", "UTF-8"), 256))
    return count_links(aligned.withColumn("groups_sha256", digest).drop("groups"))
