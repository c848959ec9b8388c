"""Queries over retrieval. The supplied tables of vectors and texts are unrelated: doc_id = vec_id is a synthetic pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.functions.text import ar_normalize
from inkmill.operators import retrieval as R
from inkmill.plans.base import query

TERM = "licensed"


def chunks_of(tables):
    docs = tables("documents").withColumnRenamed("doc_id", "chunk_id")
    vectors = tables("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return docs.join(vectors, "chunk_id").select("chunk_id", F.col("chunk_id").alias("document_id"), F.col("chunk_id").alias("revision_id"), "text", "embedding", "lang", F.col("source").alias("doc_type"), F.concat(F.lit("Document "), F.col("chunk_id")).alias("title"), F.col("source").alias("original_filename"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("").alias("section_path"))


def first_vector(tables):
    return list(tables("embeddings").filter("vec_id = 0").first()["embedding"])


COSINE = "(1 - list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))))"
VEC = f"vec AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank_vec FROM (SELECT e.vec_id AS id, {COSINE} AS d FROM embeddings e JOIN documents ON doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY d, id LIMIT 80))"
FTS = f"""fts AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS rank_fts FROM (SELECT doc_id AS id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: w = '{TERM}')) AS n
 FROM documents JOIN embeddings ON doc_id = vec_id WHERE contains(lower(text), '{TERM}')) WHERE n > 0 ORDER BY n DESC, id LIMIT 80)"""
FUSED = "fused AS (SELECT coalesce(v.id, f.id) AS id, coalesce(1.2 / (60 + rank_vec), 0) + coalesce(1.0 / (60 + rank_fts), 0) AS score, rank_vec, rank_fts FROM vec v FULL JOIN fts f ON v.id = f.id)"


@query("retrieval_hybrid_search", f"WITH {VEC}, {FTS}, {FUSED} SELECT id AS chunk_id, id AS document_id, 'Document ' || id AS document_title, 1 AS page_start, 1 AS page_end, '' AS section, substring(text, 1, 1200) AS text, round(score, 5) AS score FROM fused JOIN documents ON doc_id = id ORDER BY fused.score DESC, id LIMIT 8")
def hybrid(spark, tables):
    return R.format_hits(R.hybrid_search(chunks_of(tables), TERM, first_vector(tables)))


@query("retrieval_rank_fusion", f"WITH {VEC}, {FTS}, {FUSED} SELECT id AS chunk_id, rank_vec, rank_fts, round(score, 9) AS score FROM fused")
def fusion(spark, tables):
    chunks = chunks_of(tables)
    fused = R.fuse(R.dense(chunks, first_vector(tables)), R.lexical(chunks, TERM))
    return fused.select("chunk_id", "rank_vec", "rank_fts", F.round("score", 9).alias("score"))


@query("retrieval_dense", f"WITH {VEC} SELECT id AS chunk_id, rank_vec FROM vec")
def dense(spark, tables):
    return R.dense(chunks_of(tables), first_vector(tables)).select("chunk_id", "rank_vec")


@query("retrieval_knn_batch", f"SELECT query_id, chunk_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE}, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 5")
def knn(spark, tables):
    vectors = tables("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = vectors.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    return R.knn(vectors, queries, 5).select("query_id", "chunk_id", "rank")


@query("retrieval_phrase_and_not", r"""SELECT doc_id FROM documents JOIN embeddings ON doc_id = vec_id WHERE
 (regexp_matches(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), ' '), '(^| )under the( |$)') AND NOT list_contains(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), 'apache'))
 OR list_contains(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), 'mit')""")
def phrase(spark, tables):
    return R.matches(chunks_of(tables), '"under the" -apache or mit').select(F.col("chunk_id").alias("doc_id"))


@query("retrieval_empty_scope", "SELECT doc_id AS chunk_id, 0.0 AS score FROM documents WHERE false")
def empty_scope(spark, tables):
    return R.hybrid_search(chunks_of(tables), TERM, first_vector(tables), doc_ids=[]).select("chunk_id", F.col("score").cast("double").alias("score"))


TRI = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
PHRASE = "thst thereen onthe tion"


@query("retrieval_trigram_fallback", f"""WITH t AS (SELECT doc_id, {TRI.format('text')} AS a, {TRI.format(f"'{PHRASE}'")} AS b FROM documents)
SELECT doc_id AS chunk_id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS score FROM t""")
def trigram(spark, tables):
    score = R.similarity(R.trigrams(ar_normalize(F.col("text"))), R.trigrams(ar_normalize(F.lit(PHRASE))))
    return tables("documents").select(F.col("doc_id").alias("chunk_id"), F.round(score, 6).alias("score"))


@query("retrieval_neighbour_chunks", "SELECT c.conv_id, c.turn, h.turn AS hit_turn FROM conversations c JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'system' OR turn % 5 = 2) h ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 2")
def neighbours(spark, tables):
    turns = tables("conversations").select(F.col("conv_id").alias("revision_id"), F.col("turn").alias("chunk_index"), "role")
    near = R.neighbours(turns.drop("role"), turns.filter("role = 'system' OR chunk_index % 5 = 2"), 1, 2)
    return near.select(F.col("revision_id").alias("conv_id"), F.col("chunk_index").alias("turn"), F.col("hit_index").alias("hit_turn"))


@query("retrieval_postings", r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS word FROM t)
SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_chunks FROM p GROUP BY word""")
def postings(spark, tables):
    rows = R.postings(tables("documents").withColumnRenamed("doc_id", "chunk_id"))
    return rows.groupBy("word").agg(F.sum(F.size("places")).alias("n"), F.count("*").alias("n_chunks"))
