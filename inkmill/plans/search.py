"""Queries over the indexes: approximate neighbours, words with places, trigrams, and hybrid search on all three."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.operators import ann
from inkmill.operators import retrieval as R
from inkmill.operators import textindex as X
from inkmill.plans.base import ORACLE_SQL, QUERIES, query
from inkmill.plans.retrieval import COSINE, PHRASE, TERM, TRI, chunks_of, first_vector
from inkmill.session import shared_folder

__all__ = ["ORACLE_SQL", "QUERIES"]

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')"


def vectors_of(tables):
    return tables("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


@query("retrieval_ann")
def neighbours(spark, tables):
    """Ten answers for every twentieth vector; tests hold them against exact ones."""
    vectors = vectors_of(tables)
    index = ann.build(vectors, shared_folder(spark), ["label"])
    return ann.search_all(index, vectors.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), 10).select("query_id", "chunk_id", "rank")


@query("retrieval_ann_filtered", f"SELECT e.vec_id AS chunk_id, row_number() OVER (ORDER BY {COSINE}, e.vec_id)::INTEGER AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label % 2 = 1 ORDER BY {COSINE}, e.vec_id LIMIT 20")
def filtered(spark, tables):
    """In exact mode, over a filter: cells are read until none can hold a nearer vector."""
    index = ann.build(vectors_of(tables), shared_folder(spark), ["label"])
    found = ann.search(index, first_vector(tables), 20, where=F.col("label") % 2 == 1, exact=True)
    return spark.createDataFrame([(i, n) for n, (i, _) in enumerate(found, 1)], "chunk_id long, rank int")


#: Queries of all kinds, and the test that SQL puts to a document's words w (joined by blanks: s).
KINDS = {
    "licensed": "list_contains(w, 'licensed')",
    "the of": "list_contains(w, 'the') AND list_contains(w, 'of')",
    '"under the"': "contains(s, ' under the ')",
    "licensed -apache": "list_contains(w, 'licensed') AND NOT list_contains(w, 'apache')",
    "apache or mit": "list_contains(w, 'apache') OR list_contains(w, 'mit')",
    '"under the" -apache or mit': "(contains(s, ' under the ') AND NOT list_contains(w, 'apache')) OR list_contains(w, 'mit')",
    'the -"of the"': "list_contains(w, 'the') AND NOT contains(s, ' of the ')",
    "the and of -licensed": "list_contains(w, 'the') AND list_contains(w, 'and') AND list_contains(w, 'of') AND NOT list_contains(w, 'licensed')",
    '"the of" or "of the" or nosuchword': "contains(s, ' the of ') OR contains(s, ' of the ')",
    "nosuchword the": "false",
}


@query("retrieval_index_matches", "WITH d AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM (SELECT doc_id, " + WORDS + " AS w FROM documents)) " + " UNION ALL ".join(f"SELECT {n} AS kind, doc_id AS chunk_id FROM d WHERE {test}" for n, test in enumerate(KINDS.values())))
def matches(spark, tables):
    """All documents that match each of ten queries, from the index."""
    docs = tables("documents").select(F.col("doc_id").alias("chunk_id"), "text")
    index, n, out = X.build_words(docs, shared_folder(spark)), docs.count(), None
    for kind, text in enumerate(KINDS):
        found = X.search_words(index, text, n).select(F.lit(kind).alias("kind"), "chunk_id")
        out = found if out is None else out.unionByName(found)
    return out


@query("retrieval_index_search", f"SELECT id AS chunk_id, row_number() OVER (ORDER BY n DESC, id)::INTEGER AS rank_fts, round(n / 10.0, 6) AS density FROM (SELECT doc_id AS id, len(list_filter({WORDS}, lambda w: w = 'the')) AS n FROM documents) WHERE n > 0 ORDER BY n DESC, id LIMIT 80")
def best_of_word(spark, tables):
    """The best documents for a frequent word; blocks that cannot hold one are not read."""
    index = X.build_words(tables("documents").select(F.col("doc_id").alias("chunk_id"), "text"), shared_folder(spark))
    return X.search_words(index, "the", first=8).select("chunk_id", "rank_fts", F.round("density", 6).alias("density"))


@query("retrieval_trigram_index", f"""WITH l AS (SELECT doc_id * 100000 + i AS chunk_id, string_split(text, chr(10))[i + 1] AS text FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
t AS (SELECT chunk_id, {TRI.format('text')} AS a, {TRI.format(f"'{PHRASE}'")} AS b FROM l WHERE text <> ''), r AS (SELECT chunk_id, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS s FROM t)
SELECT chunk_id, round(s, 6) AS score FROM r WHERE s > 0.25 ORDER BY s DESC, chunk_id LIMIT 20""")
def by_trigrams(spark, tables):
    """The most similar lines of all documents; few of them are compared in full."""
    lines = tables("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    index = X.build_trigrams(lines.select((F.col("doc_id") * 100000 + F.col("i")).alias("chunk_id"), "text"), shared_folder(spark))
    return X.search_trigrams(index, PHRASE, 20).select("chunk_id", F.round("score", 6).alias("score"))


@query("retrieval_indexed_hybrid", ORACLE_SQL.get("retrieval_filtered_search"))
def hybrid(spark, tables):
    chunks, folder = chunks_of(tables), shared_folder(spark)
    index = ann.build(chunks.select("chunk_id", "embedding", "lang", "doc_type"), f"{folder}/vectors", ["lang", "doc_type"])
    words, trigrams = X.build_words(chunks, f"{folder}/words", ["lang", "doc_type"]), X.build_trigrams(chunks, f"{folder}/trigrams")
    found = X.indexed_search(words, trigrams, lambda v, k, where: ann.search(index, v, k, where=where, exact=True), chunks, TERM, first_vector(tables), 50, where=(F.col("lang") == "en") & (F.col("doc_type") == "src1"))
    return found.select("chunk_id", "rank_vec", "rank_fts", F.round("score", 9).alias("score"))
