"""Hybrid retrieval: exact dense ranks and lexical ranks fused by reciprocal rank, with a trigram fallback.

Chunks are a table with chunk_id, document_id, text, embedding, lang and doc_type (and whatever else
the caller wants back). Filters stand below both channels' top-k, as they are part of what is ranked.
Ties fall to the lesser chunk_id. The dense channel is an exact scan; a batch of queries goes to the
tasks as one matrix, so each chunk is read once for all of them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions.core import let
from inkmill.functions.text import ar_normalize

# Fixed values of the fusion.
RRF_K, VECTOR_WEIGHT, LEXICAL_WEIGHT, CANDIDATES, SIMILARITY = 60, 1.2, 1.0, 80, 0.25
TOP_K, TOP_K_MOST = 8, 50
QUERY_BLOCK = 2048  #: query vectors in one pass of knn()
CHUNK_BLOCK = 1024  #: chunks that a task holds against them at a time


def cosine_distance(embedding: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(embedding, q) / (F.sqrt(dot(embedding, embedding)) * float(np.sqrt(np.dot(query, query))))


def scoped(chunks: DataFrame, doc_ids: list | DataFrame | None = None, doc_type: str | None = None, lang: str | None = None) -> DataFrame:
    """None leaves a filter out; an empty list of ids is an empty scope. Many ids come as a table with document_id."""
    if isinstance(doc_ids, DataFrame):  # ids as a table, of any size
        chunks = chunks.join(doc_ids.select("document_id"), "document_id", "left_semi").select(chunks.columns)
    elif doc_ids is not None:
        chunks = chunks.filter(F.col("document_id").isin(doc_ids)) if doc_ids else chunks.limit(0)
    if doc_type is not None:
        chunks = chunks.filter(F.col("doc_type") == doc_type)
    if lang is not None:
        chunks = chunks.filter(F.col("lang") == lang)
    return chunks


def dense(chunks: DataFrame, query: list[float], candidates: int = CANDIDATES) -> DataFrame:
    """chunk_id, distance and rank of the nearest chunks."""
    near = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", cosine_distance(F.col("embedding"), query).alias("distance")).orderBy("distance", "chunk_id").limit(candidates)
    return near.withColumn("rank_vec", F.row_number().over(Window.orderBy("distance", "chunk_id")))  # at most `candidates` rows


def nearest(distances: np.ndarray, known: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least distances of each row and their ids, equal ones by id; ids of the first columns differ by row (known), the others' do not (new)."""
    k = min(k, distances.shape[1])
    # Only what is not beyond the k-th least is put in order, so nothing of the size of all distances is sorted or numbered.
    row, column = np.nonzero(distances <= np.partition(distances, k - 1, axis=1)[:, k - 1 : k])
    d, old, n = distances[row, column], column < known.shape[1], known.shape[1]
    i = np.empty(len(row), dtype=np.int64)
    i[old], i[~old] = known[row[old], column[old]], new[column[~old] - n]
    order = np.lexsort((i, d, row))
    first = np.searchsorted(row, np.arange(len(distances)))  # rows are in order before and after
    taken = order[first[:, None] + np.arange(k)]
    return d[taken], i[taken]


def knn(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For every query (query_id, embedding) its k nearest chunks by cosine: query_id, chunk_id, distance, rank.

    Queries are taken in blocks of QUERY_BLOCK to the tasks, which keep their best k for each; the
    merge ranks k rows a task and query. Zero vectors and nulls have no neighbours.
    """
    out, block = None, []

    def run(rows: list) -> DataFrame:
        ids = [r[0] for r in rows]
        matrix = np.array([r[1] for r in rows], dtype=np.float64)
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best_d, best_i = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), dtype=np.int64)
            for whole, at in ((b, at) for b in batches for at in range(0, b.num_rows, CHUNK_BLOCK)):
                b = whole.slice(at, CHUNK_BLOCK)
                vectors = b.column(1)
                x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)  # the usable ones are of one length
                d = 1 - matrix @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                d[np.isnan(d)] = np.inf
                best_d, best_i = nearest(np.concatenate([best_d, d], axis=1), best_i, b.column(0).to_numpy(), k)
            q, n = best_d.shape
            yield pa.record_batch([pa.array(np.repeat(np.array(ids), n), pa.int64()), pa.array(best_i.reshape(-1)), pa.array(best_d.reshape(-1))], names=["query_id", "chunk_id", "distance"])

        usable = chunks.filter(F.exists("embedding", lambda x: x != 0)).select(F.col("chunk_id").cast("long"), "embedding")
        return usable.mapInArrow(task, "query_id long, chunk_id long, distance double")

    for row in queries.filter(F.exists("embedding", lambda x: x != 0)).select(F.col("query_id").cast("long"), "embedding").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            out = run(block) if out is None else out.unionByName(run(block))
            block = []
    if block or out is None:
        last = run(block) if block else chunks.sparkSession.createDataFrame([], "query_id long, chunk_id long, distance double")
        out = last if out is None else out.unionByName(last)
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return out.withColumn("rank", ranked).filter(F.col("rank") <= k)


def words_in(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(r"[\p{L}\p{M}\p{N}_]+"), 0)


def tokens(text: Column) -> Column:
    """Normalised words in order."""
    return words_in(ar_normalize(F.coalesce(text, F.lit(""))))


def parse_web_query(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Words are joined by AND, "..." is a phrase, OR separates alternatives, -x excludes: groups of (excluded, words)."""
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)"([^"]*)"|(\S+)', query):
        if word.lower() == "or":
            if groups[-1]:
                groups.append([])
            continue
        negative = minus == "-" or word.startswith("-")
        words = re.findall(r"\w+", (phrase or word).lower())
        if words:
            groups[-1].append((negative, words))
    return [g for g in groups if any(not n for n, _ in g)]


def word_positions(words: Column, word: str) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.when(w == word, i)), lambda p: p.isNotNull())


def phrase_positions(words: Column, phrase: list[str]) -> Column:
    """Places where the phrase starts."""

    def run(held: Column) -> Column:
        def here(w: Column, i: Column) -> Column:
            test = w == phrase[0]
            for k, other in enumerate(phrase[1:], 1):
                test = test & (F.get(held, i + k) == other)
            return F.when(F.coalesce(test, F.lit(False)), i)

        return F.filter(F.transform(held, here), lambda p: p.isNotNull())

    return let(words, run)


def cover_density(positions: list[Column]) -> Column:
    """Sum over minimal covers of all terms of 0.1 / (1 + words between), after Clarke, Cormack and Tudhope (2000).

    One pass over the terms' places in order: a place ends a minimal cover if all terms have been seen
    and the earliest of their last places is later than that of the cover before.
    """
    n = len(positions)
    tagged = lambda p, t: F.transform(p, lambda x: F.struct(x.alias("p"), F.lit(t).alias("t")))
    places = F.array_sort(F.flatten(F.array(*[tagged(p, t) for t, p in enumerate(positions)])))
    start = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(-1).alias("before"), F.lit(0.0).alias("total"))

    def step(s: Column, x: Column) -> Column:
        def next_(last: Column) -> Column:
            first = F.array_min(last)
            ends = first > s["before"]
            return F.struct(last.alias("last"), F.when(ends, first).otherwise(s["before"]).alias("before"), (s["total"] + F.when(ends, 0.1 / (1 + (x["p"] - first) - (n - 1))).otherwise(0.0)).alias("total"))

        return let(F.transform(s["last"], lambda old, t: F.when(t == x["t"], x["p"]).otherwise(old)), next_)

    return F.aggregate(places, start, step, lambda s: s["total"])


def matches(chunks: DataFrame, query: str) -> DataFrame:
    """chunk_id and density of all matches of a web-style query."""
    groups = parse_web_query(query)
    if not groups:
        return chunks.limit(0).select("chunk_id", F.lit(0.0).alias("density"))
    # A text can match only if it holds all words of some group as they stand; only such texts are cut into words.
    normal, may = F.col("normal"), F.lit(False)
    for group in groups:
        may = may | functools.reduce(lambda test, word: test & normal.contains(word), [w for negative, phrase in group if not negative for w in phrase], F.lit(True))
    rows = chunks.select("chunk_id", ar_normalize(F.coalesce("text", F.lit(""))).alias("normal")).filter(may).select("chunk_id", words_in(normal).alias("words"))
    w, test = F.col("words"), None
    for group in groups:
        held = None
        for negative, phrase in group:
            found = F.array_contains(w, phrase[0]) if len(phrase) == 1 else F.size(phrase_positions(w, phrase)) > 0
            found = ~found if negative else found
            held = found if held is None else held & found
        test = held if test is None else test | held
    # A group that does not match adds no density.
    scores = []
    for group in groups:
        positions = [word_positions(w, p[0]) if len(p) == 1 else phrase_positions(w, p) for negative, p in group if not negative]
        scores.append(cover_density(positions))
    density = sum(scores[1:], scores[0])
    return rows.filter(test).select("chunk_id", density.alias("density"))


def lexical(chunks: DataFrame, query: str, candidates: int = CANDIDATES) -> DataFrame:
    """chunk_id, density and rank of the best matches of a web-style query."""
    best = matches(chunks, query).orderBy(F.desc("density"), "chunk_id").limit(candidates)
    return best.withColumn("rank_fts", F.row_number().over(Window.orderBy(F.desc("density"), "chunk_id")))  # at most `candidates` rows


def fuse(vec: DataFrame, fts: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion: chunk_id, score, rank_vec, rank_fts."""
    both = vec.select("chunk_id", "rank_vec").join(fts.select("chunk_id", "rank_fts"), "chunk_id", "full")
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (F.lit(float(RRF_K)) + F.col(rank)), F.lit(0.0))
    return both.withColumn("score", part(VECTOR_WEIGHT, "rank_vec") + part(LEXICAL_WEIGHT, "rank_fts"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each with two blanks before and one after."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def spaced(lowered: Column) -> Column:
    """The words of trigrams(), each after two blanks and before one: windows of three letters that do not end in two blanks are its trigrams, with repeats."""
    return F.concat(F.lit("  "), F.regexp_replace(F.coalesce(lowered, F.lit("")), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))


def similarity(a: Column, b: Column) -> Column:
    """Shared by all trigrams, from two sets of them."""

    def share(x: Column) -> Column:
        either = F.size(x["a"]) + F.size(x["b"]) - x["n"]
        return F.when(either == 0, 0.0).otherwise(x["n"] / either)

    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: share({"a": x["a"], "b": x["b"], "n": F.size(F.array_intersect(x["a"], x["b"]))}))


def fuzzy(chunks: DataFrame, query: str, top_k: int = TOP_K) -> DataFrame:
    score = similarity(trigrams(ar_normalize(F.col("text"))), trigrams(ar_normalize(F.lit(query))))
    found = chunks.select("chunk_id", score.alias("score")).filter(F.col("score") > SIMILARITY).orderBy(F.desc("score"), "chunk_id").limit(top_k)
    return found.select("chunk_id", F.lit(None).cast("int").alias("rank_vec"), F.lit(None).cast("int").alias("rank_fts"), "score")


def hybrid_search(chunks: DataFrame, query: str | None, vector: list[float] | None, top_k: int = TOP_K, doc_ids: list | DataFrame | None = None, doc_type: str | None = None, lang: str | None = None, resembling: bool = True) -> DataFrame:
    """The best chunks with score, rank_vec and rank_fts.

    A blank query and an empty scope find nothing. Without a vector, and where neither channel finds
    anything, the trigram fallback answers unless `resembling` is off; it keeps the scope and ignores doc_type and lang.
    """
    top_k = max(1, min(TOP_K_MOST, top_k))
    inside = scoped(chunks, doc_ids, doc_type, lang)
    if not query or not query.strip() or isinstance(doc_ids, list) and not doc_ids:
        found = fuzzy(chunks.limit(0), "", top_k)
    elif vector is None:
        found = fuzzy(scoped(chunks, doc_ids), query, top_k)
    else:
        found = fuse(dense(inside, vector), lexical(inside, query)).orderBy(F.desc("score"), "chunk_id").limit(top_k)
        # At most TOP_K_MOST rows of three numbers: fetched once, so that neither channel runs again below.
        rows = found.select("chunk_id", "rank_vec", "rank_fts", "score").collect()
        found = chunks.sparkSession.createDataFrame(rows, found.schema) if rows else fuzzy(scoped(chunks, doc_ids) if resembling else chunks.limit(0), query, top_k)
    # Texts are fetched for the few ids found only.
    return chunks.join(F.broadcast(found), "chunk_id").orderBy(F.desc("score"), "chunk_id")


def search_with_hints(chunks: DataFrame, query: str, vector: list[float] | None, top_k: int = TOP_K, doc_ids: list | None = None, doc_type: str | None = None, lang: str | None = None) -> DataFrame:
    """doc_type and lang are hints: if they leave nothing, the search runs again without them, in the same scope.

    The fallback by trigrams ignores hints, so it comes last: texts that only resemble the query do not stand for what the hints left.
    """
    if doc_type or lang:
        found = hybrid_search(chunks, query, vector, top_k, doc_ids, doc_type, lang, resembling=False)
        if not found.isEmpty():
            return found
    return hybrid_search(chunks, query, vector, top_k, doc_ids)


def format_hits(hits: DataFrame, max_chars: int = 1200) -> DataFrame:
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("original_filename"))
    return hits.select("chunk_id", "document_id", title.alias("document_title"), "page_start", "page_end", F.col("section_path").alias("section"), F.substring("text", 1, max_chars).alias("text"), F.round(F.coalesce("score", F.lit(0.0)), 5).alias("score"))


def neighbours(chunks: DataFrame, hits: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """The chunks of the same revision within a distance of each hit, by an equi-join and a range."""
    h = hits.select("revision_id", F.col("chunk_index").alias("hit_index"))
    near = F.col("chunk_index").between(F.col("hit_index") - before, F.col("hit_index") + after)
    return chunks.join(h, "revision_id").filter(near)


def search_postings(index: DataFrame, query: list[str], candidates: int = CANDIDATES) -> DataFrame:
    """chunk_id, density and rank of the chunks that hold all the words, from postings(); reads the rows of these words only."""
    words = list(dict.fromkeys(query))
    held = index.filter(F.col("word").isin(words)).groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("at"))  # a row for each word at most
    held = held.filter(F.size("at") == len(words)).select("chunk_id", cover_density([F.col("at")[w] for w in words]).alias("density"))
    best = held.orderBy(F.desc("density"), "chunk_id").limit(candidates)
    return best.withColumn("rank_fts", F.row_number().over(Window.orderBy(F.desc("density"), "chunk_id")))  # at most `candidates` rows


def postings(chunks: DataFrame) -> DataFrame:
    """word, chunk_id and places: an inverted index as a table, to be written bucketed by word where many queries follow.

    Texts are dealt by chunk_id and not their words, which with a key and a place each are many times as much. The words of a chunk are
    sorted within its row, so that nothing is spilled but texts.
    """
    placed = lambda t: F.transform(tokens(t), lambda w, i: F.struct(w.alias("word"), i.alias("place")))
    texts = chunks.groupBy("chunk_id").agg(F.collect_list("text").alias("texts"))  # one text, but where ids repeat
    rows = texts.select("chunk_id", F.sort_array(F.flatten(F.transform("texts", placed))).alias("s")).filter(F.size("s") > 0)
    # Single elements are taken from s, as Spark would make an array of all words anew for each of them.
    word = lambda i: F.get("s", i)["word"]
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (word(i) != word(i - 1))))
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("s"))
    held = F.transform("starts", lambda i, k: F.struct(word(i).alias("word"), F.slice("s", i + 1, end(k) - i)["place"].alias("places")))
    return rows.select("chunk_id", F.explode(held).alias("x")).select("x.word", "chunk_id", "x.places")
