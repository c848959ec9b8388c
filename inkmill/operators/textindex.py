"""Indexes for words and for trigrams as tables, searched block by block.

Both hold a row for each word (or trigram) and block of documents: so a frequent word's postings lie in many rows of bounded size, and a
search reads the rows of its own words only. Words deal documents to blocks by a hash of their id; for trigrams a block is texts
that follow each other in a task. Tables are partitioned by a hash of the word (or by the number of trigrams) and sorted by word within
files, so that both partitions and row groups are passed over.

`Words` answers web-style queries (words, phrases, OR, exclusions) in the order of cover density, as `retrieval.lexical`
does over texts. The greatest number of places of each word in a block bounds what its documents can reach; the blocks of the
highest bounds are scored first, and of the others only those that can still reach the last of the best so far.

`Trigrams` finds texts by similarity of their trigram sets above a threshold, as `retrieval.fuzzy` does. With T as threshold, sets of a and b
trigrams need min(a, b) / max(a, b) > T, so only some classes of sizes are read, and o = floor(T / (1 + T) * (a + b)) + 1 of them in common
at least. A text stands in the list of each of its trigrams, so in how many of the query's lists it stands is what they share, and with its size gives the
similarity itself: no sets are kept or compared.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, types
from pyspark.sql import functions as F

from inkmill.functions import trigrams as T
from inkmill.functions.text import ar_normalize
from inkmill.operators import retrieval as R

BLOCK = 128  #: documents of a block, as a mean
SHARDS = 64  #: partitions of the table of words
FIRST = 32  #: blocks scored before any is passed over
LETTERS = 40_000_000  #: of the texts that one task indexes by words
PLACES_MOST = 1 << 20  #: places of a word in one document that a row holds; more are further rows


def block_of(n: int) -> Column:
    """The block of a document, of as many as give BLOCK documents each."""
    return F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-n // BLOCK)))).alias("block")


def by_block(rows: DataFrame, letters: int) -> DataFrame:
    """rows (text and more) with their block, by whole blocks in one task, so that what is grouped by block and more needs no further shuffle.

    So texts move, and not their words with a key each. A task has some `letters` of text, few enough to sort its words without a spill.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // letters))
    return rows.withColumn("block", block_of(n)).repartition(tasks, "block")


class Words:
    """path/places: shard, word, block, most, chunk_ids, places; path/documents: chunk_id and the kept columns."""

    def __init__(self, spark: SparkSession, path: str):
        schema = "word string, block long, most long, chunk_ids array<long>, places array<array<int>>, shard int"
        self.rows, self.documents = spark.read.schema(schema).parquet(f"{path}/places"), spark.read.parquet(f"{path}/documents")

    def of(self, words: list[str]) -> DataFrame:
        """The rows of these words: read by shard, and by word within files."""
        shards = [r[0] for r in self.rows.sparkSession.createDataFrame([(w,) for w in words], "word string").select(shard_of_word()).collect()]
        return self.rows.filter(F.col("shard").isin(shards) & F.col("word").isin(words))


def shard_of_word() -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(SHARDS)).cast("int").alias("shard")


def build_words(chunks: DataFrame, path: str, keep: list[str] = ()) -> Words:
    spark = chunks.sparkSession
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text", *keep)
    words = by_block(rows.select("chunk_id", "text"), LETTERS).select("chunk_id", "block", F.posexplode(R.tokens(F.col("text"))).alias("place", "word"))
    # Places of one word in one document come in rows of bounded size, whatever the document's length.
    places = words.groupBy("word", "block", "chunk_id", F.floor(F.col("place") / PLACES_MOST).alias("part")).agg(F.array_sort(F.collect_list("place")).alias("places"))
    lists = places.groupBy("word", "block").agg(F.collect_list(F.struct("chunk_id", "places")).alias("held"), F.max(F.size("places")).alias("longest"), F.count("*").alias("n"), F.max("part").alias("parts"))
    most = (F.col("longest") * (F.col("parts") + 1)).alias("most")
    out = lists.select(shard_of_word(), "word", "block", most, F.col("held.chunk_id").alias("chunk_ids"), F.col("held.places").alias("places"))
    out.sortWithinPartitions("shard", "word", "block").write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/places")
    rows.drop("text").write.parquet(f"{path}/documents")
    return Words(spark, path)


def phrase_places(at: Column, phrase: list[str]) -> Column:
    """Where the phrase starts, from a map of words to sorted places."""
    first = F.coalesce(at[phrase[0]], F.array().cast("array<int>"))
    if len(phrase) == 1:
        return first
    # Pairs of a start and the place of a later word less its distance: a start that all words name is one of the phrase's.
    for k, word in enumerate(phrase[1:], 1):
        starts = functools.partial(lambda k, p: p - k, k)
        first = F.array_intersect(first, F.transform(F.coalesce(at[word], F.array().cast("array<int>")), lambda p: starts(p)))  # noqa: B023
    return F.array_sort(first)


def bound_of(group: list[tuple[bool, list[str]]], most: Column) -> Column:
    """What the cover density of a group can be at most, from the greatest counts of its words in a block.

    A cover adds 0.1 at most. Each holds the rarest term, and n covers at most hold the same place of it; covers end at
    different places, which are no more than all places but the n - 1 that come before the first cover's end.
    """
    counts = [F.least(*[most[w] for w in p], most[p[0]]) if len(p) > 1 else most[p[0]] for negative, p in group if not negative]
    n, total = len(counts), functools.reduce(lambda a, b: a + b, counts)
    least = F.least(*counts) if n > 1 else counts[0]
    return F.when(least > 0, 0.1 * F.least(n * least, total - (n - 1))).otherwise(0.0)


def search_words(index: Words, query: str, k: int = R.CANDIDATES, where: Column | None = None, allowed: DataFrame | None = None, first: int = FIRST) -> DataFrame:
    """chunk_id, density and rank_fts of the k best matches; allowed: a table of chunk_id. Small results are fetched once."""
    spark, groups = index.rows.sparkSession, R.parse_web_query(query)
    empty = spark.createDataFrame([], "chunk_id long, density double, rank_fts int")
    if not groups:
        return empty
    positive = sorted({w for g in groups for negative, p in g if not negative for w in p})
    rows = index.of(sorted({w for g in groups for _, p in g for w in p}))
    if where is not None or allowed is not None:
        inside = index.documents.filter(where) if where is not None else index.documents
        inside = inside.join(allowed.select("chunk_id"), "chunk_id", "left_semi") if allowed is not None else inside
    most = F.map_from_entries(F.collect_list(F.struct("word", F.col("most").cast("double"))))
    at_least = lambda m: {w: F.coalesce(m[w], F.lit(0.0)) for w in positive}
    # Only the counts of the words are read here; a row for each word of the query in a block.
    blocks = rows.filter(F.col("word").isin(positive)).groupBy("block").agg(most.alias("m"))
    bound = functools.reduce(lambda a, b: a + b, [bound_of(g, at_least(F.col("m"))) for g in groups])
    may = functools.reduce(lambda a, b: a | b, [functools.reduce(lambda a, b: a & b, [F.coalesce(F.col("m")[w], F.lit(0.0)) > 0 for negative, p in g if not negative for w in p]) for g in groups])
    bounds = blocks.filter(may).select("block", bound.alias("bound"))

    def scored(chosen: DataFrame) -> DataFrame:
        held = rows.join(chosen, "block", "left_semi").select("word", F.explode(F.arrays_zip("chunk_ids", "places")).alias("x")).select("word", "x.*")
        if where is not None or allowed is not None:
            held = held.join(inside.select(F.col("chunk_id").alias("chunk_ids")), "chunk_ids", "left_semi")
        # Rows of one word and document are few: one for PLACES_MOST places.
        whole = held.groupBy("chunk_ids", "word").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
        at = whole.groupBy("chunk_ids").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("at"))
        test, density = None, None
        for g in groups:
            found = [(negative, phrase_places(F.col("at"), p)) for negative, p in g]
            ok = functools.reduce(lambda a, b: a & b, [F.size(x) == 0 if negative else F.size(x) > 0 for negative, x in found])
            score = R.cover_density([x for negative, x in found if not negative])
            test, density = ok if test is None else test | ok, score if density is None else density + score
        best = at.filter(test).select(F.col("chunk_ids").alias("chunk_id"), density.alias("density"))
        return best.orderBy(F.desc("density"), "chunk_id").limit(k)

    top = bounds.orderBy(F.desc("bound"), "block").limit(first)
    seen = [tuple(r) for r in top.collect()]
    if not seen:
        return empty
    best = [tuple(r) for r in scored(F.broadcast(spark.createDataFrame(seen, "block long, bound double").select("block"))).collect()]
    if len(seen) == first:
        needed = best[k - 1][1] if len(best) >= k else 0.0
        done = [b for b, _ in seen]
        # Equal densities go by id, so a block that can only equal the last of the best is scored too.
        rest = bounds.filter((F.col("bound") >= needed - 1e-9) & ~F.col("block").isin(done)).select("block")
        best = sorted(best + [tuple(r) for r in scored(rest).collect()], key=lambda r: (-r[1], r[0]))[:k]
    return spark.createDataFrame([(i, d, n) for n, (i, d) in enumerate(best, 1)], empty.schema)


def passed_over(index: Words, query: str, k: int = R.CANDIDATES, first: int = FIRST) -> tuple[int, int]:
    """How many blocks hold the query's words, and how many of them search_words() leaves unread, for queries of one group."""
    group = R.parse_web_query(query)[0]
    words = sorted({w for negative, p in group if not negative for w in p})
    m = F.map_from_entries(F.collect_list(F.struct("word", F.col("most").cast("double"))))
    blocks = index.of(words).groupBy("block").agg(m.alias("m"), F.count("*").alias("n")).filter(F.col("n") == len(words))
    bounds = sorted((r[0] for r in blocks.select(bound_of(group, {w: F.col("m")[w] for w in words})).collect()), reverse=True)
    last = search_words(index, query, k, first=first).agg(F.min("density"), F.count("*")).first()
    needed = last[0] if last[1] >= k else 0.0
    return len(bounds), sum(b < needed - 1e-9 for b in bounds[first:])


class Trigrams:
    """path/lists: class, trigram, block, places; and texts (structs of chunk_id, the kept columns and size), which stand under an empty trigram.

    A place counts the texts of a class and block from 0 on; size is a text's number of trigrams.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.lists = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/lists")


def build_trigrams(chunks: DataFrame, path: str, keep: list[str] = ()) -> Trigrams:
    """Tasks index the texts that they read, block by block, so neither texts nor trigrams are shuffled."""
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), *keep, R.spaced(ar_normalize(F.col("text"))).alias("spaced"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for n, block in enumerate(T.blocks(batches, "spaced")):
            yield from T.rows_of(block, first + n, "spaced")

    text = types.StructType([*rows.drop("spaced").schema.fields, types.StructField("size", types.IntegerType())])
    schema = types.StructType.fromDDL("class int, trigram string, block long, places array<smallint>").add("texts", types.ArrayType(text))
    lists = rows.mapInArrow(task, schema)
    lists.sortWithinPartitions("class", "trigram").write.partitionBy("class").option("compression", "zstd").parquet(f"{path}/lists")
    lists.limit(0).write.parquet(f"{path}/columns")  # the schema, for tables without rows
    return Trigrams(chunks.sparkSession, path)


def candidates(index: Trigrams, query: str, above: float = R.SIMILARITY) -> DataFrame:
    """The texts that share enough trigrams with the query for the least size of their class: chunk_id, kept columns, size, shared (trigrams) and asked (the query's)."""
    spark = index.spark
    b = [r[0] for r in spark.range(1).select(F.explode(R.trigrams(ar_normalize(F.lit(query))))).collect()]
    enough = {}
    for c in range(math.floor(2 * math.log2(max(1.0, above * len(b)))) - 1, math.ceil(2 * math.log2(len(b) / above)) + 2) if b else ():
        least, most = math.ceil(2 ** (c / 2) - 1e-6), math.floor(2 ** ((c + 1) / 2) + 1e-6)
        a = max(least, math.floor(above * len(b)) + 1)  # sets must be larger than this share of the query's
        common = math.floor(above / (1 + above) * (a + len(b)) + 1e-9) + 1
        if c >= 0 and a <= most and a * above < len(b) and common <= len(b):
            enough[c] = common
    rows = index.lists.filter(F.col("class").isin(list(enough)) if enough else "false")
    needed = F.create_map(*[F.lit(x) for pair in enough.items() for x in pair])[F.col("class")] if enough else F.lit(0)
    # A text's lists lie in one block, so what a task reads is counted there for the most part.
    counts = rows.filter(F.col("trigram").isin(b)).select("class", "block", F.explode("places").alias("place")).groupBy("class", "block", "place").agg(F.count("*").cast("int").alias("n"))
    held = counts.filter(F.col("n") >= needed).groupBy("class", "block").agg(F.collect_list(F.struct("place", "n")).alias("held"))  # T.TEXTS at most
    texts = rows.filter("trigram = ''").select("class", "block", "texts")
    found = texts.join(held, ["class", "block"]).select(F.explode(F.transform("held", lambda x: F.struct(F.get("texts", x["place"]).alias("text"), x["n"].alias("n")))).alias("x"))
    return found.select("x.text.*", F.col("x.n").alias("shared"), F.lit(len(b)).alias("asked"))


def search_trigrams(index: Trigrams, query: str, k: int = R.TOP_K, above: float = R.SIMILARITY, where: Column | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """chunk_id and score of the k most similar texts above the threshold, exactly."""
    found = candidates(index, query, above)
    found = found.filter(where) if where is not None else found
    found = found.join(allowed.select("chunk_id"), "chunk_id", "left_semi") if allowed is not None else found
    rows = found.select("chunk_id", (F.col("shared") / (F.col("size") + F.col("asked") - F.col("shared"))).alias("score"))
    return rows.filter(F.col("score") > above).orderBy(F.desc("score"), "chunk_id").limit(k)


def indexed_search(words: Words, trigrams: Trigrams, nearest, chunks: DataFrame, query: str | None, vector: list[float] | None, top_k: int = R.TOP_K, where: Column | None = None, doc_ids: list | DataFrame | None = None) -> DataFrame:
    """retrieval.hybrid_search over the indexes: the best chunks with score, rank_vec and rank_fts.

    nearest: (vector, k, where) to (chunk_id, distance) pairs, such as ann.search of an index, whose kept columns `where` names. The
    fallback by trigrams keeps doc_ids and ignores `where`. doc_ids are chunk ids here: a list or a table with chunk_id.
    """
    spark, top_k = words.rows.sparkSession, max(1, min(R.TOP_K_MOST, top_k))
    none = chunks.limit(0).withColumns({"score": F.lit(0.0), "rank_vec": F.lit(0), "rank_fts": F.lit(0)})
    if not query or not query.strip() or isinstance(doc_ids, list) and not doc_ids:
        return none
    allowed = spark.createDataFrame([(i,) for i in doc_ids], "chunk_id long") if isinstance(doc_ids, list) else doc_ids
    found = []
    if vector is not None:
        scope = F.col("id").isin(doc_ids) if isinstance(doc_ids, list) else None
        both = scope if where is None else where if scope is None else scope & where
        vec = spark.createDataFrame([(i, n) for n, (i, _) in enumerate(nearest(vector, R.CANDIDATES, both), 1)], "chunk_id long, rank_vec int")
        fused = R.fuse(vec, search_words(words, query, where=where, allowed=allowed)).orderBy(F.desc("score"), "chunk_id").limit(top_k)
        found = fused.select("chunk_id", "rank_vec", "rank_fts", "score").collect()
    if found:
        best = spark.createDataFrame(found, "chunk_id long, rank_vec int, rank_fts int, score double")
    else:
        best = search_trigrams(trigrams, query, top_k, allowed=allowed).select("chunk_id", F.lit(None).cast("int").alias("rank_vec"), F.lit(None).cast("int").alias("rank_fts"), "score")
    return chunks.join(F.broadcast(best), "chunk_id").orderBy(F.desc("score"), "chunk_id")  # TOP_K_MOST rows
