"""The index of chunks as one pipeline: current revisions are chunked, embedded in batches, joined with metadata, and replace their rows.

Vectors come from a model elsewhere: `embed` maps (document_id, chunk_index, embed_text) to vectors by the same key. The runs say, for
each document, what became of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.operators.chunking import chunks, embed_text, indexed
from inkmill.session import written
from inkmill.sources.tables import replace_by_key


def index_revisions(revisions: DataFrame, meta: DataFrame, embed: Callable[[DataFrame], DataFrame], old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The index with these revisions' chunks, and the runs (document_id, revision_id, status, chunk_count, error).

    revisions: document_id, revision_id, text (pages parted by form feeds), one row a document. Rows of a revision that is indexed
    again are replaced, as a whole; a text that gives no chunks fails and leaves what was there. Metadata is copied onto each chunk.
    """
    texts = revisions.filter(F.coalesce("text", F.lit("")).rlike(r"[^\s\p{Z}]"))
    drafts = written(chunks(texts.select("document_id", "text"), "document_id").join(texts.select("document_id", "revision_id"), "document_id"))
    vectors = embed(drafts.select("document_id", "chunk_index", embed_text(F.col("section_path"), F.col("text")).alias("embed_text")))
    new = indexed(drafts, meta, vectors)
    counts = drafts.groupBy("document_id").agg(F.count("*").alias("n"))
    rows = revisions.select("document_id", "revision_id", F.coalesce("text", F.lit("")).rlike(r"[^\s\p{Z}]").alias("has_text")).join(counts, "document_id", "left")
    error = F.when(~F.col("has_text"), "no finalized text").when(F.col("n").isNull(), "chunking produced no chunks")
    runs = rows.select("document_id", "revision_id", F.when(error.isNull(), "succeeded").otherwise("failed").alias("status"), F.coalesce("n", F.lit(0)).alias("chunk_count"), error.alias("error"))
    return (new if old is None else replace_by_key(old, new, ["revision_id"])), runs
