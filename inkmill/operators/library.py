"""What a conversation's tools answer about documents, for many requests at once.

A request is a row with its conversation's scope: null for all documents, else the ids that it may see (an empty
list: none). Requests meet tables in equi-joins by id, and each gets one answer; what is asked in vain gets a message.
Repeated requests share the join's rows. Nulls: an unknown id, a null id and an id outside the scope are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.operators.relational import contains_either

OUTSIDE = "The document is not among the sources of this conversation."
LISTED, MOST_LISTED = 20, 50  # fixed values


def in_scope(document_id: Column, scope: Column) -> Column:
    return scope.isNull() | F.coalesce(F.array_contains(scope, document_id), F.lit(False))


def documents_listed(documents: DataFrame, scope: list[str] | None = None, text: str | None = None, doc_type: str | None = None, lang: str | None = None, limit: int = LISTED) -> DataFrame:
    """The ready documents of a scope by title or keyword, kind and main language; by id, 50 at most.

    documents: document_id, status, title, keywords, doc_type, lang and more, which pass through.
    """
    found = documents.filter(F.col("status") == "ready")
    if scope is not None:
        found = found.filter(F.col("document_id").isin(scope))
    if doc_type:
        found = found.filter(F.col("doc_type") == doc_type)
    if lang:
        found = found.filter(F.col("lang") == lang)
    if text:
        found = found.filter(contains_either(text, F.col("title")) | F.coalesce(F.array_contains("keywords", text), F.lit(False)))
    return found.orderBy("document_id").limit(min(limit, MOST_LISTED))


def pages_read(requests: DataFrame, revisions: DataFrame) -> DataFrame:
    """request_id and answer: the page, or why there is none.

    requests: request_id, document_id, page_number, scope; revisions: document_id, pages, one row a document.
    """
    asked = requests.select("request_id", "document_id", "page_number", in_scope(F.col("document_id"), F.col("scope")).alias("seen"))
    # Pages are read only for what may be seen.
    have = asked.join(revisions.select("document_id", "pages", F.lit(True).alias("known")), (asked["document_id"] == revisions["document_id"]) & asked["seen"], "left").drop(revisions["document_id"])
    n = F.size("pages")
    outside = F.concat(F.lit("Page "), F.coalesce(F.col("page_number").cast("string"), F.lit("without number")), F.lit(" is out of range; the document has "), n.cast("string"), F.lit(" page(s)."))
    none = F.concat(F.lit("There is no final text of document "), F.coalesce("document_id", F.lit("without id")), F.lit("."))
    answer = (
        F.when(~F.col("seen"), OUTSIDE)
        .when(F.col("known").isNull() | F.col("pages").isNull(), none)
        .when(F.coalesce(F.col("page_number").between(1, n), F.lit(False)), F.get("pages", F.col("page_number").cast("int") - 1))
        .otherwise(outside)
    )
    return have.select("request_id", answer.alias("answer"))


def metadata_read(requests: DataFrame, metadata: DataFrame) -> DataFrame:
    """request_id, record (all columns of metadata, which has one row a document) and error; one of both is null."""
    asked = requests.select("request_id", F.col("document_id").alias("asked"), in_scope(F.col("document_id"), F.col("scope")).alias("seen"))
    held = metadata.select(F.struct(*metadata.columns).alias("record"))
    have = asked.join(held, (F.col("asked") == F.col("record.document_id")) & F.col("seen"), "left")
    error = F.when(~F.col("seen"), OUTSIDE).when(F.col("record").isNull(), F.concat(F.lit("There are no metadata of document "), F.coalesce("asked", F.lit("without id")), F.lit(".")))
    return have.select("request_id", "record", error.alias("error"))


def contexts_read(requests: DataFrame, chunks: DataFrame, separator: str = "\n\n") -> DataFrame:
    """request_id and answer: a chunk with those before and after it in its revision, joined in order.

    requests: request_id, chunk_id, before, after (null: 1), scope; chunks: chunk_id, document_id, revision_id,
    chunk_index, text. Windows end where the revision does, so that a wide one costs no more than the revision has.
    """
    asked = requests.select("request_id", F.col("chunk_id").alias("asked"), "scope", *[F.coalesce(c, F.lit(1)).cast("long").alias(c) for c in ("before", "after")])
    ends = chunks.groupBy("revision_id").agg(F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"))
    hit = asked.join(chunks.select(F.col("chunk_id").alias("asked"), "document_id", "revision_id", F.col("chunk_index").alias("at")), "asked", "left").join(ends, "revision_id", "left")
    hit = hit.withColumn("seen", in_scope(F.col("document_id"), F.col("scope")))
    low, high = F.greatest(F.col("at") - F.col("before"), "first"), F.least(F.col("at") + F.col("after"), "last")
    places = hit.filter(F.col("seen") & F.col("at").isNotNull() & (low <= high)).select("request_id", "revision_id", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("chunk_index"))
    near = places.join(chunks.select("revision_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text"), ["revision_id", "chunk_index"])
    texts = near.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("found"))
    joined = F.array_join(F.transform("found", lambda x: x["text"]), separator)
    none = F.concat(F.lit("There is no chunk "), F.coalesce("asked", F.lit("without id")), F.lit("."))
    answer = F.when(F.col("at").isNull(), none).when(~F.col("seen"), "The chunk is not among the sources of this conversation.").otherwise(F.coalesce(joined, F.lit("")))
    return hit.join(texts, "request_id", "left").select("request_id", answer.alias("answer"))


def scopes_checked(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """request_id, document_ids (in their order, each once; empty for all; null on an error) and error.

    requests: request_id, owner, scope ("all" or "selected"), document_ids; documents: document_id, owner, of those
    that may be asked. A document of another owner is as unavailable as one that does not exist.
    """
    ids = F.array_distinct(F.coalesce("document_ids", F.array().cast("array<string>")))
    rows = requests.select("request_id", "owner", "scope", ids.alias("ids"))
    chosen = rows.filter("scope = 'selected'").select("request_id", "owner", F.posexplode("ids").alias("place", "document_id"))
    have = documents.select("owner", "document_id").distinct().withColumn("have", F.lit(True))
    lost = chosen.join(have, ["owner", "document_id"], "left").filter("have IS NULL")
    lost = lost.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "document_id"))), lambda x: x["document_id"]), ", ", "null").alias("lost"))
    error = (
        F.when(~F.coalesce(F.col("scope").isin("all", "selected"), F.lit(False)), "The scope is neither all nor selected.")
        .when((F.col("scope") == "selected") & (F.size("ids") == 0), "No document is selected.")
        .when(F.col("lost").isNotNull(), F.concat(F.lit("Not available: "), F.col("lost")))
    )
    rows = rows.join(lost, "request_id", "left").withColumn("error", error)
    kept = F.when(F.col("error").isNull(), F.when(F.col("scope") == "all", F.array().cast("array<string>")).otherwise(F.col("ids")))
    return rows.select("request_id", kept.alias("document_ids"), "error")


def attachments_read(pages: DataFrame, keys: list[str], order: str, text: str, usable: Column, suspect: Column, threshold: float = 0.6, rendered: int = 4) -> DataFrame:
    """Per attachment: page_count, is_digital, its text (pages parted by form feeds) if so, else the first pages, which are to be rendered.

    It is digital if a share of its pages is usable and none is suspect.
    """
    digital = (F.avg(F.coalesce(usable, F.lit(False)).cast("double")) >= threshold) & ~F.bool_or(F.coalesce(suspect, F.lit(False)))
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.coalesce(text, F.lit("")).alias("t"))))
    rows = pages.groupBy(*keys).agg(F.count("*").alias("page_count"), digital.alias("is_digital"), held.alias("held"))
    whole = F.regexp_replace(F.array_join(F.transform("held", lambda p: p["t"]), "\f"), r"^\s+|\s+$", "")
    shown = F.slice(F.transform("held", lambda p: p["n"]), 1, rendered)
    return rows.select(*keys, "page_count", "is_digital", F.when(F.col("is_digital"), whole).alias("text"), F.when(~F.col("is_digital"), shown).alias("rendered"))
