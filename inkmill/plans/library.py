"""Queries over what tools answer about documents: requests are events, documents and their lines the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.functions import text as T
from inkmill.operators import library as L
from inkmill.plans.base import query

#: Requests for both engines: some documents and pages do not exist, views see all documents, clicks none.
ASKED = f"""r AS (
  SELECT event_id, user_id, event_id % 1100 AS d, event_id % 13 AS p, event_type,
         event_type = 'view' OR (event_type <> 'click' AND (event_id % 3 = 0 OR event_id % 1100 = user_id)) AS seen, '{L.OUTSIDE}' AS outside
  FROM events)"""


def requests(tables):
    d = (F.col("event_id") % 1100).cast("string")
    some = F.when(F.col("event_id") % 3 == 0, F.array(d, F.col("user_id").cast("string"))).otherwise(F.array(F.col("user_id").cast("string")))
    scope = F.when(F.col("event_type") == "click", F.array().cast("array<string>")).when(F.col("event_type") != "view", some)
    at = (F.col("event_id") % 13).cast("int")
    return tables("events").select(F.col("event_id").alias("request_id"), d.alias("document_id"), at.alias("page_number"), F.concat_ws(":", d, at).alias("chunk_id"), (at % 4).alias("before"), F.when(at > 3, at % 3).alias("after"), scope.alias("scope"))


@query("tools_read_page", f"""WITH {ASKED}, v AS (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents)
SELECT event_id AS request_id, CASE WHEN NOT seen THEN outside WHEN doc_id IS NULL THEN 'There is no final text of document ' || d || '.'
  WHEN p BETWEEN 1 AND len(pages) THEN pages[p] ELSE 'Page ' || p || ' is out of range; the document has ' || len(pages) || ' page(s).' END AS answer
FROM r LEFT JOIN v ON doc_id = d""")
def read_page(spark, tables):
    revisions = tables("documents").select(F.col("doc_id").cast("string").alias("document_id"), F.split("text", "\n").alias("pages"))
    return L.pages_read(requests(tables), revisions)


@query("tools_metadata", f"""WITH {ASKED}
SELECT event_id AS request_id, CASE WHEN seen THEN source END AS doc_type, CASE WHEN seen THEN lang END AS lang,
  CASE WHEN NOT seen THEN outside WHEN doc_id IS NULL THEN 'There are no metadata of document ' || d || '.' END AS error
FROM r LEFT JOIN documents ON doc_id = d""")
def metadata(spark, tables):
    held = tables("documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("doc_type"), "lang")
    return L.metadata_read(requests(tables), held).select("request_id", "record.doc_type", "record.lang", "error")


@query("tools_chunk_context", f"""WITH {ASKED}, v AS (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents)
SELECT event_id AS request_id, CASE WHEN doc_id IS NULL OR p >= len(pages) THEN 'There is no chunk ' || d || ':' || p || '.'
  WHEN NOT seen THEN 'The chunk is not among the sources of this conversation.'
  ELSE array_to_string(pages[greatest(p - p % 4, 0) + 1 : p + CASE WHEN p > 3 THEN p % 3 ELSE 1 END + 1], chr(10) || chr(10)) END AS answer
FROM r LEFT JOIN v ON doc_id = d""")
def chunk_context(spark, tables):
    lines = tables("documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    chunks = lines.select(F.concat_ws(":", "document_id", "chunk_index").alias("chunk_id"), "document_id", F.col("document_id").alias("revision_id"), "chunk_index", "text")
    return L.contexts_read(requests(tables), chunks)


@query("tools_list_documents", "SELECT document_id, source AS doc_type FROM (SELECT doc_id::VARCHAR AS document_id, source, lang, text FROM documents WHERE doc_id % 7 <> 0) WHERE lang = 'en' AND (contains(lower(text), 'data') OR list_contains(string_split(text, ' '), 'data')) ORDER BY document_id LIMIT 50")
def list_documents(spark, tables):
    status = F.when(F.col("doc_id") % 7 != 0, "ready").otherwise("running")
    rows = tables("documents").select(F.col("doc_id").cast("string").alias("document_id"), status.alias("status"), F.col("text").alias("title"), F.split("text", " ").alias("keywords"), F.col("source").alias("doc_type"), "lang")
    return L.documents_listed(rows, text="data", lang="en", limit=80).select("document_id", "doc_type")


@query("chat_scope_checked", """WITH r AS (
  SELECT event_id, user_id % 5 AS owner, CASE event_type WHEN 'view' THEN 'all' WHEN 'error' THEN 'some' ELSE 'selected' END AS scope,
         CASE WHEN event_type <> 'signup' THEN CASE WHEN event_id % 1100 = user_id THEN [user_id] ELSE [event_id % 1100, user_id] END ELSE [] END AS ids
  FROM events),
lost AS (
  SELECT event_id, string_agg(id::VARCHAR, ', ' ORDER BY place) AS lost
  FROM (SELECT event_id, owner, unnest(ids) AS id, unnest(range(len(ids))) AS place FROM r WHERE scope = 'selected')
  WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = id AND doc_id % 5 = owner) GROUP BY event_id)
SELECT event_id AS request_id,
  CASE WHEN scope = 'all' THEN '' WHEN scope = 'selected' AND len(ids) > 0 AND lost IS NULL THEN array_to_string(ids, ',') END AS document_ids,
  CASE WHEN scope = 'some' THEN 'The scope is neither all nor selected.' WHEN scope = 'selected' AND len(ids) = 0 THEN 'No document is selected.' WHEN lost IS NOT NULL THEN 'Not available: ' || lost END AS error
FROM r LEFT JOIN lost USING (event_id)""")
def scope_checked(spark, tables):
    text = lambda c: c.cast("string")
    scope = F.when(F.col("event_type") == "view", "all").when(F.col("event_type") == "error", "some").otherwise("selected")
    ids = F.when(F.col("event_type") != "signup", F.array(text(F.col("event_id") % 1100), text(F.col("user_id"))))
    asked = tables("events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 5).alias("owner"), scope.alias("scope"), ids.alias("document_ids"))
    held = tables("documents").select(text(F.col("doc_id")).alias("document_id"), (F.col("doc_id") % 5).alias("owner"))
    return L.scopes_checked(asked, held).select("request_id", F.array_join("document_ids", ",").alias("document_ids"), "error")


@query("files_attachment_text", r"""WITH a AS (
  SELECT doc_id // 5 AS attachment, count(*) AS page_count,
         avg((length(text) >= 120 AND len(regexp_extract_all(text, '[\p{L}\p{N}]')) / greatest(length(text), 1) >= 0.5)::INT) >= 0.6 AND NOT bool_or(regexp_matches(text, '^[A-F]')) AS is_digital,
         regexp_replace(string_agg(text, chr(12) ORDER BY doc_id), '^\s+|\s+$', '', 'g') AS text, list(doc_id ORDER BY doc_id)[1:4] AS rendered
  FROM documents GROUP BY 1)
SELECT attachment, page_count, is_digital, CASE WHEN is_digital THEN md5(text) END AS digest, CASE WHEN NOT is_digital THEN array_to_string(rendered, ',') END AS rendered FROM a""")
def attachment_text(spark, tables):
    pages = tables("documents").select(F.expr("doc_id div 5").alias("attachment"), "doc_id", "text")
    rows = L.attachments_read(pages, ["attachment"], "doc_id", "text", T.digital_page(F.col("text")), F.col("text").rlike("^[A-F]"))
    return rows.select("attachment", "page_count", "is_digital", F.md5("text").alias("digest"), F.array_join("rendered", ",").alias("rendered"))
