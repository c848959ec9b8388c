"""Queries over chunking and extracted metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.functions import metadata as E
from inkmill.functions.text import ar_normalize
from inkmill.operators import chunking as C
from inkmill.plans.base import query


@query("chunk_documents")
def chunked(spark, tables):
    return C.chunks(tables("documents"))


@query("chunk_headings", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM l)
SELECT doc_id, count(*) FILTER (length(t) BETWEEN 1 AND 80 AND (regexp_matches(t, '^\d+(\.\d+)*[.)\s]') OR (length(t) > 3 AND regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '[\p{Ll}\p{Lt}]')) OR (length(t) < 60 AND NOT regexp_matches(t, '[.،۔:;]$')))) AS headings FROM t GROUP BY doc_id""")
def headings(spark, tables):
    lines = tables("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(C.is_heading(F.col("line"))).alias("headings"))


@query("enrich_samples", "SELECT doc_id, CASE WHEN length(text) > 4000 THEN substring(text, 1, 3000) || chr(10) || '...' || chr(10) || right(text, 1000) ELSE substring(text, 1, 3000) END AS sample, CASE WHEN length(text) <= 400 THEN text ELSE regexp_replace(substring(text, 1, 399), '[\\s\\p{Z}]+$', '') || '…' END AS summary FROM documents")
def samples(spark, tables):
    return tables("documents").select("doc_id", E.sample(F.col("text")).alias("sample"), E.truncated(F.col("text"), E.SHORT).alias("summary"))


@query("enrich_keywords", r"""WITH w AS (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT doc_id, min(i) AS i, arg_min(v, i) AS v FROM t WHERE v <> '' GROUP BY doc_id, lower(v))
SELECT doc_id, coalesce(string_agg(v, ' ' ORDER BY i), '') AS keywords, count(v) <= 15 AS fits FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id""")
def keywords(spark, tables):
    words = E.deduped(F.split("text", "[ \n]+"))
    return tables("documents").select("doc_id", F.array_join(words, " ").alias("keywords"), E.within_limits({"keywords": words}).alias("fits"))


MERGED = r"""WITH f AS (SELECT doc_id, 0 AS o, lang AS key, upper(lang) AS label_en, 'a' AS label_ar, 'string' AS type, 'w' AS why, source AS example_value, (doc_id % 10) / 10.0 AS confidence, false AS user_required FROM documents WHERE (doc_id % 10) / 10.0 >= 0.6
UNION ALL SELECT doc_id, 1, source, CASE WHEN doc_id % 2 = 0 THEN 'Mine' ELSE upper(source) END, 'a', 'string', 'w', lang, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.6 END, doc_id % 2 = 0 FROM documents
UNION ALL SELECT doc_id, 2, regexp_replace(lower(source || ' x'), '\W+', '_', 'g'), source || ' x', regexp_replace(lower(source || ' x'), '\W+', '_', 'g'), 'date', 'requested by the user', '', 1.0, true FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o)::INTEGER - 1 AS pos, key, label_en, label_ar, type, why, example_value, confidence::DOUBLE AS confidence, user_required FROM f"""


@query("enrich_merge_fields", MERGED)
def fields(spark, tables):
    """Each document's language and source as proposals; even documents require the source, every third a field without a key."""
    i, names = F.col("doc_id"), ("key", "label_en", "label_ar", "type", "why")
    struct = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, (*names, "example_value", "confidence"))])
    proposed = F.array(struct(F.col("lang"), F.upper("lang"), F.lit("a"), F.lit("string"), F.lit("w"), F.col("source"), i % 10 / 10.0), struct(F.col("source"), F.upper("source"), F.lit("a"), F.lit("string"), F.lit("w"), F.col("lang"), F.lit(0.6)))
    own = F.when(i % 2 == 0, struct(F.col("source"), F.lit("Mine"), F.lit(""), F.lit(""), F.lit("")))
    new = F.when(i % 3 == 0, struct(F.lit(""), F.concat("source", F.lit(" x")), F.lit(None).cast("string"), F.lit("date"), F.lit("")))
    return tables("documents").select("doc_id", F.posexplode(E.merged_fields(proposed, F.array_compact(F.array(own, new)))).alias("pos", "f")).select("doc_id", "pos", "f.*")


@query("enrich_quality_flags", """SELECT d.doc_id, array_to_string(list_sort(list_filter([CASE WHEN n_chars % 100 > 35 THEN 'low_ocr_quality' END, CASE WHEN d.doc_id % 7 = 0 THEN 'ocr_may_be_incomplete' END, CASE WHEN l.doc_id IS NULL THEN 'missing_required:quality' END], lambda x: x IS NOT NULL)), ',') AS flags FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def flags(spark, tables):
    rows = tables("documents").join(tables("labels").select("doc_id", "quality"), "doc_id", "left")
    present = F.when(F.col("quality").isNotNull(), F.array(F.lit("quality"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.array_join(E.quality_flags((F.col("n_chars") % 100) / 100, F.col("doc_id") % 7 == 0, F.array(F.lit("quality")), present), ",").alias("flags"))


@query("enrich_page_windows")
def windows(spark, tables):
    return tables("documents").select("doc_id", F.posexplode(E.windows(F.replace("text", F.lit("\n"), F.lit("\f")))).alias("window", "text")).select("doc_id", "window", F.length("text").alias("n"))
