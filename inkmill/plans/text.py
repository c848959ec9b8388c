"""Queries over text scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.functions import sql
from inkmill.functions import text as T
from inkmill.plans.base import query

A, P = T.ARABIC, T.PRESENTATION
WORDS = r"list_filter(regexp_split_to_array(text, '[\s\p{Z}\x1c-\x1f\x85]+'), lambda w: w <> '')"


RATIO = rf"""(CASE WHEN length(regexp_replace(coalesce(text, ''), '[^\p{{L}}]', '', 'g')) = 0 THEN 0.0 ELSE
 length(regexp_replace(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '[^{A}]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) END)"""


def language_sql(source: str, key: str) -> str:
    return f"""SELECT {key}, round({RATIO}, 6) AS arabic_ratio, CASE WHEN {RATIO} > 0.6 THEN 'ar' WHEN {RATIO} < 0.15 THEN 'en' ELSE 'mixed' END AS lang_tag,
 CASE WHEN {RATIO} > 0.4 THEN 'rtl' ELSE 'ltr' END AS direction, regexp_matches(coalesce(text, ''), '[{P}]') AS presentation FROM {source}"""


def language_of(texts):
    t = F.col("text")
    rows = texts.select("doc_id", T.language_report(t).alias("r"), T.has_presentation_forms(t).alias("presentation"))
    return rows.select("doc_id", F.round("r.ratio", 6).alias("arabic_ratio"), "r.lang_tag", "r.direction", "presentation")


@query("text_language", language_sql("documents", "doc_id"))
def language(spark, tables):
    return language_of(tables("documents"))


GIBBERISH = rf"""WITH d AS (SELECT doc_id, text, length(text)::DOUBLE AS n, {WORDS} AS w FROM documents),
m AS (SELECT *, list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) AS mean, len(list_filter(w, lambda x: length(x) = 1))::DOUBLE / len(w) AS single,
 len(regexp_extract_all(text, '[\x{{FFFD}}\x{{FFFE}}]')) / n AS broken, len(regexp_extract_all(text, '[\x00-\x08\x0b\x0e-\x1f]')) / n AS control FROM d)
SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * broken + 2.0 * control + 0.6 * single
 + 0.5 * (CASE WHEN mean BETWEEN 2 AND 14 THEN 0.0 ELSE least(1.0, abs(mean - 8) / 12) END))) END, 6) AS gibberish FROM m"""


@query("text_gibberish_score", GIBBERISH)
def gibberish(spark, tables):
    return tables("documents").select("doc_id", F.round(T.gibberish_score(F.col("text")), 6).alias("gibberish"))


@query("text_counts", rf"""SELECT doc_id, len({WORDS})::INTEGER AS n_words, length(text)::INTEGER AS n_characters,
 (CASE WHEN text = '' THEN 0 ELSE CAST(floor((length(text) - len(regexp_extract_all(text, '\p{{Nd}}'))) / 4.0 + len(regexp_extract_all(text, '\p{{Nd}}')) / 2.0) AS INTEGER) + 1 END)::INTEGER AS tokens,
 length(text) >= 120 AND len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]'))::DOUBLE / greatest(length(text), 1) >= 0.5 AS digital, substring(text, 1, 400) AS preview FROM documents""".replace("{{", "{").replace("}}", "}"))
def counts(spark, tables):
    t = F.col("text")
    return tables("documents").select("doc_id", T.word_count(t).alias("n_words"), F.length(t).alias("n_characters"), T.heuristic_tokens(t).alias("tokens"), T.digital_page(t).alias("digital"), F.substring(t, 1, 400).alias("preview"))


@query("text_graphemes", "SELECT doc_id, length_grapheme(text)::INTEGER AS n_graphemes FROM documents")
def graphemes(spark, tables):
    return tables("documents").select("doc_id", F.size(T.graphemes(F.col("text"))).alias("n_graphemes"))


@query("vector_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) ** 2)), 6) AS length, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def vectors(spark, tables):
    rows = tables("embeddings").select("vec_id", T.l2_normalize(F.col("embedding")).alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"), F.round(F.col("v")[0], 6).alias("first"))
