"""Queries over rules whose inputs the supplied tables do not hold as such: Arabic letters, layouts, answers and proposals are made from their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.functions import conversation as K
from inkmill.functions import edits as G
from inkmill.functions import layout as L
from inkmill.functions import metadata as E
from inkmill.functions import records as P
from inkmill.functions import sql
from inkmill.functions import text as T
from inkmill.plans.base import query
from inkmill.plans.text import language_of, language_sql

A, FORMS = T.ARABIC, T.PRESENTATION
#: Every second document in Arabic letters: variants to be folded, vowel marks, presentation forms, and both kinds of digits.
LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz0123456789", "أإآٱىةؤئَّـلمنوﻢﻼﺮستﺎ١۲ﷲيع٠١٢٣٤۵۶۷۸۹"
TEXTS = f"(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, '{LATIN}', '{ARABIC}') ELSE text END AS text FROM documents)"
NORMAL = f"SELECT doc_id, lower(translate(regexp_replace(text, '{T.MARKS}', '', 'g'), '{T.FOLD_FROM}', '{T.FOLD_TO}')) AS norm FROM {TEXTS}"


def texts(tables):
    return tables("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.translate("text", LATIN, ARABIC)).otherwise(F.col("text")).alias("text"))


@query("text_ar_normalize", NORMAL)
def ar_normalize(spark, tables):
    return texts(tables).select("doc_id", T.ar_normalize(F.col("text")).alias("norm"))


@query("text_sql_function", NORMAL)
def sql_function(spark, tables):
    sql.register(spark)
    return texts(tables).selectExpr("doc_id", "ar_normalize(text) AS norm")


@query("text_language_arabic", language_sql(TEXTS, "doc_id"))
def language(spark, tables):
    return language_of(texts(tables))


@query("text_bidi_report", f"""WITH r AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[{A}]+') AS runs FROM {TEXTS})
SELECT doc_id, len(runs)::INTEGER AS runs, len(list_filter(runs, lambda x: regexp_matches(x, '[{FORMS}]')))::INTEGER AS with_presentation,
 len(list_filter(runs, lambda x: regexp_matches(x, '^[{T.FINAL_FORMS}]')))::INTEGER AS starting_final,
 CASE WHEN len(runs) = 0 THEN 0.0 ELSE round(len(list_filter(runs, lambda x: regexp_matches(x, '^[{T.FINAL_FORMS}]')))::DOUBLE / len(runs), 4) END AS final_ratio,
 CASE WHEN len(runs) = 0 THEN false ELSE len(list_filter(runs, lambda x: regexp_matches(x, '^[{T.FINAL_FORMS}]')))::DOUBLE / len(runs) > 0.15 END AS suspect FROM r""")
def bidi(spark, tables):
    return texts(tables).select("doc_id", T.bidi_report(F.col("text")).alias("r")).select("doc_id", "r.*")


#: Of the compatibility forms these are the ones that the texts hold.
COMPATIBLE = {"ﻢ": "م", "ﻼ": "لا", "ﺮ": "ر", "ﺎ": "ا", "ﷲ": "الله", "…": "..."}
REPLACED = "text"
for form, plain in COMPATIBLE.items():
    REPLACED = f"replace({REPLACED}, '{form}', '{plain}')"


@query("text_nfkc", f"SELECT doc_id, nfc_normalize({REPLACED}) AS nfkc FROM {TEXTS}")
def nfkc(spark, tables):
    return texts(tables).select("doc_id", T.nfkc(F.col("text")).alias("nfkc"))


ORDERS = """SELECT o_orderkey, lower(o_orderpriority) || '__totalPrice' AS key, o_orderkey * 977 % 6000000 AS size, o_totalprice AS ms, o_custkey * 104729 % 80000000 - 40000000 AS seconds,
 ['ready', 'ocr_running', 'failed', 'text_finalized', 'uploaded', 'nonsense'][o_orderkey % 6 + 1] AS status, '<' || o_orderstatus || ' & "' || o_orderpriority || '">' AS file FROM orders"""


def unit(sizes):
    return " ".join(f"WHEN abs(seconds) >= {n} THEN {{}}".replace("{}", v) for n, v in sizes)


UNITS = (("year", 31536000), ("month", 2592000), ("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60))


@query("text_display_formats", f"""WITH k AS (SELECT *, trim(regexp_replace(regexp_replace(key, '[_-]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')) AS s, CAST(round(ms / 1000) AS BIGINT) AS t FROM ({ORDERS}))
SELECT o_orderkey, upper(s[1]) || lower(s[2:]) AS label, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN CAST(round(size / 1024.0) AS BIGINT) || ' KB' ELSE printf('%.1f', round(size / 1048576.0, 1)) || ' MB' END AS bytes,
 CASE WHEN t < 60 THEN t || 's' ELSE (t // 60) || 'm ' || (t % 60) || 's' END AS duration, CASE {unit([(n, f"CAST(floor(seconds / {n}.0 + 0.5) AS BIGINT)") for _, n in UNITS])} ELSE seconds END AS ago, CASE {unit([(n, f"'{u}'") for u, n in UNITS])} ELSE 'second' END AS unit,
 CASE WHEN status IN ('ocr_failed', 'failed', 'preprocessed', 'ocr_done', 'uploaded') THEN 'attention' WHEN status IN ('indexed', 'ready') THEN 'ready' ELSE 'processing' END AS bucket,
 replace(replace(replace(replace(file, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM k""")
def formats(spark, tables):
    rows = tables("orders").selectExpr("o_orderkey", "lower(o_orderpriority) || '__totalPrice' AS key", "o_orderkey * 977 % 6000000 AS size", "o_totalprice AS ms", "o_custkey * 104729 % 80000000 - 40000000 AS seconds", "get(array('ready', 'ocr_running', 'failed', 'text_finalized', 'uploaded', 'nonsense'), cast(o_orderkey % 6 AS int)) AS status", """'<' || o_orderstatus || ' & "' || o_orderpriority || '">' AS file""")
    c = F.col
    return rows.select("o_orderkey", T.humanize_key(c("key")).alias("label"), T.human_bytes(c("size")).alias("bytes"), T.human_duration(c("ms")).alias("duration"), T.relative_time(c("seconds"))["value"].alias("ago"), T.relative_time(c("seconds"))["unit"].alias("unit"), T.status_bucket(c("status")).alias("bucket"), T.html_escape(c("file")).alias("escaped"))


NAMES = "CASE page_id % 6 WHEN 0 THEN url || '/report ' || page_id || '.PDF' WHEN 1 THEN 'a<' || page_id || '>b.csv' WHEN 2 THEN 'run' || page_id || '.sh' WHEN 3 THEN '...md' WHEN 4 THEN '.txt' ELSE '../résumé ' || page_id || '.docx' END"


@query("text_safe_filename", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'report ' || page_id || '.pdf' WHEN 1 THEN 'a_' || page_id || '_b.csv' WHEN 5 THEN 'résumé ' || page_id || '.docx' END AS safe FROM pages")
def filenames(spark, tables):
    return tables("pages").select("page_id", T.safe_filename(F.expr(NAMES)).alias("safe"))


@query("chat_citations", r"""WITH m AS (SELECT conv_id, turn, text, 'a1b2c3' AS a, 'd4e5f6-' || turn % 3 AS b FROM conversations)
SELECT conv_id, turn, regexp_replace(text || CASE conv_id % 3 WHEN 0 THEN ' [1] and [2] end' WHEN 1 THEN ' [1] and  end' ELSE '  and  end' END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS display,
 CASE conv_id % 3 WHEN 0 THEN a || ',' || b WHEN 1 THEN a ELSE CASE WHEN turn % 2 = 0 THEN 'c0ffee0,c0ffee1,c0ffee2,c0ffee3,c0ffee4' ELSE '' END END AS cited, CASE WHEN conv_id % 3 < 2 THEN 'explicit' WHEN turn % 2 = 0 THEN 'implicit' ELSE 'none' END AS mode FROM m""")
def citations(spark, tables):
    """Markers of retrieved chunks and of others behind every message; thoughts are taken out."""
    a, b = F.lit("a1b2c3"), F.concat(F.lit("d4e5f6-"), (F.col("turn") % 3).cast("string"))
    text = F.concat(F.lit("<think>[[cite:c0ffee0]]</think>"), F.col("text"), F.lit(" [[cite:"), a, F.lit("]] and [[cite:"), b, F.lit("]] end"))
    third, others = F.col("conv_id") % 3, F.transform(F.sequence(F.lit(0), F.lit(6)), lambda n: F.concat(F.lit("c0ffee"), n.cast("string")))
    known = F.when(third == 0, F.array(b, a)).when(third == 1, F.array(a)).when(F.col("turn") % 2 == 0, others).otherwise(F.array().cast("array<string>"))
    return tables("conversations").select("conv_id", "turn", K.resolve_citations(text, known).alias("r")).select("conv_id", "turn", "r.display", F.array_join("r.cited", ",").alias("cited"), "r.mode")


@query("chat_attachment_budget", f"""WITH RECURSIVE f AS (SELECT doc_id // 8 AS message, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS i, length(source || '.txt') AS name, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE length(text) END AS n FROM documents),
r AS (SELECT DISTINCT message, 0::BIGINT AS i, {K.TEXT_BUDGET}::BIGINT AS budget, 0::BIGINT AS blocks, 1::BIGINT AS characters FROM f UNION ALL
 SELECT message, i, CASE WHEN n > 0 THEN budget - body ELSE budget END, blocks + 1, characters + 2 + 27 + name + CASE WHEN n > 0 THEN 4 + 2 + body + 14 ELSE 5 + length('>' || chr(10) || '[shown as 2 image(s) below]' || chr(10) || '</attachment>') END
 FROM (SELECT f.*, r.budget, r.blocks, r.characters, CASE WHEN n > budget THEN greatest(budget, 0) + length('{K.CUT_NOTICE}') ELSE n END AS body FROM r JOIN f ON f.message = r.message AND f.i = r.i + 1))
SELECT message, max(blocks) AS blocks, max(characters) AS characters FROM r GROUP BY message""")
def attachments(spark, tables):
    """Eight documents as the files of a message, every seventh one an image."""
    image = F.col("doc_id") % 7 == 0
    file = F.struct(F.col("doc_id").alias("pos"), F.concat("source", F.lit(".txt")).alias("filename"), F.when(image, "image").otherwise("text").alias("kind"), F.when(image, "").otherwise(F.col("text")).alias("text"), F.when(image, 2).otherwise(0).alias("images"))
    rows = tables("documents").groupBy(F.expr("doc_id div 8").alias("message")).agg(F.array_sort(F.collect_list(file)).alias("a"))  # eight a message
    return rows.select("message", F.size(K.attachment_blocks(F.col("a"))).cast("long").alias("blocks"), F.length(K.human_content(F.lit("q"), F.col("a"))).cast("long").alias("characters"))


@query("chat_json_answers", """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{"a": ' || conv_id || '}' WHEN 3 THEN '{"b": [' || turn || ']}' ELSE '{}' END AS answer FROM conversations""")
def json_answers(spark, tables):
    raw = F.expr("""CASE turn % 4 WHEN 0 THEN '```json\\n{"a": ' || conv_id || '}\\n```' WHEN 1 THEN '{bad ' || conv_id WHEN 2 THEN '[' || conv_id || ']' ELSE ' {"b": [' || turn || ']} ' END""")
    return tables("conversations").select("conv_id", "turn", K.json_answer(raw).alias("answer"))


PAGE = "'Quote: EUR ' || doc_id || ',500 sent on demand. ' || text"
#: By kind: start and end of the span, the original and what replaces it; n is the length of the amount.
PROPOSALS = [
    ("11", "11 + n", "amount", "doc_id || ',501'"), ("0", "5", "'Quote'", "'Quotes'"), ("7", "10", "'EUR'", "'EUR'"), ("7", "10", "'ERU'", "'EUR'"), ("-1", "5", "'x'", "'y'"),
    ("7", "10", "'EUR'", "'money of the union, in all its states'"), ("12 + n", "16 + n", "'sent'", "'zzzz'"), ("17 + n", "19 + n", "'on'", "'nو'"), ("7", "10", "'EUR'", "'E U R'"), ("9", "5", "'x'", "'y'"),
]
PICKED = ", ".join(f"CASE doc_id % 10 {' '.join(f'WHEN {k} THEN {p[i]}' for k, p in enumerate(PROPOSALS))} END AS {name}" for i, name in enumerate(("span_start", "span_end", "original", "replacement")))
PROPOSED = f"SELECT doc_id, page, {PICKED} FROM (SELECT *, length(amount) AS n FROM (SELECT doc_id, doc_id || ',500' AS amount, {PAGE} AS page FROM documents))"


@query("edits_guard_rules", f"""SELECT doc_id, CASE WHEN span_start < 0 OR span_end < span_start THEN 'invalid_span' WHEN substring(page, span_start + 1, span_end - span_start) <> original THEN 'span_mismatch' WHEN original = replacement THEN 'no_op'
 WHEN span_start < 5 AND span_end > 0 THEN 'consensus_locked' WHEN length(replacement) > 2.5 * length(original) + 10 THEN 'expansion' WHEN levenshtein(original, replacement)::DOUBLE / greatest(length(original), length(replacement), 1) > 0.6 THEN 'too_dissimilar'
 WHEN (regexp_matches(replacement, '{G.ARABIC_SCRIPT}') AND NOT regexp_matches(original, '{G.ARABIC_SCRIPT}')) OR (regexp_matches(replacement, '[A-Za-z]') AND NOT regexp_matches(original, '[A-Za-z]')) THEN 'script_switch'
 WHEN len(list_filter(regexp_extract_all(replacement, '[0-9]'), lambda d: NOT contains(original, d) AND d <> '7')) > 0 THEN 'digit_invented' END AS rule FROM ({PROPOSED})""")
def rules(spark, tables):
    """A proposal for every document; all rules come up."""
    rows = tables("documents").selectExpr("doc_id", "doc_id || ',500' AS amount", f"{PAGE} AS page").selectExpr("*", "length(amount) AS n").selectExpr("doc_id", "page", *PICKED.replace(", CASE doc_id", "\x00CASE doc_id").split("\x00"))
    change = F.struct(F.col("span_start").cast("int").alias("span_start"), F.col("span_end").cast("int").alias("span_end"), "original", "replacement", F.lit(0.9).alias("confidence"), F.lit("digit").alias("kind"))
    return rows.select("doc_id", G.rule(F.col("page"), change, F.array(F.struct(F.lit(0).alias("s"), F.lit(5).alias("e"))), F.array(F.lit("7"))).alias("rule"))


@query("edits_applied", f"""SELECT doc_id, 'Quotes: E U R ' || substring(page, 12) AS text, 2 AS kept, 8 AS chars_touched, 8.0 / length(page) > {G.REVIEW_SHARE} AS needs_review, CASE WHEN 8.0 / length(page) > {G.REVIEW_SHARE} THEN '' ELSE '1-0-5,1-7-10' END AS auto_accepted FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {PAGE} ELSE substring({PAGE}, 1, 20) END AS page FROM documents)""")
def applied(spark, tables):
    """Of three proposals one overlaps another of higher confidence; on short pages the changes touch too much to be accepted unseen."""
    change = lambda a, b, old, new, c, kind: F.struct(F.lit(a).alias("span_start"), F.lit(b).alias("span_end"), F.lit(old).alias("original"), F.lit(new).alias("replacement"), F.lit(c).alias("confidence"), F.lit(kind).alias("kind"))
    changes = F.array(change(7, 10, "EUR", "E U R", 0.9, "spacing"), change(8, 11, "UR ", "UR_", 0.5, "spacing"), change(0, 5, "Quote", "Quotes", 0.95, "letterform"))
    rows = tables("documents").select("doc_id", F.expr(f"CASE WHEN doc_id % 2 = 0 THEN {PAGE} ELSE substring({PAGE}, 1, 20) END").alias("page"))
    none = F.array().cast("array<struct<s:int,e:int>>"), F.array().cast("array<string>")
    kept = rows.withColumn("kept", G.without_overlaps(G.guarded(F.col("page"), changes, *none))).withColumn("r", G.review(F.col("page"), F.col("kept")))
    ids = F.transform(F.filter("kept", lambda c: G.auto_accept(c, F.col("r.needs_review"))), lambda c: G.change_id(F.lit(1), c))
    return kept.select("doc_id", G.apply_changes(F.col("page"), F.col("kept")).alias("text"), F.size("kept").alias("kept"), "r.chars_touched", "r.needs_review", F.array_join(ids, ",").alias("auto_accepted"))


KINDS = ["Tax Invoice", "lease-agreement", "ID", "nothing", "Court ruling", ""]
CODES = ["ara", "English", "", "de", " fr ", "eng"]
FIELDS = ["Money", "weird", " date ", "person", "org", ""]
pick = lambda values, open_, close, by: f"{open_}{', '.join(repr(v) for v in values)}{close}".replace("BY", by)
MADE = "'Annual  ' || source || ' (' || lang || ') Déjà-' || doc_id AS field, 'issued 2026-02-' || lpad(CAST(doc_id % 35 AS VARCHAR(2)), 2, '0') || ' or 2024-01-01' AS day"


@query("enrich_coercions", f"""WITH v AS (SELECT *, regexp_replace(lower(trim(kind)), '[ -]', '_', 'g') AS k, substring(lower(trim(code)), 1, 3) AS l FROM (SELECT doc_id, {pick(KINDS, '[', '][doc_id % 6 + 1]', '')} AS kind, {pick(CODES, '[', '][doc_id % 6 + 1]', '')} AS code, {pick(FIELDS, '[', '][doc_id % 6 + 1]', '')} AS ftype, {MADE} FROM documents))
SELECT doc_id, CASE WHEN k IN ('{"', '".join(E.DOC_TYPES)}') THEN k {' '.join(f"WHEN contains(k, '{w}') THEN '{t}'" for w, t in E.DOC_TYPE_WORDS.items())} ELSE 'other' END AS doc_type,
 CASE WHEN trim(code) = '' THEN 'en' WHEN l = 'ara' THEN 'ar' WHEN l = 'eng' THEN 'en' ELSE substring(l, 1, 2) END AS lang,
 substring(regexp_replace(regexp_replace(regexp_replace(lower(trim(field)), '[^\\p{{L}}\\p{{N}}_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) AS field_key,
 CASE WHEN lower(trim(ftype)) IN ('{"', '".join(E.FIELD_TYPES)}') THEN lower(trim(ftype)) ELSE 'string' END AS field_type, CAST(try_cast(nullif(regexp_extract(day, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS DATE) AS VARCHAR) AS day FROM v""")
def coercions(spark, tables):
    at = ")[cast(doc_id % 6 AS int)]"
    rows = tables("documents").selectExpr("doc_id", f"{pick(KINDS, 'array(', at, '')} AS kind", f"{pick(CODES, 'array(', at, '')} AS code", f"{pick(FIELDS, 'array(', at, '')} AS ftype", *MADE.split(", 'issued")[:1], "'issued" + MADE.split(", 'issued")[1])
    c = F.col
    return rows.select("doc_id", E.doc_type(c("kind")).alias("doc_type"), E.primary_language(c("code")).alias("lang"), E.field_key(c("field")).alias("field_key"), E.field_type(c("ftype")).alias("field_type"), E.iso_date(c("day")).cast("string").alias("day"))


@query("enrich_hijri_dates", f"""WITH d AS (SELECT doc_id, doc_id % 3 < 2 AS fine, (1400 + doc_id % 61)::INTEGER AS year, (doc_id % 12 + 1)::INTEGER AS month, (doc_id % 29 + 1)::INTEGER AS day FROM documents)
SELECT doc_id, CASE WHEN fine THEN year END AS year, CASE WHEN fine THEN month END AS month, CASE WHEN fine THEN day END AS day,
 CASE WHEN fine THEN CAST(DATE '0622-07-18' + (day + ceil(29.5 * (month - 1)) + (year - 1) * 354 + floor((3 + 11 * year) / 30))::INTEGER AS VARCHAR) END AS gregorian FROM d""")
def hijri(spark, tables):
    """Dates in words, of which every third lacks its marker."""
    month = F.get(F.array(*map(F.lit, E.HIJRI_MONTHS)), (F.col("doc_id") % 12).cast("int"))
    value = F.concat_ws(" ", F.col("doc_id") % 29 + 1, month, F.translate((1400 + F.col("doc_id") % 61).cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩"), F.when(F.col("doc_id") % 3 == 0, "هـ").when(F.col("doc_id") % 3 == 1, "هجري").otherwise("م"))
    rows = tables("documents").select("doc_id", E.hijri_parts(value, T.ar_normalize).alias("p"))
    return rows.select("doc_id", "p.year", "p.month", "p.day", E.hijri_day(F.col("p")).cast("string").alias("gregorian"))


@query("enrich_languages", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'fr' ELSE lang END ELSE CASE WHEN doc_id % 2 = 0 AND lang <> 'fr' THEN 'fr,' ELSE '' END || CASE WHEN lang = 'en' THEN 'en,ar' ELSE lang || ',en,ar' END END AS langs FROM documents")
def langs(spark, tables):
    held = F.when(F.col("doc_id") % 5 != 0, F.array("lang", F.upper("lang"), F.lit("english"), F.lit(" "), F.lit("Arabic")))
    return tables("documents").select("doc_id", F.array_join(E.languages(held, F.when(F.col("doc_id") % 2 == 0, "fr").otherwise(F.col("lang"))), ",").alias("langs"))


BOX = "SELECT *, doc_id % 500 AS x0, n_chars % 400 AS y0, doc_id % 500 + 100 AS x1, n_chars % 400 + 700 AS y1 FROM documents"


@query("ocr_parse_layout", f"SELECT doc_id, 0 AS pos, CASE WHEN doc_id % 4 = 0 THEN source ELSE 'Text' END AS label, x0 / 1000.0 AS x0, y0 / 1000.0 AS y0, x1 / 1000.0 AS x1, least(y1 / 1000.0, 1.0) AS y1, CASE WHEN doc_id % 4 = 0 THEN n_chars ELSE 0 END AS n FROM ({BOX}) WHERE doc_id % 4 < 2")
def layout(spark, tables):
    """Boxes as text and as lists, within prose, upside down (dropped), and answers without any."""
    rows = tables("documents").selectExpr("*", "doc_id % 500 AS x0", "n_chars % 400 AS y0", "doc_id % 500 + 100 AS x1", "n_chars % 400 + 700 AS y1")
    raw = F.expr("""CASE doc_id % 4 WHEN 0 THEN '[{"label": "' || source || '", "bbox": "' || concat_ws(' ', x0, y0, x1, y1) || '", "count": ' || n_chars || '}, {"bbox": "1 2 3"}]' WHEN 1 THEN 'Here: [{"bbox": [' || concat_ws(', ', x0, y0, x1, y1) || ']}] done' WHEN 2 THEN '[{"bbox": "' || concat_ws(' ', x1, y0, x0, y1) || '"}]' ELSE 'none of ' || doc_id END""")
    return rows.select("doc_id", F.posexplode(L.parse_layout(raw)).alias("pos", "b")).select("doc_id", "pos", "b.label", "b.bbox.*", F.col("b.count").alias("n"))


@query("ocr_parse_layout_html", "SELECT page_id, 0 AS pos, CASE page_id % 3 WHEN 2 THEN 'a ' || page_id ELSE 'page ' || page_id || ' at ' || url END AS text, CASE page_id % 3 WHEN 0 THEN 'Text' WHEN 2 THEN 'Table' ELSE '' END AS label, CASE WHEN page_id % 3 = 0 THEN (page_id % 500) / 1000.0 END AS x0, CASE WHEN page_id % 3 = 0 THEN 0.9 END AS y1 FROM pages")
def layout_html(spark, tables):
    raw = F.expr("""CASE page_id % 3 WHEN 0 THEN '<div data-bbox="' || page_id % 500 || ' 10 990 900" data-label="Text"><p>page ' || page_id || ' at ' || url || '</p></div><div data-bbox="0 0 10 10" data-label="Picture">x</div>' WHEN 1 THEN 'page ' || page_id || ' at ' || url
 ELSE '<div data-label="Table" data-bbox="bad"><table><tr><td>a</td><td>' || page_id || '</td></tr></table></div>' END""")
    rows = tables("pages").select("page_id", F.posexplode(L.parse_layout_html(raw)).alias("pos", "b"))
    return rows.select("page_id", "pos", "b.text", "b.label", "b.bbox.x0", "b.bbox.y1")


@query("ocr_clean_answers", """WITH d AS (SELECT doc_id, 'w' || regexp_replace(text, '[^A-Za-z]+', ' ', 'g') || 'z' AS line, chr(10) AS nl FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN 'Sure thing' || nl || line WHEN 3 THEN line || nl || '```' || nl || '```' ELSE line END AS unwrapped, CASE doc_id % 4 WHEN 0 THEN 'Here is the transcription:' || nl || line WHEN 2 THEN 'Sure thing' || nl || line ELSE line END AS collapsed FROM d""")
def answers(spark, tables):
    """Announced, fenced, plain and badly fenced transcripts of all documents."""
    line = F.concat(F.lit("w"), F.regexp_replace("text", "[^A-Za-z]+", " "), F.lit("z"))
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("Here is the transcription:\n"), line)).when(kind == 1, F.concat(F.lit("```markdown\n"), line, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Sure thing\n"), line)).otherwise(F.concat(line, F.lit("\n```\n``` \n")))
    return tables("documents").select("doc_id", L.strip_preamble(raw).alias("unwrapped"), L.collapse_fenced_echo(raw).alias("collapsed"))


@query("ocr_engine_config", """SELECT o_orderkey, '--oem ' || CASE WHEN o_orderkey % 6 - 1 BETWEEN 0 AND 3 THEN o_orderkey % 6 - 1 ELSE 1 END || ' --psm ' || CASE WHEN o_custkey % 20 - 2 BETWEEN 0 AND 13 THEN o_custkey % 20 - 2 ELSE 3 END AS config,
 ['ara+eng', 'eng+ara', 'eng', 'eng'][o_orderkey % 4 + 1] AS langs FROM orders""")
def config(spark, tables):
    langs_ = F.get(F.array(*map(F.lit, ["ara,eng", "en,ar,xx", "", "eng,en"])), (F.col("o_orderkey") % 4).cast("int"))
    return tables("orders").select("o_orderkey", L.engine_config(F.col("o_orderkey") % 6 - 1, F.col("o_custkey") % 20 - 2).alias("config"), L.language_argument(F.split(langs_, ",")).alias("langs"))


@query("records_tool_hits", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id ELSE 'b' || user_id END AS chunk_id, CASE WHEN event_id % 3 = 0 THEN value ELSE 1.0 END AS score FROM events WHERE event_id % 3 <> 1")
def hits(spark, tables):
    raw = F.expr("""CASE event_id % 3 WHEN 0 THEN '[{"chunk_id": "c' || event_id || '", "document_id": "d", "score": ' || value || '}, {"chunk_id": ""}]' WHEN 1 THEN 'not json: ' || event_type ELSE '[{"document_id": "x"}, {"chunk_id": "b' || user_id || '", "score": 1}]' END""")
    return tables("events").select("event_id", F.explode(P.hits_of(raw)).alias("h")).select("event_id", "h.chunk_id", "h.score")
