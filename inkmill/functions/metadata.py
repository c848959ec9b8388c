"""Validation and completion of extracted metadata; Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.core import let

# Document types, and words that stand for them in the order in which they are tried.
DOC_TYPES = ["contract", "invoice", "receipt", "letter", "report", "form", "id_document", "certificate", "academic", "legal", "medical", "manual", "other"]
DOC_TYPE_WORDS = {
    "agreement": "contract", "lease": "contract", "bill": "invoice", "tax_invoice": "invoice", "memo": "letter", "correspondence": "letter", "id": "id_document",
    "passport": "id_document", "diploma": "certificate", "transcript": "academic", "court": "legal", "ruling": "legal", "prescription": "medical",
}
FIELD_TYPES = ["string", "number", "date", "boolean", "string_array", "money", "person", "org"]
LIMITS = {"persons": 40, "organizations": 40, "locations": 40, "other": 40, "mentioned": 30, "ref_numbers": 20, "amounts": 20, "currencies": 10, "languages": 6, "keywords": 15, "topics": 10}
HIJRI_MONTHS = ["محرم", "صفر", "ربيع الأول", "ربيع الثاني", "جمادى الأولى", "جمادى الآخرة", "رجب", "شعبان", "رمضان", "شوال", "ذو القعدة", "ذو الحجة"]
SHORT, LONG = 400, 4000


def sample(text: Column) -> Column:
    """The head, and of texts of over 4000 characters the tail."""
    return F.when(F.length(text) > 4000, F.concat(F.substring(text, 1, 3000), F.lit("\n...\n"), F.right(text, F.lit(1000)))).otherwise(F.substring(text, 1, 3000))


def doc_type(value: Column) -> Column:
    v = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[ -]", "_")
    chain = F.when(v.isin(DOC_TYPES), v)
    for word, kind in DOC_TYPE_WORDS.items():
        chain = chain.when(v.contains(word), kind)
    return chain.otherwise("other")


def language_code(value: Column) -> Column:
    """Two letters; three-letter codes of the two main languages are known."""
    v = F.substring(F.lower(F.trim(value)), 1, 3)
    return F.when(v == "ara", "ar").when(v == "eng", "en").otherwise(F.substring(v, 1, 2))


def primary_language(value: Column) -> Column:
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", "en").otherwise(language_code(value))


def languages(values: Column, primary: Column) -> Column:
    """Distinct codes in order, the primary one first if it was missing."""
    codes = F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), language_code), lambda c: c != ""))
    return let(codes, lambda c: F.when(F.array_contains(c, primary), c).otherwise(F.array_prepend(c, primary)))


def truncated(text: Column, limit: int) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit - 1), r"[\s\p{Z}]+$", ""), F.lit("…")))


def deduped(values: Column) -> Column:
    """Trimmed, without blanks, the first of those that differ in case only."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")

    def firsts(c: Column) -> Column:
        # Sorted by lower case and place, the first of each kind stands behind another kind.
        keyed = F.array_sort(F.transform(c, lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"))))
        new = let(keyed, lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["k"] != x["k"])))
        return F.transform(F.array_sort(F.transform(new, lambda x: x["i"])), lambda i: F.get(c, i))

    return let(clean, firsts)


def within_limits(lists: dict[str, Column]) -> Column:
    """Whether every list keeps to its most entries."""
    fine = F.lit(True)
    for name, values in lists.items():
        fine = fine & (F.coalesce(F.size(values), F.lit(0)) <= LIMITS[name])
    return fine


def field_key(value: Column) -> Column:
    """snake_case of at most 48 characters."""
    v = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"(?U)\W+", "_"), "_+", "_")
    return F.substring(F.regexp_replace(v, "^_+|_+$", ""), 1, 48)


def field_type(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin(FIELD_TYPES), v).otherwise("string")


FIELD = "array<struct<key:string,label_en:string,label_ar:string,type:string,why:string>>"


def merged_fields(proposed: Column, required: Column) -> Column:
    """Proposals of confidence 0.6 or more, and all that the user requires (confidence 1); keys in first-seen order.

    proposed: structs (key, label_en, label_ar, type, why, example_value, confidence); required: structs
    of the first five. Required values win where given. A required field without a key takes its label's.
    """
    accepted = F.filter(proposed, lambda f: f["confidence"] >= 0.6)
    named = lambda r: F.coalesce(F.nullif(r["key"], F.lit("")), F.lower(F.regexp_replace(F.coalesce(r["label_en"], F.lit("")), r"(?U)\W+", "_")))
    asked = F.filter(F.transform(F.coalesce(required, F.array().cast(FIELD)), lambda r: F.struct(named(r).alias("key"), *[r[c].alias(c) for c in ("label_en", "label_ar", "type", "why")])), lambda r: r["key"] != "")

    def build(x: Column) -> Column:
        def entry(key: Column) -> Column:
            of = lambda name: F.get(F.reverse(F.filter(x[name], lambda f: f["key"] == key)), F.lit(0))
            mine, theirs, wanted = of("asked"), of("accepted"), F.exists(x["asked"], lambda r: r["key"] == key)
            pick = lambda c, default: F.when(wanted, F.coalesce(F.nullif(mine[c], F.lit("")), F.nullif(theirs[c], F.lit("")), default)).otherwise(theirs[c]).alias(c)
            example = F.when(wanted, F.coalesce(theirs["example_value"], F.lit(""))).otherwise(theirs["example_value"]).alias("example_value")
            return F.struct(key.alias("key"), pick("label_en", key), pick("label_ar", key), pick("type", F.lit("string")), pick("why", F.lit("requested by the user")), example, F.when(wanted, 1.0).otherwise(theirs["confidence"]).alias("confidence"), wanted.alias("user_required"))

        keys = F.array_distinct(F.concat(F.transform(x["accepted"], lambda f: f["key"]), F.transform(x["asked"], lambda r: r["key"])))
        return F.transform(keys, entry)

    return let(F.struct(accepted.alias("accepted"), asked.alias("asked")), build)


def iso_date(value: Column) -> Column:
    """The first y-m-d anywhere in the value, if the calendar has it."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), r"\d{4}-\d{2}-\d{2}", 0), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def hijri_parts(value: Column, normalize) -> Column:
    """Year, month and day of a Hijri date: a marker, a month's name, the first and last number; else null."""
    v = F.coalesce(value, F.lit(""))
    norm = normalize(v)
    numbers = F.regexp_extract_all(norm, F.lit(r"\d+"), 0)
    month = None
    for n, name in enumerate(HIJRI_MONTHS, 1):
        test = norm.contains(normalize(F.lit(name)))
        month = F.when(test, n) if month is None else month.when(test, n)
    fine = (v.contains("هـ") | v.contains("هجري")) & month.isNotNull() & (F.size(numbers) >= 2)
    return F.when(fine, F.struct(F.element_at(numbers, -1).cast("int").alias("year"), month.alias("month"), F.get(numbers, 0).cast("int").alias("day")))


def hijri_day(parts: Column) -> Column:
    """The Gregorian date by the tabular calendar (leap years 2, 5, 7, 10, 13, 16, 18, 21, 24, 26, 29 of 30); a day or two beside observed calendars at most."""
    days = parts["day"] + F.ceil(29.5 * (parts["month"] - 1)) + (parts["year"] - 1) * 354 + F.floor((3 + 11 * parts["year"]) / 30)
    valid = parts["month"].between(1, 12) & parts["day"].between(1, 30) & parts["year"].between(1, 9000)
    # Day 1 of year 1 is 16 July 622 of the Julian calendar, 19 July 622 of the Gregorian one.
    return F.when(valid, F.date_add(F.lit("0622-07-18").cast("date"), days.cast("int")))


def quality_flags(gibberish: Column, suspected: Column, required: Column, present: Column) -> Column:
    missing = F.transform(F.array_except(F.coalesce(required, F.array().cast("array<string>")), F.coalesce(present, F.array().cast("array<string>"))), lambda k: F.concat(F.lit("missing_required:"), k))
    flags = F.array(F.when(gibberish > 0.35, "low_ocr_quality"), F.when(suspected, "ocr_may_be_incomplete"))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(flags), missing)))


def windows(text: Column, most: int = 8000) -> Column:
    """Pages packed in order into windows of at most `most` characters; a longer page is a window of its own."""

    def add(state: Column, page: Column) -> Column:
        now = F.element_at(state, -1)
        full = (F.length(now) + F.length(page) > most) & (now != "")
        # An empty window takes the page as it is.
        joined = F.when(now == "", page).otherwise(F.concat(now, F.lit("\f"), page))
        return F.when(full, F.concat(state, F.array(page))).otherwise(F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(joined)))

    return F.filter(F.aggregate(F.split(F.coalesce(text, F.lit("")), "\f"), F.array(F.lit("")), add), lambda w: w != "")


def kept_windows(text: Column, most: int = 8) -> Column:
    """The windows of a text that are condensed: the first ones."""
    return F.slice(windows(text), 1, most)
