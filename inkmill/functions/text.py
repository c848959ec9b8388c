"""Text and Unicode scalars as Column expressions; all stay inside the JVM but nfkc."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkmill.functions.core import let

# The character sets by which Arabic text is normalised and judged.
MARKS = "[\u064b-\u065f\u0670\u06d6-\u06ed\u0640]"
FOLD_FROM = "\u0623\u0625\u0622\u0671\u0649\u0629\u0624\u0626" + "".join(chr(0x0660 + i) for i in range(10)) + "".join(chr(0x06F0 + i) for i in range(10))
FOLD_TO = "\u0627\u0627\u0627\u0627\u064a\u0647\u0648\u064a" + "0123456789" * 2
ARABIC = "\u0600-\u06ff\ufb50-\ufdff\ufe70-\ufeff"
PRESENTATION = "\ufb50-\ufdff\ufe70-\ufeff"
FINAL_FORMS = "\ufe82\ufe84\ufe88\ufe8a\ufe8e\ufe90\ufe94\ufe96\ufe9a\ufe9e\ufea2\ufea6\ufeaa\ufeac\ufeae\ufeb0\ufeb2\ufeb6\ufeba\ufebe\ufec2\ufec6\ufeca\ufece\ufed2\ufed6\ufeda\ufede\ufee2\ufee6\ufeea\ufeee\ufef0\ufef2"
UNICODE_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def text_or_empty(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def ar_normalize(t: Column) -> Column:
    """Drops vowel marks, folds letter variants and both Arabic digit ranges, lower-cases.

    All but the last concern one Unicode block, so texts without any of it are lower-cased only.
    """
    return F.lower(F.when(t.rlike("[\u0600-\u06ff]"), F.translate(F.regexp_replace(t, MARKS, ""), FOLD_FROM, FOLD_TO)).otherwise(t))


@F.pandas_udf(StringType())
def nfkc(t: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no function; null gives an empty text."""
    return t.map(lambda x: unicodedata.normalize("NFKC", x) if x else "")


def count_of(t: Column, pattern: str) -> Column:
    return F.regexp_count(text_or_empty(t), F.lit(pattern))


def length_without(t: Column, pattern: str) -> Column:
    """Characters left when runs of the pattern are taken out: cheaper than to count each of the others."""
    return F.length(F.regexp_replace(text_or_empty(t), pattern, ""))


def arabic_char_ratio(t: Column) -> Column:
    """Arabic letters by letters; 0 without letters."""
    arabic = F.when(text_or_empty(t).rlike(rf"[\p{{L}}&&[{ARABIC}]]"), length_without(t, rf"[^\p{{L}}]+|[^{ARABIC}]+")).otherwise(0)
    return let(F.struct(length_without(t, r"\P{L}+").alias("letters"), arabic.alias("arabic")), lambda n: F.when(n["letters"] == 0, 0.0).otherwise(n["arabic"] / n["letters"]))


def has_presentation_forms(t: Column) -> Column:
    return text_or_empty(t).rlike(f"[{PRESENTATION}]")


def lang_of(ratio: Column) -> Column:
    return F.when(ratio > 0.6, "ar").when(ratio < 0.15, "en").otherwise("mixed")


def direction_of(ratio: Column) -> Column:
    return F.when(ratio > 0.4, "rtl").otherwise("ltr")


def detect_lang(t: Column) -> Column:
    return let(arabic_char_ratio(t), lang_of)


def text_direction(t: Column) -> Column:
    return direction_of(arabic_char_ratio(t))


def language_report(t: Column) -> Column:
    """ratio (of arabic_char_ratio), lang_tag and direction; letters are counted once."""
    return let(arabic_char_ratio(t), lambda r: F.struct(r.alias("ratio"), lang_of(r).alias("lang_tag"), direction_of(r).alias("direction")))


def bidi_report(t: Column) -> Column:
    """Runs of Arabic: how many, with presentation forms, starting with a final form, that share, and whether it is suspect."""
    runs = F.regexp_extract_all(text_or_empty(t), F.lit(f"[{ARABIC}]+"), 0)
    n = F.size(runs)
    final = F.size(F.filter(runs, lambda r: r.rlike(f"^[{FINAL_FORMS}]")))
    share = F.when(n == 0, 0.0).otherwise(final / n)
    return F.struct(n.alias("runs"), F.size(F.filter(runs, lambda r: r.rlike(f"[{PRESENTATION}]"))).alias("with_presentation"), final.alias("starting_final"), F.round(share, 4).alias("final_ratio"), (share > 0.15).alias("suspect"))


def graphemes(t: Column) -> Column:
    """Extended grapheme clusters."""
    return F.regexp_extract_all(text_or_empty(t), F.lit(r"\X"), 0)


def words(t: Column) -> Column:
    """Words between runs of Unicode white space."""
    return F.filter(F.split(text_or_empty(t), UNICODE_SPACE), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def gibberish_score(t: Column) -> Column:
    """From 0 to 1, higher is worse: broken, control and single characters, word lengths, presentation forms. Blank is 1."""
    n = F.length(t)
    arabic = count_of(t, f"[{ARABIC}]")
    forms = F.when(arabic == 0, 0.0).otherwise(count_of(t, f"[{PRESENTATION}]") / arabic)
    broken = 2.0 * count_of(t, "[\ufffd\ufffe]") / n + 2.0 * count_of(t, r"[\x00-\x08\x0b\x0e-\x1f]") / n

    def score(w: Column) -> Column:
        total = F.size(w)
        single = F.size(F.filter(w, lambda x: F.length(x) == 1)) / total
        mean = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / total
        length = F.when(mean.between(2, 14), 0.0).otherwise(F.least(F.lit(1.0), F.abs(mean - 8) / 12))
        whole = broken + 0.6 * single + 0.5 * length + 0.8 * forms
        return F.when(total == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole)))

    return F.when(t.isNull(), 1.0).otherwise(let(words(t), score))


def heuristic_tokens(t: Column) -> Column:
    """Estimated tokens: by script, whole part plus one; 0 if empty. Arabic digits count as both."""
    arabic, digits = count_of(t, "[\u0600-\u06ff]"), count_of(t, r"\p{Nd}")
    latin = F.length(t) - arabic - digits
    return F.when(text_or_empty(t) == "", 0).otherwise((arabic / 2.7 + latin / 4.0 + digits / 2.0).cast("int") + 1)


def digital_page(t: Column) -> Column:
    """A page whose text layer is worth using: 120 characters, half of them letters or digits."""
    n = F.length(text_or_empty(t))
    return (n >= 120) & (count_of(t, r"[\p{L}\p{N}]") / F.greatest(n, F.lit(1)) >= 0.5)


def humanize_key(key: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.regexp_replace(key, "[_-]+", " "), "([a-z])([A-Z])", "$1 $2"))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, F.lit(2), F.length(spaced))))


def human_bytes(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.concat(F.round(size / 1024, 0).cast("long").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", F.round(size / 1024**2, 1)), F.lit(" MB")))
    )


def human_duration(ms: Column) -> Column:
    s = F.round(ms / 1000, 0).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def relative_time(seconds: Column) -> Column:
    """Value and unit of a difference in seconds: the largest unit that it reaches, half up as JavaScript rounds."""
    chain = None
    for unit, size in (("year", 31_536_000), ("month", 2_592_000), ("week", 604_800), ("day", 86_400), ("hour", 3_600), ("minute", 60)):
        value = F.struct(F.floor(seconds / size + 0.5).cast("long").alias("value"), F.lit(unit).alias("unit"))
        test = F.abs(seconds) >= size
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(F.struct(seconds.cast("long").alias("value"), F.lit("second").alias("unit")))


def status_bucket(status: Column) -> Column:
    return (
        F.when(status.isin("ocr_failed", "failed", "preprocessed", "ocr_done", "uploaded"), "attention")
        .when(status.isin("indexed", "ready"), "ready")
        .otherwise("processing")
    )


#: Extensions that generated files may have (fixed values).
FILE_TYPES = [".png", ".jpg", ".jpeg", ".svg", ".pdf", ".docx", ".xlsx", ".pptx", ".csv", ".txt", ".json", ".md"]


def safe_filename(name: Column) -> Column:
    """A plain base name with an allowed extension, else null."""
    base = F.trim(F.regexp_extract(text_or_empty(name), r"([^/]*)$", 1))
    extension = F.regexp_extract(base, r"^.*[^.].*?(\.[^.]*)$|^[^.]+(\.[^.]*)$", 0)
    ext = F.lower(F.when(extension != "", F.regexp_extract(base, r"(\.[^.]*)$", 1)).otherwise(""))
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    clean = F.regexp_replace(F.regexp_replace(stem, r"(?U)[^\w.\- ]+", "_"), r"^[ ._]+|[ ._]+$", "")
    cut = F.substring(clean, 1, 120)
    return F.when(ext.isin(FILE_TYPES), F.concat(F.when(cut == "", "file").otherwise(cut), ext))


def html_escape(t: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(raw), F.lit(entity))
    return t


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def vector_literal(v: Column) -> Column:
    # Rounding to even loses the sign of what becomes zero.
    sign = lambda x: F.when(x.cast("string").startswith("-"), "-").otherwise("")
    digits = lambda x: F.format_string("%.7f", F.abs(F.bround(x.cast("double"), 7)))
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.concat(sign(x), digits(x))), ","), F.lit("]"))
