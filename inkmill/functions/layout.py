"""Parsing of what recognition engines return: HTML, layouts, merged pages, model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.core import let

#: Labels of blocks without text, and openings of model answers that are no transcript (fixed values).
SKIPPED_LABELS = ["Picture", "Figure", "Separator", "PageHeader", "PageFooter"]
PREAMBLES = ["here is the transcription", "here's the transcription", "the text in the image", "the transcribed text", "sure,", "certainly,"]
BLANK = r"[\s\p{Z}]"


def html_to_text(html: Column) -> Column:
    """Flat text of an HTML fragment: cells end in tabs, rows and blocks in line breaks; blank lines go."""
    t = F.coalesce(html, F.lit(""))
    for pattern, put in ((r"</t[dh]>\s*", "\t"), (r"</tr>\s*", "\n"), (r"</(?:p|div|h[1-6]|li)>\s*", "\n"), (r"<br\s*/?>", "\n"), (r"<[^>]+>", "")):
        t = F.regexp_replace(t, pattern, put)
    for entity, raw in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        t = F.replace(t, F.lit(entity), F.lit(raw))
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "^[ \t]+|[ \t]+$", ""))
    return F.array_join(F.filter(lines, lambda x: x.rlike(r"[^\s\p{Z}]")), "\n")


def bbox_of(raw: Column) -> Column:
    """x0 y0 x1 y1 in thousandths, by blanks or commas, as shares of the page; null if not four numbers or empty."""
    parts = F.filter(F.split(F.coalesce(raw, F.lit("")), r"[\s,]+"), lambda p: p != "")

    def box(v: Column) -> Column:
        inside = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v[i]))
        fine = (F.size(v) == 4) & ~F.exists(v, lambda x: x.isNull()) & (F.get(v, 2) > F.get(v, 0)) & (F.get(v, 3) > F.get(v, 1))
        return F.when(fine, F.struct(inside(0).alias("x0"), inside(1).alias("y0"), inside(2).alias("x1"), inside(3).alias("y1")))

    return let(F.transform(parts, lambda p: p.try_cast("double") / 1000), box)


def parse_layout(raw: Column) -> Column:
    """Blocks (label, bbox, count) of a JSON list that may stand within prose; degenerate boxes are dropped."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    candidate = F.when(text.startswith("["), text).otherwise(F.regexp_extract(text, r"(?s)\[.*\]", 0))
    listed = F.from_json(candidate, "array<struct<label:string,bbox:string,count:bigint>>")
    # A box is a text of four numbers with blanks between, or a list of them; a list comes as its JSON text, with commas.
    numbers = lambda v: F.when(v.startswith("["), F.regexp_replace(v, r'[\[\],"]', " ")).when(v.contains(","), "").otherwise(v)
    blocks = F.transform(listed, lambda b: F.struct(F.coalesce(b["label"], F.lit("Text")).alias("label"), bbox_of(numbers(b["bbox"])).alias("bbox"), F.coalesce(b["count"], F.lit(0)).alias("count")))
    return F.coalesce(F.filter(blocks, lambda b: b["bbox"].isNotNull()), F.array().cast("array<struct<label:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,count:bigint>>"))


def parse_layout_html(raw: Column) -> Column:
    """Blocks (text, bbox, label) of a run of divs in order; a bad box keeps the text; without divs the whole is one block."""
    divs = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r'(?is)<div\b[^>]*?data-bbox="[^"]*"[^>]*?>.*?</div>'), 0)

    def block(d: Column) -> Column:
        opening = F.regexp_extract(d, r"(?s)^<div\b[^>]*>", 0)
        return F.struct(
            html_to_text(F.regexp_extract(d, r"(?is)^<div\b[^>]*>(.*?)</div>$", 1)).alias("text"),
            bbox_of(F.regexp_extract(opening, r'(?i)data-bbox="([^"]*)"', 1)).alias("bbox"),
            F.regexp_extract(opening, r'(?i)data-label="([^"]*)"', 1).alias("label"),
        )

    kept = F.filter(F.transform(divs, block), lambda b: (F.trim(b["text"]) != "") & ~b["label"].isin(SKIPPED_LABELS))
    whole = F.trim(html_to_text(raw))
    alone = F.array(F.struct(whole.alias("text"), bbox_of(F.lit("")).alias("bbox"), F.lit("").alias("label")))
    return let(kept, lambda k: F.when(F.size(k) > 0, k).when(whole != "", alone).otherwise(k))


def split_pages(markdown: Column) -> Column:
    """Pages of merged markdown: a number and 48 or more dashes alone on a line part them."""
    pages = F.transform(F.split(markdown, r"(?m)^\d+-{48,}$"), lambda p: F.regexp_replace(p, "^\n+|\n+$", ""))
    return F.when(F.coalesce(markdown, F.lit("")) == "", F.array().cast("array<string>")).otherwise(pages)


def strip(t: Column) -> Column:
    return F.regexp_replace(t, rf"^{BLANK}+|{BLANK}+$", "")


def strip_preamble(text: Column) -> Column:
    """Takes away a fence around the answer, then a first line that announces the transcript and ends in a colon."""
    t = strip(F.coalesce(text, F.lit("")))
    inside = F.when(t.startswith("```"), strip(F.regexp_replace(F.regexp_replace(t, r"^[^\n]*(?:\n|$)", ""), r"(?:^|\n)[^\S\n]*```[^\n]*$", ""))).otherwise(t)

    def cut(x: Column) -> Column:
        first = F.regexp_extract(x, r"^[^\n]*", 0)
        announced = F.exists(F.array(*map(F.lit, PREAMBLES)), lambda p: F.lower(first).startswith(p)) & first.rlike(rf":{BLANK}*$")
        return F.when(announced, strip(F.regexp_replace(x, r"^[^\n]*\n?", ""))).otherwise(x)

    return let(inside, cut)


def collapse_fenced_echo(text: Column) -> Column:
    """The inside of the first closed fence; without one the text less its trailing fence lines."""
    inner = strip(F.regexp_extract(text, r"(?s)```[a-zA-Z0-9_-]*\n(.*?)```", 1))
    return F.when(inner != "", inner).otherwise(strip(F.regexp_replace(text, r"(?:(?:^|\n)[\s\p{Z}]*`*[\s\p{Z}]*)+$", "")))


def reading_order(blocks: Column, rtl: Column) -> Column:
    """Blocks by bands of 2 % from the top, then from the left, or from the right on right-to-left pages; ties keep their order."""
    keyed = F.transform(blocks, lambda b, i: F.struct(F.bround(b["bbox"]["y0"] / 0.02).alias("band"), F.when(rtl, -b["bbox"]["x1"]).otherwise(b["bbox"]["x0"]).alias("x"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(keyed, lambda p, q: F.when(p["band"] != q["band"], F.signum(p["band"] - q["band"])).when(p["x"] != q["x"], F.signum(p["x"] - q["x"])).otherwise(F.signum(p["i"] - q["i"])).cast("int")), lambda k: k["b"])


def engine_config(oem: Column, psm: Column) -> Column:
    """Flags from whole numbers in range, else the defaults."""
    pick = lambda c, most, default: F.when(c.between(0, most), c).otherwise(default).cast("string")
    return F.concat(F.lit("--oem "), pick(oem, 3, 1), F.lit(" --psm "), pick(psm, 13, 3))


def language_argument(languages: Column) -> Column:
    """Known codes in first-seen order joined by plus; eng if none."""
    codes = F.transform(F.coalesce(languages, F.array().cast("array<string>")), lambda c: F.when(c.isin("ar", "ara"), "ara").when(c.isin("en", "eng"), "eng"))
    joined = F.array_join(F.array_distinct(F.filter(codes, lambda c: c.isNotNull())), "+")
    return F.when(joined == "", "eng").otherwise(joined)


def to_pixels(bbox: Column, width: Column, height: Column) -> Column:
    return F.array((bbox["x0"] * width).cast("int"), (bbox["y0"] * height).cast("int"), (bbox["x1"] * width).cast("int"), (bbox["y1"] * height).cast("int"))
