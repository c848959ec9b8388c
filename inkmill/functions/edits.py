"""Guarding proposed edits of a page, choosing among them, and applying them; Column expressions only.

A proposal is a struct (span_start, span_end, original, replacement, confidence, kind); spans count
characters from 0. Locked spans are an array of structs (s, e).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.core import let

# Fixed values of the guards.
MOST_TIMES, MOST_SLACK, MOST_UNLIKE, REVIEW_SHARE, AUTO_CONFIDENCE = 2.5, 10, 0.6, 0.25, 0.8
SAFE_KINDS = ["spacing", "letterform", "dots", "diacritic"]
ARABIC_SCRIPT = "[؀-ۿﭐ-﻿]"


def part(page: Column, start: Column, end: Column) -> Column:
    return F.substring(page, start + 1, end - start)


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (start < s["e"]) & (end > s["s"]))


def digits(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\p{Nd}"), 0))


def rule(page: Column, c: Column, locked: Column, other_digits: Column) -> Column:
    """The first rule that rejects a proposal; null if none does. The order decides what is reported."""
    start, end, old, new = c["span_start"], c["span_end"], F.coalesce(c["original"], F.lit("")), F.coalesce(c["replacement"], F.lit(""))
    switched = lambda pattern: new.rlike(pattern) & ~old.rlike(pattern)
    longer = F.greatest(F.length(old), F.length(new), F.lit(1))
    invented = F.exists(digits(new), lambda d: ~F.array_contains(digits(old), d) & ~F.array_contains(other_digits, d))
    return (
        F.when(start.isNull() | end.isNull() | (start < 0) | (end < start), "invalid_span")
        .when(part(page, start, end) != old, "span_mismatch")
        .when(old == new, "no_op")
        .when(overlaps(start, end, locked), "consensus_locked")
        .when(F.length(new) > MOST_TIMES * F.length(old) + MOST_SLACK, "expansion")
        .when((old != "") & (F.levenshtein(old, new) / longer > MOST_UNLIKE), "too_dissimilar")
        .when(switched(ARABIC_SCRIPT) | switched("[A-Za-z]"), "script_switch")
        .when(invented, "digit_invented")
    )


def guarded(page: Column, changes: Column, locked: Column, other_digits: Column) -> Column:
    """The proposals with their rule, null where accepted so far."""
    return F.transform(changes, lambda c: F.struct(c.alias("c"), rule(page, c, locked, other_digits).alias("rule")))


def without_overlaps(judged: Column) -> Column:
    """Of the accepted ones those that overlap none of higher confidence (ties: the earlier start), by start."""
    order = F.array_sort(F.transform(F.filter(judged, lambda j: j["rule"].isNull()), lambda j, i: F.struct((-F.coalesce(j["c"]["confidence"], F.lit(0.0))).alias("k"), j["c"]["span_start"].alias("s"), i.alias("i"), j["c"].alias("c"))))
    just = F.transform(order, lambda o: o["c"])

    def fold(all_: Column) -> Column:
        # F.slice(x, 1, 0) gives an empty array of the right type to start from.
        return F.aggregate(all_, F.slice(all_, 1, 0), lambda kept, c: F.when(F.exists(kept, lambda k: (c["span_start"] < k["span_end"]) & (c["span_end"] > k["span_start"])), kept).otherwise(F.concat(kept, F.array(c))))

    kept = let(just, fold)
    return F.transform(F.array_sort(F.transform(kept, lambda c, i: F.struct(c["span_start"].alias("s"), i.alias("i"), c.alias("c")))), lambda o: o["c"])


def with_overlaps(judged: Column) -> Column:
    """The judged proposals with rule `overlap` for those that lose against another of higher confidence."""
    def mark(x: Column) -> Column:
        won = lambda c: F.exists(x["kept"], lambda k: (k["span_start"] == c["span_start"]) & (k["span_end"] == c["span_end"]) & k["replacement"].eqNullSafe(c["replacement"]) & k["confidence"].eqNullSafe(c["confidence"]))
        return F.transform(x["judged"], lambda j: F.struct(j["c"].alias("c"), F.when(j["rule"].isNull() & ~won(j["c"]), "overlap").otherwise(j["rule"]).alias("rule")))

    return let(F.struct(judged.alias("judged"), without_overlaps(judged).alias("kept")), mark)


def review(page: Column, kept: Column) -> Column:
    """A struct of the characters touched, and whether over a quarter of the page is."""
    touched = F.aggregate(kept, F.lit(0), lambda a, c: a + (c["span_end"] - c["span_start"]).cast("int"))
    return F.struct(touched.alias("chars_touched"), ((F.length(page) > 0) & (touched / F.greatest(F.length(page), F.lit(1)) > REVIEW_SHARE)).alias("needs_review"))


def auto_accept(c: Column, needs_review: Column) -> Column:
    return F.coalesce(c["kind"].isin(SAFE_KINDS) & (c["confidence"] >= AUTO_CONFIDENCE) & ~needs_review, F.lit(False))


def apply_changes(page: Column, kept: Column) -> Column:
    """Replaces from the right, so that earlier places stay valid."""
    return F.aggregate(F.reverse(kept), page, lambda t, c: F.concat(F.substring(t, F.lit(1), c["span_start"]), F.coalesce(c["replacement"], F.lit("")), F.substring(t, c["span_end"] + 1, F.length(t))))


def change_id(page_number: Column, c: Column) -> Column:
    return F.concat_ws("-", page_number, c["span_start"], c["span_end"])


def chosen_pages(pages: Column, wanted: Column) -> Column:
    """Pages (number, text) to be corrected: those wanted, all where none are named; blank ones never."""
    every = F.coalesce(F.size(wanted), F.lit(0)) == 0
    return F.filter(pages, lambda p: p["text"].rlike(r"[^\s\p{Z}]") & (every | F.array_contains(wanted, p["number"])))
