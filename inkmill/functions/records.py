"""Small projections of records: look-ups with fallbacks, settings, failures, plans and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.core import let

TERMINAL = ["succeeded", "failed", "cancelled", "skipped", "timeout"]
HIT = "array<struct<chunk_id:string,document_id:string,score:double>>"


def title_of(title: Column, filename: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), filename)


def page_or_message(text: Column, page: Column) -> Column:
    """The page of a text whose pages are parted by form feeds, or what is wrong with its number."""
    def pick(pages: Column) -> Column:
        inside = page.between(1, F.size(pages))
        return F.when(inside, F.get(pages, page - 1)).otherwise(F.concat(F.lit("Page "), page.cast("string"), F.lit(" is out of range; the document has "), F.size(pages).cast("string"), F.lit(" page(s).")))

    return let(F.split(text, "\f"), pick)


def by_prefix(entries: Column, prefix: str) -> Column:
    """The value of the first key with the prefix, else the first value; entries in the order of the document: structs (key, value)."""
    mine = F.filter(entries, lambda e: e["key"].startswith(prefix))
    return F.coalesce(F.get(mine, F.lit(0))["value"], F.get(entries, F.lit(0))["value"])


def setting(json: Column, name: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(json, f"$.{name}"), F.lit(default))


def scope_ids(scope: Column, ids: Column) -> Column:
    """The chosen documents of a conversation; null where it is not restricted, which is not the same as none."""
    return F.when(scope == "selected", F.coalesce(ids, F.array().cast("array<string>")))


def job_pages(pages: Column, profile: str) -> Column:
    """Numbers, in order, of the pages (page_number, rasters) that have a raster for the profile."""
    return F.array_sort(F.transform(F.filter(pages, lambda p: F.map_contains_key(p["rasters"], profile)), lambda p: p["page_number"]))


def failure(code: Column, message: Column) -> Column:
    return F.struct(F.substring(code, 1, 64).alias("code"), F.substring(message, 1, 4000).alias("message"), F.substring(message, 1, 300).alias("event_message"))


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(TERMINAL), F.lit(False))


def retry_delay(attempt: Column, most: int = 2, step: int = 5) -> Column:
    """Seconds to wait before the next attempt, counted from 0; null when there is none."""
    return F.when(attempt < most, step * (attempt + 1))


def hits_of(answer: Column) -> Column:
    """Hits in a tool's JSON answer that name a chunk; nothing if it is no list of them."""
    listed = F.coalesce(F.from_json(answer, HIT), F.array().cast(HIT))
    return F.filter(listed, lambda h: h["chunk_id"].isNotNull() & (h["chunk_id"] != ""))


def phase_summary(phases: Column) -> Column:
    """From phases (phase, detail, n): the planned number of steps, what was searched for, the sources that were written from; null without phases."""
    of = lambda name: F.filter(phases, lambda p: p["phase"] == name)
    summary = F.struct(F.get(of("planned"), F.lit(0))["n"].alias("steps"), F.transform(of("searching"), lambda p: p["detail"]).alias("queries"), F.get(of("writing"), F.lit(0))["n"].alias("sources"))
    return F.when(F.size(phases) > 0, summary)


def filter_meta(keywords: Column, topics: Column, title: Column) -> Column:
    """What is copied onto chunks for filtering: 15 keywords, 10 topics, 300 characters of title."""
    return F.struct(F.slice(keywords, 1, 15).alias("keywords"), F.slice(topics, 1, 10).alias("topics"), F.substring(title, 1, 300).alias("title"))


def provenance(engine: Column, source: Column, revision_no: Column, prompt_version: Column, windows: Column) -> Column:
    """Where metadata come from: the model, the text's source and revision, the prompt's version, and whether the text was condensed."""
    return F.struct(engine.alias("model"), source.alias("text_source"), revision_no.alias("revision_no"), prompt_version.alias("prompt_version"), (F.coalesce(windows, F.lit(0)) > 1).alias("condensed"))


def planned_fields(mode: Column, required: Column) -> Column:
    """What an extraction has to find: nothing in automatic mode, the document's own list in advanced mode."""
    return F.when(mode == "advanced", F.coalesce(required, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def stale_unbound(owner: Column, created: Column, now: Column, hours: int = 24) -> Column:
    """Whether an upload belongs to nothing and is older than some hours."""
    return F.coalesce(owner.isNull() & (created < now - F.make_dt_interval(hours=F.lit(hours))), F.lit(False))


def saved_file(name: Column, body: Column) -> Column:
    """A file to store, from its name and base64 content: name, content and size; null where the content is no base64 or the name is none."""
    return let(F.try_to_binary(body, F.lit("base64")), lambda b: F.when(b.isNotNull() & name.isNotNull(), F.struct(name.alias("name"), b.alias("content"), F.octet_length(b).alias("size"))))


def accepted_fields(proposed: Column, keys: Column) -> Column:
    """The chosen proposals in their own order."""
    return F.filter(proposed, lambda f: F.array_contains(keys, f["key"]))


def patched(patch: Column, old: Column) -> Column:
    return F.coalesce(patch, old)


def missing_of(required: Column, present: Column) -> Column:
    return F.array_sort(F.array_except(required, present))


def page_count_warning(expected: Column, got: Column) -> Column:
    return F.when(expected != got, F.concat(F.lit("expected "), expected.cast("string"), F.lit(" pages, got "), got.cast("string")))
