"""Scalars over answers, messages and requests of a conversation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.core import let
from inkmill.functions.text import html_escape

# Budgets, modes and their limits.
CITE, THINK = r"\[\[cite:([0-9a-fA-F\-]{6,40})\]\]", r"(?s)<think>.*?</think>"
TEXT_BUDGET, MOST_IMAGES, QUOTE, IMPLICIT = 16_000, 8, 240, 5
CUT_NOTICE = "\n[… truncated: the file is longer than the reading limit]"
TOP_K = {"fast": 5, "balanced": 8, "deep": 10}
EXCERPT = {"fast": 500, "balanced": 500, "deep": 350}
ROUNDS = {"fast": 2, "balanced": 5, "deep": 8}
GENERAL_ROUNDS = 4
MODEL_CHARS, RUNNER_CHARS = 4000, 8000


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def resolve_citations(answer: Column, retrieved: Column) -> Column:
    """A struct of display text, cited ids in order and mode, from an answer and the ids that were retrieved (in order).

    Markers of retrieved ids become numbers by first appearance; others are taken out. Without any, the
    first five retrieved ids are given as consulted (implicit), or none.
    """

    def run(x: Column) -> Column:
        ids = F.regexp_extract_all(x["text"], F.lit(CITE), 1)
        ordered = F.array_distinct(F.filter(ids, lambda i: F.array_contains(x["known"], i)))

        def show(order: Column) -> Column:
            numbered = F.aggregate(F.transform(order, lambda i, n: F.struct(i.alias("i"), (n + 1).cast("string").alias("n"))), x["text"], lambda t, c: F.replace(t, F.concat(F.lit("[[cite:"), c["i"], F.lit("]]")), F.concat(F.lit("["), c["n"], F.lit("]"))))
            text = strip(F.regexp_replace(numbered, CITE, ""))
            few = F.slice(x["known"], 1, IMPLICIT)
            explicit = F.size(order) > 0
            return F.struct(text.alias("display"), F.when(explicit, order).otherwise(few).alias("cited"), F.when(explicit, "explicit").when(F.size(few) > 0, "implicit").otherwise("none").alias("mode"))

        return let(ordered, show)

    clean = strip(F.regexp_replace(F.coalesce(answer, F.lit("")), THINK, ""))
    return let(F.struct(clean.alias("text"), F.coalesce(retrieved, F.array().cast("array<string>")).alias("known")), run)


def message_text(parts: Column) -> Column:
    """Parts (type, text) of a message as text; an image is a word in brackets."""
    texts = F.transform(parts, lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).when(p["type"] == "image_url", "[image]"))
    return F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")


def json_answer(raw: Column) -> Column:
    """The answer without its fence if it parses as a JSON object, else an empty object."""
    t = F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"^```(?:json)?\s*|\s*```$", "")
    return F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t).otherwise("{}")


def attachment_blocks(attachments: Column) -> Column:
    """Text of attachments (filename, kind, text, images) within one budget.

    What is cut counts with its notice, so the budget may fall below zero; later files are then cut to
    nothing but the notice.
    """

    def add(state: Column, a: Column) -> Column:
        header = F.concat(F.lit('<attachment name="'), html_escape(a["filename"]), F.lit('" kind="'), a["kind"], F.lit('"'))
        over = F.length(a["text"]) > state["budget"]
        body = F.when(over, F.concat(F.substring(a["text"], F.lit(1), F.greatest(state["budget"], F.lit(0))), F.lit(CUT_NOTICE))).otherwise(a["text"])
        has_text = F.coalesce(a["text"], F.lit("")) != ""
        block = F.when(has_text, F.concat(header, F.lit(">\n"), body, F.lit("\n</attachment>"))).when(a["images"] > 0, F.concat(header, F.lit(">\n[shown as "), a["images"].cast("string"), F.lit(" image(s) below]\n</attachment>")))
        left = F.when(has_text, state["budget"] - F.length(body)).otherwise(state["budget"])
        return F.struct(left.alias("budget"), F.when(block.isNull(), state["blocks"]).otherwise(F.concat(state["blocks"], F.array(block))).alias("blocks"))

    start = F.struct(F.lit(TEXT_BUDGET).alias("budget"), F.array().cast("array<string>").alias("blocks"))
    return F.aggregate(attachments, start, add, lambda s: s["blocks"])


def human_content(text: Column, attachments: Column) -> Column:
    return let(attachment_blocks(attachments), lambda b: F.when(F.size(b) > 0, F.concat(text, F.lit("\n\n"), F.array_join(b, "\n\n"))).otherwise(text))


def mode_of(value: Column, modes: list[str], default: str) -> Column:
    return F.when(value.isin(modes), value).otherwise(default)


def by_mode(mode: Column, values: dict[str, int], default: str = "balanced") -> Column:
    chain = None
    for name, value in values.items():
        chain = F.when(mode == name, value) if chain is None else chain.when(mode == name, value)
    return chain.otherwise(values[default])


def path(chat_mode: Column, thinking: Column, research: Column) -> Column:
    return F.when(chat_mode == "general", F.when(thinking == "deep", "deep_think").otherwise("agent")).when(research == "deep", "deep_research").otherwise("agent")


def route(wants_tool: Column, chat_mode: Column, research: Column, rounds: Column) -> Column:
    """The next step of a turn; at a mode's cap of tool rounds an answer is forced."""
    done = F.coalesce(rounds, F.lit(0))
    general = F.when(done >= GENERAL_ROUNDS, "force_answer").otherwise("general_tools")
    documents = F.when(done >= by_mode(research, ROUNDS), "force_answer").otherwise("tools")
    return F.when(~wants_tool, "finalize").when(chat_mode == "general", general).otherwise(documents)


def tool_phase(tool: Column, searches: Column) -> Column:
    return (
        F.when(tool == "search_documents", F.when(searches == 0, "searching").otherwise("comparing"))
        .when(tool == "run_python", "running_code")
        .when(tool.isin("get_chunk_context", "read_document_page", "get_document_metadata"), "verifying")
        .otherwise("reviewing")
    )


def clamp_top_k(k: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(50), k))


def clipped(output: Column, limit: int = MODEL_CHARS) -> Column:
    return F.when(F.length(output) > limit, F.concat(F.substring(output, 1, limit), F.lit("\n… output truncated"))).otherwise(output)


def sse_frame(event: Column, data: Column, id_: Column) -> Column:
    """One server-sent event; each line of the data has its own prefix."""
    head = F.when(id_.isNotNull(), F.concat(F.lit("id: "), id_.cast("string"), F.lit("\n"))).otherwise("")
    return F.concat(head, F.lit("event: "), event, F.lit("\ndata: "), F.replace(data, F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))


def sse_parse(stream: Column) -> Column:
    """Events (id, event, data) of a stream of frames."""
    frames = F.filter(F.split(stream, "\n\n"), lambda f: F.trim(f) != "")
    field = lambda f, name: F.regexp_extract(f, rf"(?m)^{name}: ?(.*)$", 1)
    return F.transform(frames, lambda f: F.struct(F.nullif(field(f, "id"), F.lit("")).alias("id"), field(f, "event").alias("event"), F.array_join(F.regexp_extract_all(f, F.lit(r"(?m)^data: ?(.*)$"), 1), "\n").alias("data")))


def fit_files(files: Column, most: int = 10, total: int = 20 * 1024 * 1024, endings: list[str] | None = None) -> Column:
    """Names of files (name, size) that fit in order; one that does not is left out and later ones may still fit.

    Hidden files, and with endings given those with another ending, are skipped.
    """
    allowed = lambda name: F.lit(True) if endings is None else F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)).isin(endings)

    def add(s: Column, f: Column) -> Column:
        fits = (F.size(s["names"]) < most) & (s["used"] + f["size"] <= total) & ~f["name"].startswith(".") & allowed(f["name"])
        return F.struct(F.when(fits, s["used"] + f["size"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["names"], F.array(f["name"]))).otherwise(s["names"]).alias("names"))

    return F.aggregate(files, F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("names")), add, lambda s: s["names"])
