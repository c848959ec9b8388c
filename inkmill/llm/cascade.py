"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule rejects a document by a few measures of its whole text. On a sample the cascade estimates
for every rule its cost (nanoseconds, by the words and characters that its measures go over) and its
selectivity (which documents it rejects), and puts rules in order of rejections per cost: next comes
always the rule with the most rejections per cost among the documents that the rules before it left. A
document then meets the rules in that order and stops at the first that rejects it; the measures of
later rules are not computed. The order changes the work, never the verdict: a document is kept where no
rule rejects it.

The sample has a documented bound, SAMPLE rows, and serves the order alone; the rules themselves read
every row and the whole of its text. What a measure costs a word or a character is timed once a session on
the first TIMED rows of a sample, on one core; typed costs only break ties.

Defined results: a null text has no words, no lines and no symbols (and so fails the rule on length);
repeated rows get equal verdicts; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import discard, let, materialize

SAMPLE = 2000  #: rows at most in the sample that the order is estimated on
TIMED = 256  #: rows at most that a measure's cost is timed on
POSITION_BITS = 20
#: What measures cost, in nanoseconds a word or a character of the text, as once measured; they break ties.
WORD_CHARS_NS, REPEATS_NS, SYMBOLS_NS, LINES_NS, DUP_LINES_NS, SHOUTS_NS = 60.0, 750.0, 8.0, 6.0, 5.0, 3.0


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+"), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))


def repeated_words(words: Column, named: Callable[..., Column] = F.xxhash64, most: int = (1 << POSITION_BITS) - 1) -> Column:
    """How many words lie in a window of three words that is found twice or more.

    Every window's hash (upper bits) and position (lower bits) make one long; sorted, equal windows are
    neighbours. Texts with over `most` words sort pairs of the full hash and the position instead. Neighbours are
    held against each other by their words; where two of one hash differ, the text's windows are sorted by words.
    """

    def covered(positions: Column) -> Column:
        # Sorted starts of repeated windows: each adds its distance to the next start, three words at most.
        gaps = F.transform(positions, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1), p + 3) - p))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def neighbours(sorted_: Column, same: Callable[[Column, Column], Column]) -> Column:
        return F.filter(sorted_, lambda x, i: F.coalesce(same(F.get(sorted_, i - 1), x), F.lit(False)) | F.coalesce(same(F.get(sorted_, i + 1), x), F.lit(False)))

    def at(p: Column) -> list[Column]:
        return [F.get(words, p.cast("int") + d) for d in range(3)]

    def by_words() -> Column:
        windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.struct(*[w.alias(f"w{d}") for d, w in enumerate(at(i))]).alias("w"), i.cast("long").alias("p"))))
        return let(windows, lambda s: let(F.sort_array(F.transform(neighbours(s, lambda a, b: a["w"] == b["w"]), lambda x: x["p"])), covered))

    def by_hash(sorted_: Column, hash_of: Callable[[Column], Column], place: Callable[[Column], Column]) -> Column:
        same = lambda a, b: hash_of(a) == hash_of(b)

        def checked(near: Column) -> Column:
            differ = lambda a, b: same(a, b) & (F.array(*at(place(a))) != F.array(*at(place(b))))
            collided = F.size(F.filter(near, lambda x, i: F.coalesce(differ(F.get(near, i - 1), x), F.lit(False)))) > 0
            return F.when(collided, by_words()).otherwise(let(F.sort_array(F.transform(near, place)), covered))

        return let(sorted_, lambda s: let(neighbours(s, same), checked))

    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashed = lambda i: named(*at(i))
    mask = F.lit((1 << POSITION_BITS) - 1).cast("long")
    packed = F.sort_array(F.transform(starts, lambda i: hashed(i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
    short = by_hash(packed, lambda x: F.shiftrightunsigned(x, POSITION_BITS), lambda x: x.bitwiseAND(mask))
    pairs = F.sort_array(F.transform(starts, lambda i: F.struct(hashed(i).alias("h"), i.cast("long").alias("p"))))
    long_ = by_hash(pairs, lambda x: x["h"], lambda x: x["p"])
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).when(F.size(words) <= most, short).otherwise(long_)


@dataclass(frozen=True)
class Measure:
    """of: from a text and its words, which are split once; per_word and per_char: nanoseconds on one core, as once measured."""

    of: Callable[[Column, Column], Column]
    per_word: float = 0.0
    per_char: float = 0.0


MEASURES: dict[str, Measure] = {
    "n_words": Measure(lambda t, w: F.size(w).cast("long")),
    "word_chars": Measure(lambda t, w: F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)), per_word=WORD_CHARS_NS),
    "n_symbols": Measure(lambda t, w: F.coalesce(F.regexp_count(t, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long"), per_char=SYMBOLS_NS),
    "n_lines": Measure(lambda t, w: F.size(lines_of(t)).cast("long"), per_char=LINES_NS),
    "n_dup_lines": Measure(lambda t, w: let(lines_of(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"), per_char=DUP_LINES_NS),
    "n_repeat_words": Measure(lambda t, w: repeated_words(w), per_word=REPEATS_NS),
    "n_shouts": Measure(lambda t, w: F.coalesce(F.regexp_count(t, F.lit("!!")), F.lit(0)).cast("long"), per_char=SHOUTS_NS),
}


@dataclass(frozen=True)
class Rule:
    """rejects: from a function that gives a measure's column by name, asked for those named in measures."""

    name: str
    measures: tuple[str, ...]
    rejects: Callable[[Callable[[str], Column]], Column]


RULES = [
    Rule("too_few_words", ("n_words",), lambda m: m("n_words") < 50),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("shouting", ("n_shouts", "n_words"), lambda m: 10 * m("n_shouts") > m("n_words")),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("word_length", ("word_chars", "n_words"), lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
]
RULE_NS = 50.0  #: what any rule costs a document at least


def on_text(text: Column, body: Callable[[Callable[[str], Column]], Column]) -> Column:
    """body over measures that are computed from text where they are asked for."""
    both = F.struct(F.coalesce(text, F.lit("")).alias("t"), words_of(text).alias("w"))
    return let(both, lambda x: body(lambda name: MEASURES[name].of(x["t"], x["w"])))


def first_rejection(rules: list[Rule], measure: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, in the given order; later rules are not evaluated. Null: kept."""
    chain = F.when(rules[0].rejects(measure), rules[0].name)
    for rule in rules[1:]:
        chain = chain.when(rule.rejects(measure), rule.name)
    return chain


def sample_of(docs: DataFrame, text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """A random sample of at most bound texts."""
    total = max(1, docs.select(F.lit(1)).count())
    return docs.select(F.col(text_col).alias("text")).sample(min(1.0, bound / total), seed=7).limit(bound)


_timed: dict[tuple[str, str], float] = {}  #: by application and measure, so that each is timed once a session


def timed(sample: DataFrame, names: list[str]) -> dict[str, float]:
    """Nanoseconds that each measure takes a word (if it goes over words) or a character, beyond splitting the text; sample has one text column."""
    app = sample.sparkSession.sparkContext.applicationId
    if missing := [n for n in names if (app, n) not in _timed]:
        held = materialize(sample.limit(TIMED).coalesce(1))
        sizes = held.select(F.sum(F.size(words_of(F.col("text")))), F.sum(F.length("text"))).first()

        def seconds(name: str) -> float:
            job, runs = held.agg(F.max(on_text(F.col("text"), lambda m: m(name)))), []
            for _ in range(2):  # the first run compiles
                at = time.perf_counter()
                job.collect()
                runs.append(time.perf_counter() - at)
            return min(runs)

        base = seconds("n_words")
        for n in missing:
            units = sizes[0] if MEASURES[n].per_word else sizes[1]
            _timed[app, n] = max(0.0, seconds(n) - base) * 1e9 / units if units else 0.0
        discard(held)
    return {n: _timed[app, n] for n in names}


def ordered(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> list[Rule]:
    """rules by estimated rejections per cost, most first; one pass over the sample, of which flags and sizes come to the driver."""

    def seen(m: Callable[[str], Column]) -> Column:
        return F.struct(F.array(*[F.coalesce(r.rejects(m), F.lit(False)) for r in rules]).alias("rejects"), m("n_words").alias("n_words"))

    sample = sample_of(docs, text_col)
    rows = sample.select(on_text(F.col("text"), seen).alias("s"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")).collect()
    rejects = np.array([r.s.rejects for r in rows], dtype=bool).reshape(-1, len(rules))
    words, chars = (np.array(x, dtype=float) for x in ([r.s.n_words for r in rows], [r.n_chars for r in rows]))
    unit = timed(sample, sorted({n for r in rules for n in r.measures if n != "n_words"}))

    def cost_of(measure: str) -> np.ndarray:
        return unit.get(measure, 0.0) * (words if MEASURES[measure].per_word else chars)

    cost = np.array([RULE_NS + sum(map(cost_of, r.measures)) for r in rules]).reshape(len(rules), -1)
    typed = [sum(MEASURES[n].per_word * words.sum() + MEASURES[n].per_char * chars.sum() for n in r.measures) for r in rules]
    left, rest, chain = np.ones(len(rows), dtype=bool), list(range(len(rules))), []
    while rest:
        worth = lambda k: (rejects[left, k].sum() / cost[k, left].sum() if left.any() else 0.0, -typed[k])
        chain.append(max(rest, key=worth))
        rest.remove(chain[-1])
        left &= ~rejects[:, chain[-1]]
    return [rules[k] for k in chain]


def apply_rules(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """docs without the documents that a rule rejects."""
    chain = ordered(docs, rules, text_col)
    return docs.filter(on_text(F.col(text_col), lambda m: first_rejection(chain, m)).isNull())


def verdicts(docs: DataFrame, report: list[str], rules: list[Rule] = RULES, text_col: str = "text") -> Column:
    """A struct of the measures named in report, which every document gets, and rule, the name of the first that rejects it.

    The rules take the reported measures as they are; the others are computed only where the chain comes to them.
    """
    chain = ordered(docs, rules, text_col)

    def reported(m: Callable[[str], Column]) -> Column:
        known = F.struct(*[m(n).alias(n) for n in report])
        return let(known, lambda k: F.struct(*[k[n].alias(n) for n in report], first_rejection(chain, lambda n: k[n] if n in report else m(n)).alias("rule")))

    return on_text(F.col(text_col), reported)


def reached(docs: DataFrame, chain: list[Rule], text_col: str = "text") -> dict[str, int]:
    """How many documents meet each rule of the chain, in its order."""
    stopped = docs.select(on_text(F.col(text_col), lambda m: first_rejection(chain, m)).alias("rule")).groupBy("rule").count().collect()
    at, out = sum(r["count"] for r in stopped), {}
    for rule in chain:
        out[rule.name] = at
        at -= sum(r["count"] for r in stopped if r.rule == rule.name)
    return out


def op10(docs: DataFrame) -> DataFrame:
    """The contract's measures of every document and the cascade's verdict."""
    report = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.select("doc_id", verdicts(docs, report).alias("v")).select("doc_id", "v.*")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", *report, base.alias("base_failed"), (~base & F.col("rule").isNull()).alias("kept"))


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l
  FROM documents),
windows AS (
  SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS t
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, t) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, sum(least(3, coalesce(lead_p - p, 3)))::BIGINT AS n
  FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS lead_p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '!!'))::BIGINT AS n_shouts,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_shouts > n_words
            OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM m
"""
