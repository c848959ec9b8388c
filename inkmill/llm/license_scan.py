"""Licence scan: a trained paragraph classifier, confirmed by templates (DataFrame functions only).

Lines that hold an anchor are classified by a sparse
logistic regression over their word 1-, 2- and 3-grams into licence families and an unknown class; its
probabilities are calibrated by a temperature on examples kept from fitting. A family with a
probability of CONFIDENCE or more is confirmed where one of its templates' words are contained in
the line to CONTAINED or more, with half of their pairs of neighbours, and no template of another family is contained better (of equally
contained ones the longer is better, so a lesser or affero licence is not taken for the general one); otherwise, and where
the notice is negated ("not licensed under ..."), the line is of unknown licence. Operands of "X OR Y" that are
identifiers of known licences are lines of their own behind it.

Anchors are words that no notice can do without: of each template, as many as may be missing where it is
confirmed, and one more. So a line without any holds too little of every template, and that it is not
classified loses no licence.

Notices wrapped over several lines are found in the runs of lines of a paragraph (parted by empty
lines) that hold an anchor and have fewer than SPAN words between their first and last line; of
these two lines the SPAN words next to the others count. A run is reported where it is confirmed and
holds no shorter confirmed run or line. Lines without words, as of comment signs, part nothing.

The model is trained on the driver from the templates below, varied by a seeded generator (words
dropped, filler before and after, names and years), and from lines of no licence; nothing is read from
the corpus. The weights, some hundreds of n-grams, are literals of the plan.

Defined results: null and empty texts have no lines; repeated rows get equal results; a line of any
length is read whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import let

UNKNOWN, CONFIDENCE, CONTAINED = "unknown", 0.5, 0.75
#: Words of notices that other texts hold often: anchors only where a template has too few others (fixed values).
FREQUENT = set("2 3 a and any are as be by can charge code copy domain except file for form free general hereby in into is it may mit not of or person program public source subject terms the this to under use v version with without work you".split())

#: Notices by which the licences are commonly applied (fixed values).
TEMPLATES = {
    "AGPL": ["licensed under the gnu affero general public license version 3", "this program is free software you can redistribute it under the terms of the gnu affero general public license", "gnu affero general public license", "spdx license identifier agpl 3.0"],
    "Apache": ["licensed under the apache license version 2.0", "released under the apache 2.0 license", "apache license version 2.0 january 2004", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", "spdx license identifier apache 2.0"],
    "BSD": ["redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 3 clause license", "released under the bsd license", "spdx license identifier bsd 3 clause"],
    "CC-BY": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-NC": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-SA": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CC0": ["released under cc0 1.0 universal public domain dedication", "dedicated to the public domain under cc0"],
    "GPL": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it under the terms of the gnu general public license", "licensed under the gnu general public license version 2", "gnu general public license", "spdx license identifier gpl 3.0"],
    "LGPL": ["licensed under the gnu lesser general public license version 2.1", "this library is free software you can redistribute it under the terms of the gnu lesser general public license", "gnu lesser general public license", "spdx license identifier lgpl 2.1"],
    "MIT": ["released under the mit license", "licensed under the mit license", "the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "spdx license identifier mit"],
    "MPL": ["this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain unlicense license"],
}
#: Words of the longest notice, twice: a wrapped notice may have as many words of its own as its template's.
SPAN = 2 * max(len(t.split()) for ts in TEMPLATES.values() for t in ts)
ORDINARY = """she renewed her driving licence at the office on monday
you need a licence to fish in this lake
the license plate was covered with mud
with the permission of the author we print this letter
he asked permission to leave the room
all rights reserved copyright by the publisher
copyright law protects works of art for many years
the painting has been in the public domain for a century
the council spoke of the redistribution of income
a television licence fee is due every year
the pub lost its license to sell alcohol
the software license agreement binds you to these terms
no permission is given to copy any part of this book
the version of events he gave was false
they released a new version in spring
general public opinion was against the plan
the apache were a people of the south west
mozilla and the foundation met in public
students of mit built a robot
attribution of the poem is uncertain
this work is under way and under budget
the terms are subject to change
free of charge for any person under ten
the source of the river is in the hills
the students of mit got a license to fly
a license from the mit press is needed to print
the general public may not enter
the lesser known works are in the public library
gnu herds crossed the river in spring
the public license office of the city is closed
a general license to trade was given to the company""".splitlines()

#: A notice behind one of these is none; and identifiers that may stand beside OR (fixed values).
NEGATED = r"\b(?:not|never|neither|nor|isn t|aren t|wasn t)(?: [a-z0-9.]+){0,2} (?:licensed|released|distributed|available|covered|governed|under)\b"
IDENTIFIER = r"(?i)^(?:mit|apache-2\.0|bsd-[23]-clause|(?:l?gpl|agpl)-[23](?:\.[01])?(?:-only|-or-later|\+)?|mpl-2\.0|cc0-1\.0|cc-by(?:-sa|-nc)?-4\.0|unlicense)$"


def words_in(line: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", line.lower())


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def examples(seed: int, each: int) -> tuple[list[set[str]], list[int]]:
    """Varied notices of each family and lines of none, with class numbers; 0 is unknown."""
    rng = np.random.default_rng(seed)
    filler = sorted({w for s in ORDINARY for w in words_in(s)})
    pick = lambda n: [filler[i] for i in rng.integers(0, len(filler), n)]
    x, y = [], []
    for k, notices in enumerate(TEMPLATES.values(), 1):
        for i in range(each):
            words = words_in(notices[i % len(notices)])
            if rng.random() < 0.5:
                words = [w for w in words if rng.random() > 0.1]
            x.append(grams([*pick(rng.integers(0, 12)), *words, *pick(rng.integers(0, 12))]))
            y.append(k)
    for i in range(each * 4):
        words = words_in(ORDINARY[i % len(ORDINARY)])
        x.append(grams([*pick(rng.integers(0, 8)), *words, *pick(rng.integers(0, 16))]) if rng.random() < 0.7 else grams(pick(rng.integers(3, 60))))
        y.append(0)
    return x, y


#: Words that make a line worth classifying though no template needs them.
NOTICE = {"copyright", "licence", "licences", "licensing", "permission", "spdx"}


def anchors() -> list[str]:
    """NOTICE, and of each template the words that most templates share, then the longest frequent ones, so many that a confirmed line holds one of them."""
    sets = [set(words_in(t)) for ts in TEMPLATES.values() for t in ts]
    shared = Counter(w for s in sets for w in s)
    chosen = set(NOTICE)
    for words in sets:
        ranked = sorted(words, key=lambda w: (w in FREQUENT, w not in chosen, -len(w) if w in FREQUENT else -shared[w], w))
        chosen |= set(ranked[: len(words) - math.ceil(CONTAINED * len(words)) + 1])
    return sorted(chosen)


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the first is unknown
    weights: dict[str, list[float]]  # of n-grams with a weight other than 0
    bias: list[float]

    def probabilities(self, line: str) -> np.ndarray:
        logits = np.array(self.bias, dtype=float)
        for g in sorted(grams(words_in(line)) & self.weights.keys()):
            logits = logits + np.array(self.weights[g])
        e = np.exp(logits - logits.max())
        return e / e.sum()


@functools.cache
def trained(seed: int = 11, each: int = 160, steps: int = 300, rate: float = 0.5, sparsity: float = 3e-4) -> Model:
    """Softmax regression by proximal gradient steps (L1), then a temperature fitted on other examples."""
    x, y = examples(seed, each)
    templates = set().union(*(grams(words_in(t)) for ts in TEMPLATES.values() for t in ts))
    vocabulary = sorted(templates | {g for s in ORDINARY for g in grams(words_in(s)) if " " not in g})
    number = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
        for i, row in enumerate(rows):
            out[i, [number[g] for g in row if g in number]] = 1
        return out

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    a, classes = matrix(x), len(TEMPLATES) + 1
    target = np.eye(classes, dtype=np.float32)[y]
    w, b = np.zeros((len(vocabulary), classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    for _ in range(steps):
        error = (softmax(a @ w + b) - target) / len(y)
        w -= rate * (a.T @ error)
        b -= rate * error.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity, 0)
    kept_x, kept_y = examples(seed + 1, each // 4)
    z = matrix(kept_x) @ w + b
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(kept_y)), kept_y] + 1e-12).mean()
    heat = min(np.linspace(0.25, 3, 56), key=loss)
    used = np.flatnonzero(np.abs(w).max(axis=1) > 1e-3)
    return Model((UNKNOWN, *TEMPLATES), {vocabulary[i]: [round(float(v), 5) for v in w[i] / heat] for i in used}, [round(float(v), 5) for v in b / heat])


def words_of(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), 0)


def scan_words(words: Column, model: Model) -> Column:
    """A struct of family (unknown where not confirmed) and probability of a line, or run of lines, given as words."""

    def classify(w: Column) -> Column:
        many = lambda n: F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(w, i, n), " "))
        names = sorted(model.weights)
        held = F.array_sort(F.array_intersect(F.concat(w, many(2), many(3)), F.array(*map(F.lit, names))))
        numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
        table = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[numbers(model.weights[n]) for n in names]))
        logits = F.aggregate(held, numbers(model.bias), lambda s, g: F.zip_with(s, F.element_at(table, g), lambda p, q: p + q))
        e = let(logits, lambda z: F.transform(z, lambda v: F.exp(v - F.array_max(z))))
        p = let(e, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, q: s + q)))

        def confirm(p: Column) -> Column:
            best = F.array_position(p, F.array_max(p)).cast("int")
            texts = lambda values: F.array(*map(F.lit, sorted(values)))
            share = lambda t: F.size(F.array_intersect(w, texts(set(words_in(t))))) / len(set(words_in(t)))
            pairs_of = lambda t: {" ".join(x) for x in zip(words_in(t), words_in(t)[1:])}
            fits_in = lambda t, pairs: (share(t) >= CONTAINED) & (F.size(F.array_intersect(pairs, texts(pairs_of(t)))) * 2 >= len(pairs_of(t)))
            # The number of a template's words decides between equally contained ones.
            held = lambda pairs: [F.greatest(F.lit(0.0), *[F.when(fits_in(t, pairs), share(t) + len(set(words_in(t))) / 1000) for t in TEMPLATES[f]]) for f in model.families[1:]]
            fits = let(many(2), lambda pairs: let(F.array(F.lit(0.0), *held(pairs)), lambda h: (F.get(h, best - 1) > 0) & (F.get(h, best - 1) == F.array_max(h))))
            sure = (F.array_max(p) >= CONFIDENCE) & fits & ~F.array_join(w, " ").rlike(NEGATED)
            name = F.element_at(F.array(*map(F.lit, model.families)), best)
            return F.struct(F.when(sure, name).otherwise(UNKNOWN).alias("family"), F.round(F.array_max(p), 6).alias("probability"))

        # Only where the classifier names a family are templates looked at.
        return let(p, lambda p: F.when((F.array_max(p) >= CONFIDENCE) & (F.array_position(p, F.array_max(p)) > 1), confirm(p)).otherwise(F.struct(F.lit(UNKNOWN).alias("family"), F.round(F.array_max(p), 6).alias("probability"))))

    return let(words, classify)


def wrapped(paragraph: Column, model: Model, anchor: str) -> Column:
    """The notices wrapped over lines of a paragraph: structs of family, probability and line, the run's lines."""
    kept = F.filter(F.transform(F.split(paragraph, "\n"), lambda x: F.struct(x.alias("text"), words_of(x).alias("words"))), lambda x: F.size(x["words"]) > 0)

    def runs(lines: Column) -> Column:
        """Structs of first and last, the places of a run's lines: all with fewer than SPAN words between them."""
        n = F.size(lines)
        numbers = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        between = lambda i, j: F.aggregate(F.slice(lines, i + 2, j - i - 1), F.lit(0), lambda s, x: s + F.size(x["words"]))
        # Every line has a word, so no run has over SPAN + 1 lines.
        return F.flatten(F.transform(numbers(F.lit(0), n - 2), lambda i: F.filter(F.transform(numbers(i + 1, F.least(n - 1, i + SPAN)), lambda j: F.struct(i.alias("first"), j.alias("last"))), lambda r: between(r["first"], r["last"]) < SPAN)))

    def read(lines: Column, r: Column) -> Column:
        of = lambda k: F.get(lines, k)["words"]
        head = let(of(r["first"]), lambda w: F.slice(w, F.greatest(F.size(w) - SPAN, F.lit(0)) + 1, SPAN))
        middle = F.flatten(F.transform(F.slice(lines, r["first"] + 2, r["last"] - r["first"] - 1), lambda x: x["words"]))
        return F.concat(head, middle, F.slice(of(r["last"]), 1, SPAN))

    def sure(lines: Column) -> Column:
        """The confirmed runs, and the confirmed lines as runs of one line."""
        ones = F.transform(lines, lambda x, i: F.struct(i.alias("first"), i.alias("last"), x["words"].alias("words")))
        many = F.transform(runs(lines), lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), read(lines, r).alias("words")))
        anchored = F.filter(F.concat(ones, many), lambda r: F.array_join(r["words"], " ").rlike(anchor))
        scanned = F.transform(anchored, lambda r: let(scan_words(r["words"], model), lambda s: F.struct(r["first"].alias("first"), r["last"].alias("last"), s["family"].alias("family"), s["probability"].alias("probability"))))
        return F.filter(scanned, lambda r: r["family"] != UNKNOWN)

    def least(lines: Column, found: Column) -> Column:
        inside = lambda q, r: (q["first"] >= r["first"]) & (q["last"] <= r["last"]) & (q["last"] - q["first"] < r["last"] - r["first"])
        own = F.filter(found, lambda r: (r["last"] > r["first"]) & ~F.exists(found, lambda q: inside(q, r)))
        text = lambda r: F.array_join(F.transform(F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1), lambda x: x["text"]), "\n")
        return F.transform(own, lambda r: F.struct(r["family"].alias("family"), r["probability"].alias("probability"), text(r).alias("line")))

    return let(kept, lambda lines: let(sure(lines), lambda found: least(lines, found)))


def scan(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """docs with licences: an array of (family, probability, line) for each line with an anchor and then for each notice wrapped over lines."""
    words = anchors()
    # The look at the first letter spares most places the list of words; texts are lower-cased before.
    model, anchor = model or trained(), rf"(?<![a-z0-9])(?=[{''.join(sorted({w[0] for w in words}))}])(?:{'|'.join(map(re.escape, words))})(?![a-z0-9])"
    text, none = F.col(text_col), F.array().cast("array<struct<family:string,probability:double,line:string>>")
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike(anchor))
    ids = lambda x: F.filter(F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9.+-]*[A-Za-z0-9+]"), 0), lambda i: i.rlike(IDENTIFIER))
    lines = F.flatten(F.transform(lines, lambda x: F.when(x.rlike(r"\sOR\s"), F.concat(F.array(x), F.transform(ids(x), lambda i: F.concat(F.lit("SPDX-License-Identifier: "), i)))).otherwise(F.array(x))))
    single = F.transform(lines, lambda x: let(scan_words(words_of(x), model), lambda s: F.struct(s["family"].alias("family"), s["probability"].alias("probability"), x.alias("line"))))
    paragraphs = F.filter(F.split(text, r"\n(?:[^\S\n]*\n)+"), lambda x: F.lower(x).rlike(anchor) & x.contains("\n"))
    many = F.flatten(F.transform(paragraphs, lambda x: wrapped(x, model, anchor)))
    return docs.withColumn("licences", F.coalesce(F.when(F.lower(text).rlike(anchor), F.concat(single, many)), none))


def op9(docs: DataFrame) -> DataFrame:
    known = F.filter("licences", lambda x: x["family"] != UNKNOWN)
    rows = scan(docs.select("doc_id", "text")).select("doc_id", "licences", known.alias("known"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("known", lambda x: x["family"]))), ",")
    return rows.select("doc_id", F.size("licences").cast("long").alias("n_candidates"), F.size("known").cast("long").alias("n_licensed"), families.alias("families"), F.array_max(F.transform("known", lambda x: x["probability"])).alias("best_probability"))
