"""Fuzzy line dedup (DataFrame functions only): SimHash, pigeonhole blocks, edit similarity, one occurrence a group.

Lines are normalised (lower case; runs of other than letters, marks and digits become one space) and
named by a 64-bit hash. A line's SimHash has six blocks of 28 bits. Each distinct word goes to the block
that its hash names, and a block's bit is set if set in over half of the hashes of its words; so a word
that changes changes two blocks at most and leaves the others as they are (a sparse projection, where
in a dense one every word moves every bit and a few changed words leave no block equal). Two lines link
if they agree, in bits and number of words, in a block of three words or more or in two of fewer, and their SimHashes differ
in at most `radius` bits and their edit similarity, 1 - edits / length of the longer, is `similarity`
or more. Of each connected group the first occurrence stays, by doc_id (null last), then text hash,
then place; the others are dropped. Lines without letters or digits always stay.

Lines that agree so are found whole. Lines that are similar without it are not found: those with
changed words in every block, and lines of one or two words with a changed letter. The README gives the
recall of all pairs of edit similarity 0.8, which tests/llm measures.

Candidates are dealt by blocks. First each line of a bucket is compared with the bucket's first line
only, and the links give components; then lines outside their bucket's largest component are compared
with the bucket's lines of other components. What is left out lies within one component already, so
components come out as if all pairs of a bucket had been compared.

The counts behind a block are kept as lanes of 2, 4, 6, 8, 16 or 32 bits in longs, whose width follows the
number of words, so that lines of any length fit.

Defined results: a null text stays null, an empty one empty; rows equal in doc_id and text share their
decisions; a document that loses all lines stays with an empty text; an empty table gives an empty
result; other columns pass through. Distinct normalised lines whose 64-bit hashes collide would count
as equal (about one pair expected in 6e9 distinct lines).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkmill.llm.common import BROADCAST_ROWS, connected, discard, let, materialize, split_join

RADIUS, BLOCKS, SIMILARITY = 30, 6, 0.8
ALONE = 3  #: words of a block that make lines candidates by itself
KEPT = 56  #: a hash's even bits below this one enter a SimHash; above it a block has its number of words, 127 at most
BITS = sum(1 << i for i in range(0, KEPT, 2))
LONG = 500  #: letters beyond which an alignment of words costs less than the distance
AHEAD = 3  #: words that an alignment looks ahead where lines differ
HASH = [f"b{i}" for i in range(BLOCKS)]


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}\p{N}]+", " "))


def words_of(line: Column) -> Column:
    """The words of normalised(line), which cost less than it."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"[a-z[\p{L}\p{M}\p{N}]]+"), F.lit(0))  # most letters are found before their class is looked up


def majority(hashes: Column, n: Column, width: int) -> Column:
    """The kept bits set in over half of n hashes, counted in lanes of `width` bits.

    Counter j is a long of its own, which takes every width-th bit from bit j on: Spark interprets folds,
    and one with a number for its state costs a third of one with a struct of them.
    """
    wide, out = width > 8, F.lit(0).cast("long")
    mark = width - 2 if wide else width - 1  # wide lanes reach the sign and leave it alone
    for j in range(0, width, 2):
        first, step = (0, j) if wide else (j, 0)
        ones = sum(1 << i for i in range(first, KEPT - step, width))

        def counted(h: Column) -> Column:
            return (F.shiftrightunsigned(h, step) if step else h).bitwiseAND(F.lit(ones))

        total = F.aggregate(hashes, F.lit(0).cast("long"), lambda c, h: c + counted(h))
        # Counts of over n / 2, raised by what is missing to the mark, set it.
        lift = ((1 << mark) - 1 - F.floor(n / 2)) * F.lit(ones >> first)
        marks = (total + (F.shiftleft(lift, first) if first else lift)).bitwiseAND(F.lit(ones << mark))
        out = out.bitwiseOR(F.shiftrightunsigned(marks, mark - step) if mark >= step else F.shiftleft(marks, step - mark))
    return out


def block(hashes: Column) -> Column:
    """A block's bits and number of words, from the hashes of its words."""
    n = F.size(hashes)
    bits = F.when(n < 1 << 2, majority(hashes, n, 2)).when(n < 1 << 4, majority(hashes, n, 4)).when(n < 1 << 6, majority(hashes, n, 6)).when(n < 1 << 8, majority(hashes, n, 8)).when(n < 1 << 15, majority(hashes, n, 16)).otherwise(majority(hashes, n, 32))
    return bits.bitwiseOR(F.shiftleft(F.least(n, F.lit(127)).cast("long"), KEPT))


def lines_of(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Every line: doc_id, text_hash, place, line (the hash of the normalised line; null where nothing is left), its blocks and size (its characters)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(F.split(text_col, "\n")).alias("place", "text"))
    rows = rows.select("doc_id", "text_hash", "place", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "text_hash", "place", F.when(F.size("words") > 0, F.col("words")).alias("words"), F.when(F.size("words") > 0, F.array_join("words", " ")).alias("norm"))
    # Sorted hashes with a fence before each block but the first: a block's words lie between two fences.
    fences = [-(1 << 63) + (i << 64) // BLOCKS for i in range(1, BLOCKS)]
    words = F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))
    named = ["doc_id", "text_hash", "place", F.when(F.col("norm").isNotNull(), F.xxhash64("norm")).alias("line"), F.length("norm").alias("size")]
    rows = rows.select(*named, F.sort_array(F.concat(words, F.array(*map(F.lit, fences)))).alias("h"))
    at = [F.lit(0)] + [F.array_position("h", F.lit(x)).cast("int") for x in fences] + [F.size("h") + 1]
    rows = rows.select(*rows.columns, *[x.alias(f"at{i}") for i, x in enumerate(at)])
    rows = rows.select(*rows.columns, *[F.slice("h", F.col(f"at{i}") + 1, F.col(f"at{i + 1}") - F.col(f"at{i}") - 1).alias(f"h{i}") for i in range(BLOCKS)])
    return rows.select("doc_id", "text_hash", "place", "line", "size", *[block(F.col(f"h{i}")).alias(b) for i, b in enumerate(HASH)])


def buckets() -> Column:
    """The names of a line's buckets, nulls among them: each full block, and each two others that hold words."""
    full = {b: F.col(b) >= ALONE << KEPT for b in HASH}
    part = {b: (F.col(b) >= 1 << KEPT) & ~full[b] for b in HASH}
    alone = [F.when(full[b], F.xxhash64(F.lit(i), b)) for i, b in enumerate(HASH)]
    twos = [F.when(part[HASH[i]] & part[HASH[j]], F.xxhash64(F.lit(i), HASH[i], F.lit(j), HASH[j])) for i, j in combinations(range(BLOCKS), 2)]
    return F.when(sum(part[b].cast("int") for b in HASH) > 1, F.array(*alone, *twos)).otherwise(F.array(*alone))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def texts_of(lines: DataFrame, ends: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """line and words of the lines in ends, each read from one text that holds it."""
    where = lines.join(small(ends, ends.count()), "line").groupBy("line").agg(F.min(F.struct("text_hash", "place")).alias("at"))
    where = materialize(where.groupBy("at.text_hash").agg(F.collect_list(F.struct("line", "at.place")).alias("points")))  # a text's own lines at most
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).join(small(where, ends.count()), "text_hash")
    split = let(F.split("text", "\n"), lambda x: F.transform("points", lambda p: F.struct(p["line"].alias("line"), F.get(x, p["place"]).alias("text"))))
    found = texts.select(F.explode(split).alias("x")).select("x.line", normalised(F.col("x.text")).alias("norm"))
    out = materialize(found.filter(F.xxhash64("norm") == F.col("line")).distinct().select("line", F.split("norm", " ").alias("words")))
    discard(where)
    return out


def walked(x: Column, y: Column, most: Column) -> Column:
    """Edits of one alignment of two lists of words, each with its blank: no fewer than the edit distance. Given up, with more than `most`, beyond that.

    Both lists are walked at once. Where words differ, the next place within AHEAD words where they are equal again
    is looked for, and what lies before it is compared letter by letter; words after the end of the other list count whole.
    """
    ahead = sorted(((p, q) for p in range(AHEAD + 1) for q in range(AHEAD + 1) if p + q), key=lambda t: (max(t), -min(t)))

    def step(s: Column) -> Column:
        i, j = s["i"], s["j"]

        def meets(p: int, q: int) -> Column:
            same = F.get(x, i + p) == F.get(y, j + q)
            return same if max(p, q) < 2 else same & F.get(x, i + p + 1).eqNullSafe(F.get(y, j + q + 1))

        def state(i: Column, j: Column, cost: Column) -> Column:
            return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), cost.cast("int").alias("cost"))

        def some(z: Column, at: Column, n: Column) -> Column:
            # A slice would copy the list each time.
            return F.concat_ws("", *[F.when(n > k, F.get(z, at + k)) for k in range(AHEAD)])

        def over(p: Column, q: Column) -> Column:
            return state(i + p, j + q, s["cost"] + F.call_function("levenshtein", some(x, i, p), some(y, j, q)))

        jump = F.coalesce(*[F.when(meets(p, q), p * (AHEAD + 1) + q) for p, q in ahead], F.lit(AHEAD + 2))  # one word each if none meet
        rest = F.length(F.array_join(F.slice(x, i + 1, F.size(x)), "")) + F.length(F.array_join(F.slice(y, j + 1, F.size(y)), ""))
        ended = state(F.size(x), F.size(y), s["cost"] + rest)
        moved = F.when(F.get(x, i) == F.get(y, j), state(i + 1, j + 1, s["cost"])).otherwise(let(jump, lambda k: over(F.floor(k / (AHEAD + 1)).cast("int"), k % (AHEAD + 1))))
        over_now = (s["cost"] > most) | ((i >= F.size(x)) & (j >= F.size(y)))
        return F.when(over_now, s).when((i >= F.size(x)) | (j >= F.size(y)), ended).otherwise(moved)

    begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("cost"))
    return F.aggregate(F.sequence(F.lit(0), F.size(x) + F.size(y)), begin, lambda s, _: step(s), lambda s: s["cost"])


def within(a: Column, b: Column, allowed: Column) -> Column:
    """Whether the edit distance of two lines, given as words, is allowed.

    Words that both begin or end with leave the distance as it is. What is left is first bounded from above:
    by the length of the longer, by word after word and, where lines are long, by an alignment of words. Only if that is too much is the distance itself computed.
    """
    shared = lambda x, y: F.coalesce(F.nullif(F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False), F.lit(0)) - 1, F.size(x)).cast("int")
    cut = lambda x, first, n: F.slice(x, first + 1, n)

    def middles(s: Column) -> Column:
        head = shared(s["a"], s["b"])
        return F.struct(*[F.reverse(cut(s[c], head, F.size(s[c]) - head)).alias(c) for c in "ab"], s["most"])

    def tails(s: Column) -> Column:
        tail = shared(s["a"], s["b"])
        # With a blank after each word edits are those of the lines: both end with it.
        return F.struct(*[F.transform(F.reverse(cut(s[c], tail, F.size(s[c]) - tail)), lambda w: F.concat(w, F.lit(" "))).alias(c) for c in "ab"], s["most"])

    def decide(s: Column) -> Column:
        x, y, most = s["a"], s["b"], s["most"]
        whole = lambda z: F.array_join(z, "")
        length = F.greatest(F.length(whole(x)), F.length(whole(y)))
        in_place = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 0).otherwise(F.greatest(F.length(p), F.length(q)))), F.lit(0), lambda n, k: n + k)
        exact = F.call_function("levenshtein", whole(x), whole(y), most) >= 0
        return (length <= most) | (in_place <= most) | ((length > LONG) & (walked(x, y, most) <= most)) | exact

    return let(let(let(F.struct(a.alias("a"), b.alias("b"), allowed.alias("most")), middles), tails), decide)


def verified(pairs: DataFrame, lines: DataFrame, docs: DataFrame, similarity: float, text_col: str) -> DataFrame:
    """Of pairs (u, v) of lines those with the edit similarity, as a table."""
    pairs = materialize(pairs.distinct())
    ends = materialize(pairs.select(F.col("u").alias("line")).union(pairs.select("v")).distinct())
    texts = texts_of(lines, ends, docs, text_col)
    both = pairs.join(texts.select(F.col("line").alias("u"), F.col("words").alias("a")), "u").join(texts.select(F.col("line").alias("v"), F.col("words").alias("b")), "v")
    length = lambda c: F.length(F.array_join(c, " "))
    both = both.withColumn("m", F.greatest(length("a"), length("b"))).withColumn("k", F.least(length("a"), length("b")))
    allowed = F.floor(F.col("m") * (1 - similarity) + 1e-9).cast("int")
    near = both.withColumn("allowed", allowed).filter(F.col("m") - F.col("k") <= F.col("allowed")).filter(within(F.col("a"), F.col("b"), F.col("allowed")))
    out = materialize(near.select("u", "v"))
    for table in (pairs, ends, texts):
        discard(table)
    return out


def groups(lines: DataFrame, docs: DataFrame, radius: int, similarity: float, text_col: str) -> DataFrame:
    """(node, root) of lines that link to other lines; lines: what lines_of() returned, without lines of no words."""
    distinct = materialize(lines.groupBy("line").agg(F.min("size").alias("size"), *[F.min(b).alias(b) for b in HASH]))
    by = Window.partitionBy("bucket").orderBy("line")
    # Of all entries only names travel; blocks follow for those in buckets of two lines or more.
    # Without array_compact the step becomes one method that is too long for the JVM to compile.
    entries = distinct.select("line", F.explode(F.array_compact(buckets())).alias("bucket"))
    entries = entries.withColumn("is_first", F.lag("line").over(by).isNull()).withColumn("more", F.lead("line").over(by).isNotNull())
    shared = materialize(entries.filter("more OR NOT is_first").drop("more"))
    dealt = materialize(distinct.join(shared, "line"))
    discard(shared)
    discard(distinct)

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select([F.col(c) if c == "bucket" else F.col(c).alias(c + tag) for c in df.columns])

    def near() -> Column:
        """SimHashes within the radius, and lengths that the edit similarity does not rule out."""
        a, b = F.col("size_u"), F.col("size_v")
        return (F.abs(a - b) <= F.floor(F.greatest(a, b) * (1 - similarity) + 1e-9)) & (bits() <= radius)

    def bits() -> Column:
        return sum(F.bit_count(F.col(x + "_u").bitwiseXOR(F.col(x + "_v")).bitwiseAND(F.lit(BITS))) for x in HASH)

    entry = ["bucket", "line", "size", *HASH]
    stars = side(dealt.filter("NOT is_first").select(entry), "_u").join(side(dealt.filter("is_first").select(entry), "_v"), "bucket").filter(near())
    links = verified(stars.select(F.col("line_u").alias("u"), F.col("line_v").alias("v")), lines, docs, similarity, text_col)
    roots = materialize(connected(links))
    named = dealt.select(entry).join(roots.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    sizes = named.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.count("*").alias("n"))
    # Buckets of one component need nothing more.
    mixed = materialize(named.join(sizes.filter("n > 1"), "bucket").withColumn("in_main", F.col("root") == F.col("main")).drop("main", "n"))
    pairs = side(mixed.filter("NOT in_main"), "_u").join(side(mixed, "_v"), "bucket").filter("root_u <> root_v AND (in_main_v OR line_u < line_v)").filter(near())
    more = verified(pairs.select(F.greatest("line_u", "line_v").alias("u"), F.least("line_u", "line_v").alias("v")), lines, docs, similarity, text_col)
    out = materialize(connected(links.union(more)))
    for table in (dealt, links, roots, mixed, more):
        discard(table)
    return out


def marked(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of documents that lose a line: doc_id, text_hash and gone, the places of these lines in order."""
    rows = materialize(lines_of(docs, text_col, id_col))
    roots = groups(rows.filter("line IS NOT NULL"), docs, radius, similarity, text_col)
    rows = rows.filter("line IS NOT NULL").select("doc_id", "text_hash", "place", "line")
    named = rows.join(small(roots.withColumnRenamed("node", "line"), roots.count()), "line", "left").withColumn("root", F.coalesce("root", "line")).drop("line")
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"), F.col("place"))
    first = materialize(named.groupBy("root").agg(F.min(at).alias("kept"), F.count("*").alias("n")).filter("n > 1"))
    later = split_join(named, first, "root", "n").filter(F.col("kept") != at)
    return later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("gone"))  # a text's own lines at most


def dedup_lines(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, text_col: str = "text", id_col: str = "doc_id", count_col: str | None = "n_dropped") -> DataFrame:
    """docs with the repeated lines taken out of text_col; adds count_col (long; none for None), in place of a column of that name."""
    found = marked(docs, radius, similarity, text_col, id_col).select(F.col("doc_id").alias("__ink_id"), F.col("text_hash").alias("__ink_hash"), F.col("gone").alias("__ink_gone"))
    same = (F.xxhash64(text_col) == F.col("__ink_hash")) & F.col(id_col).eqNullSafe(F.col("__ink_id"))
    joined = docs.join(found, same, "left")

    def without(lines: Column) -> Column:
        """The lines between two places that are gone, for each two, in order."""
        before = lambda i: F.coalesce(F.get(F.col("__ink_gone"), i - 1), F.lit(-1))
        ends = F.concat("__ink_gone", F.array(F.size(lines)))
        return F.array_join(F.flatten(F.transform(ends, lambda end, i: F.slice(lines, before(i) + 2, end - before(i) - 1))), "\n")

    clean = F.when(F.col("__ink_gone").isNull(), F.col(text_col)).otherwise(let(F.split(text_col, "\n"), without))
    dropped = F.coalesce(F.size("__ink_gone"), F.lit(0)).cast("long")
    kept = [clean.alias(c) if c == text_col else docs[c] for c in docs.columns if c != count_col]
    return joined.select(*kept, *([dropped.alias(count_col)] if count_col else []))


def op1(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text"))
