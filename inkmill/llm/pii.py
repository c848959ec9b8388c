"""Format-preserving Feistel pseudonyms for personal data (DataFrame functions only).

Values are found by pattern, validated, and replaced by a keyed permutation of their own format: a
Feistel network whose round function is a keyed SHA-256. Equal values get equal pseudonyms in every
document, different ones different pseudonyms, and who holds the key can undo it (see `inverse`).

| kind | valid if | permuted |
|-|-|-|
| card | 13 to 19 digits with a right Luhn digit | all digits but first and last; the Luhn digit is made anew |
| iban | remainder 97 is 1 | the account part; the check digits are made anew |
| ssn | area 001-899 but 666, group and serial not 0 | within valid numbers |
| phone | +1 or ten digits in groups, area and exchange from 200; or + and 7 to 15 digits | the same; else all but the country's first digits |
| ip | four numbers up to 255 | all 32 bits |
| date | a day of the calendar, as y-m-d, d/m/y or d.m.y | days within its 400 years |
| email | an address | letters and digits before the last dot, each within its kind |
| secret | access keys and tokens by their first letters (AKIA, ghp_ and its kin); a value with a digit after "Bearer "; a value after password, pwd, passphrase, token, secret or key, in any case and with any prefix (SECRET_KEY, accessToken), and "="; after ":" a value in quotes, with a digit or at its line's end, as words of prose follow it too | letters and digits, each within its kind |

What no check accepts stays as it is, and so does all other text: days written month first (which one, the
format does not tell), ten digits in one run, and addresses of the longer kind (IPv6) among it. Text of letters and digits is
permuted in two halves, each character moved within its own kind, so punctuation stays in place.

Defined results: a null text stays null, with no values; repeated rows and equal values agree; an empty
table gives an empty result; other columns pass through `pseudonymize`. Whole texts are read, line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import let

ROUNDS = 8
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

#: Patterns of the kinds, in the order in which they are tried.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"\bAKIA[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|(?<![A-Za-z0-9])(?i:bearer) (?=[A-Za-z._~+/-]*\d)[A-Za-z0-9._~+/-]{16,}|(?:(?<![A-Za-z0-9])(?i:password|passwd|passphrase|pwd|token|secret|(?:api|access|secret|private)[_-]?key|key)|(?<=[a-z0-9])(?:Password|Token|Secret|Key))[\"']? ?(?:= ?[\"']?|: ?(?:[\"']|(?=[A-Za-z_/+-]*\d)|(?=[A-Za-z_/+-]+[ \t\r]*(?:\n|$))))[A-Za-z0-9_/+-]{8,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every pattern needs one of these, and none goes beyond a line: of a text only lines with one are searched.
NEEDED = "[@=:0-9]|AKIA|gh[pousr]_"
CYCLE = 146_097  # days in 400 years, 27 * 5411
NANP = r"(?:\+1[ .-]?)?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}"


def noise(key: str, *parts: Column) -> Column:
    """A keyed number below 2 ** 60."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def rounds(inverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def permute_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, inverse: bool = False) -> Column:
    """A keyed permutation of pairs below size_a and size_b, as a struct (a, b); even rounds move a."""
    sign = F.lit(-1 if inverse else 1)

    def step(s: Column, r: Column) -> Column:
        moved_a = F.pmod(s["a"] + sign * F.pmod(noise(key, r, s["b"]), F.lit(size_a)), F.lit(size_a))
        moved_b = F.pmod(s["b"] + sign * F.pmod(noise(key, r, s["a"]), F.lit(size_b)), F.lit(size_b))
        even = r % 2 == 0
        return F.struct(F.when(even, moved_a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(moved_b).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(rounds(inverse), start, step)


def shift(text: Column, by: Column, r: Column, key: str, alphabets: list[str], inverse: bool) -> Column:
    """Moves each character of text within its alphabet, by amounts keyed by the other half."""

    def moved(c: Column, i: Column) -> Column:
        amount, out = noise(key, r, i, by), None
        for letters in alphabets:
            n = len(letters)
            at = F.instr(F.lit(letters), c)
            to = F.substring(F.lit(letters), F.pmod(at - 1 + (-1 if inverse else 1) * F.pmod(amount, F.lit(n)), F.lit(n)).cast("int") + 1, F.lit(1))
            inside = (at > 0) & (F.length(c) == 1)
            out = F.when(inside, to) if out is None else out.when(inside, to)
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), moved), "")


def permute_text(text: Column, key: str, alphabets: list[str], inverse: bool = False) -> Column:
    """A keyed permutation of texts that keeps each character's alphabet; others stay."""

    def run(t: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(F.substring(t, F.lit(1), half).alias("a"), F.substring(t, half + 1, F.length(t)).alias("b"))

        def step(s: Column, r: Column) -> Column:
            even = r % 2 == 0
            return F.struct(F.when(even, shift(s["a"], s["b"], r, key, alphabets, inverse)).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(shift(s["b"], s["a"], r, key, alphabets, inverse)).alias("b"))

        return let(F.aggregate(rounds(inverse), start, step), lambda s: F.concat(s["a"], s["b"]))

    return let(text, run)


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def dressed(m: Column, characters: Column, kind: str) -> Column:
    """m with its characters of a class replaced in order by those given; what stands between stays."""
    gaps = F.split(m, kind, -1)
    return let(F.struct(gaps.alias("g"), F.split(characters, "").alias("c")), lambda x: F.array_join(F.transform(x["g"], lambda g, i: F.concat(g, F.coalesce(F.get(x["c"], i), F.lit("")))), ""))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number whose last digit counts once."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def remainder_97(text: Column) -> Column:
    """Of the number that the letters (A is 10) and digits of text write."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: let(F.instr(F.lit(DIGITS + UPPER), c) - 1, lambda v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97)))


def card(m: Column, key: str, inverse: bool) -> Column:
    def run(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permute_text(F.substring(d, F.lit(2), F.length(d) - 2), f"{key}card", [DIGITS], inverse))
        full = let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        valid = F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)
        return F.when(valid, dressed(m, full, r"\d")).otherwise(m)

    return let(only_digits(m), run)


def iban(m: Column, key: str, inverse: bool) -> Column:
    def run(c: Column) -> Column:
        country, account = F.substring(c, 1, 2), F.substring(c, F.lit(5), F.length(c))
        full = let(permute_text(account, f"{key}iban", [DIGITS, UPPER], inverse), lambda p: F.concat(country, F.lpad((98 - remainder_97(F.concat(p, country, F.lit("00")))).cast("string"), 2, "0"), p))
        valid = remainder_97(F.concat(account, F.substring(c, 1, 4))) == 1
        return F.when(valid, dressed(m, full, "[A-Z0-9]")).otherwise(m)

    return let(F.regexp_replace(m, " ", ""), run)


def ip(m: Column, key: str, inverse: bool) -> Column:
    def run(o: Column) -> Column:
        p = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, f"{key}ip", inverse)
        out = let(p, lambda s: F.concat_ws(".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))
        return F.when(F.array_max(o) < 256, out).otherwise(m)

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), run)


def ssn(m: Column, key: str, inverse: bool) -> Column:
    def run(o: Column) -> Column:
        place = o[0] - 1 - (o[0] > 666).cast("int")  # 898 areas: 001 to 899 but 666
        p = permute_pair(place * 99 + o[1] - 1, o[2] - 1, 898 * 99, 9999, f"{key}ssn", inverse)
        out = let(p, lambda s: let(F.floor(s["a"] / 99) + 1, lambda q: F.format_string("%03d-%02d-%04d", q + (q > 665).cast("int"), s["a"] % 99 + 1, s["b"] + 1)))
        return F.when(o[0].between(1, 899) & (o[0] != 666) & (o[1] > 0) & (o[2] > 0), out).otherwise(m)

    return let(F.transform(F.split(m, "-"), lambda x: x.cast("int")), run)


def phone(m: Column, key: str, inverse: bool) -> Column:
    def national(d: Column) -> Column:
        number = F.right(d, F.lit(10))
        part = lambda at, n: F.substring(number, at, n).cast("int")
        p = permute_pair((part(1, 3) - 200) * 800 + part(4, 3) - 200, part(7, 4), 640_000, 10_000, f"{key}nanp", inverse)
        return let(p, lambda s: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), F.format_string("%03d%03d%04d", F.floor(s["a"] / 800) + 200, s["a"] % 800 + 200, s["b"])))

    def other(d: Column) -> Column:
        return F.concat(F.substring(d, 1, 2), permute_text(F.substring(d, F.lit(3), F.length(d)), f"{key}phone", [DIGITS], inverse))

    def run(d: Column) -> Column:
        return F.when(m.rlike(f"^(?:{NANP})$"), dressed(m, national(d), r"\d")).when(m.startswith("+") & F.length(d).between(7, 15), dressed(m, other(d), r"\d")).otherwise(m)

    return let(only_digits(m), run)


def date(m: Column, key: str, inverse: bool) -> Column:
    def run(p: Column) -> Column:
        iso = F.length(p[0]) == 4
        written = F.when(iso, F.concat_ws("-", p[0], p[1], p[2])).otherwise(F.concat_ws("-", p[2], F.lpad(p[1], 2, "0"), F.lpad(p[0], 2, "0")))

        def moved(day: Column) -> Column:
            q = F.pmod(day, F.lit(CYCLE))
            s = permute_pair(F.floor(q / 5411), q % 5411, 27, 5411, f"{key}date", inverse)
            new = let(s, lambda s: F.date_from_unix_date((day - q + s["a"] * 5411 + s["b"]).cast("int")))
            out = let(new, lambda n: F.date_format(n, "dd/MM/yyyy"))
            return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.replace(out, F.lit("/"), F.regexp_extract(m, "[/.]", 0)))

        day = F.unix_date(F.try_to_timestamp(written, F.lit("yyyy-MM-dd")).cast("date"))
        return F.when(day.isNull(), m).otherwise(let(day, moved))

    return let(F.split(m, r"[-/.]"), run)


def email(m: Column, key: str, inverse: bool) -> Column:
    last = F.length(m) - F.length(F.substring_index(m, ".", -1)) - 1
    return F.concat(permute_text(F.substring(m, F.lit(1), last), f"{key}email", [LOWER, UPPER, DIGITS], inverse), F.substring(m, last + 1, F.length(m)))


def secret(m: Column, key: str, inverse: bool) -> Column:
    def run(x: Column) -> Column:
        mixed = permute_text(x["rest"], f"{key}secret", [LOWER, UPPER, DIGITS], inverse)
        # After "bearer" digits tell a token from prose, so they stay digits.
        return F.concat(x["start"], F.when(x["rest"].rlike("^[0-9a-f]+$") & ~x["start"].rlike("^(?i:bearer) $"), permute_text(x["rest"], f"{key}hex", [HEX], inverse)).otherwise(mixed))

    start = F.regexp_extract(m, r"^(?:AKIA|gh[pousr]_|(?i:bearer) |[\w-]+[\"']? ?[=:] ?[\"']?)", 0)
    return let(F.struct(start.alias("start"), F.substring(m, F.length(start) + 1, F.length(m)).alias("rest")), run)


KINDS = {"email": email, "secret": secret, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}


def pseudonym(m: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one found value; the value itself where it is not valid."""
    chain = None
    for kind, permute in KINDS.items():
        test = m.rlike(f"^(?:{PATTERNS[kind]})$")
        chain = F.when(test, permute(m, key, inverse)) if chain is None else chain.when(test, permute(m, key, inverse))
    return chain.otherwise(m)


def replaced(text: Column, key: str, inverse: bool = False) -> Column:
    """A struct of the text with pseudonyms and the number of values that were replaced."""

    def line(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(ANY), 0)
        both = F.struct(F.split(t, ANY, -1).alias("gaps"), F.transform(found, lambda m: F.struct(m.alias("was"), pseudonym(m, key, inverse).alias("now"))).alias("values"))
        return let(both, lambda x: F.struct(
            F.array_join(F.transform(x["gaps"], lambda g, i: F.concat(g, F.coalesce(F.get(x["values"], i)["now"], F.lit("")))), "").alias("text"),
            F.size(F.filter(x["values"], lambda v: v["was"] != v["now"])).cast("long").alias("n"),
        ))

    def run(t: Column) -> Column:
        none = F.lit(0).cast("long").alias("n")
        lines = F.transform(F.split(t, "\n", -1), lambda x: F.when(x.rlike(NEEDED), line(x)).otherwise(F.struct(x.alias("text"), none)))
        return let(lines, lambda y: F.struct(F.array_join(F.transform(y, lambda x: x["text"]), "\n").alias("text"), F.aggregate(y, F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_replaced")))

    return F.when(text.isNotNull(), let(text, run)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_replaced")))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """docs with pseudonyms in text_col; inverse=True undoes it under the same key."""
    return docs.withColumn(text_col, replaced(F.col(text_col), key, inverse)["text"])


def op5(docs: DataFrame, key: str) -> DataFrame:
    return docs.select("doc_id", replaced(F.col("text"), key).alias("r")).select("doc_id", "r.text", "r.n_replaced")
