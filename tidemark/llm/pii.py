"""Personal data in texts: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

All of it is column expressions, row by row: no Python on executors, no shuffle. Patterns are possessive and begin only where a run of
their characters begins (or where the match before ended), so that long runs cost time in proportion to their length; they find what
the plain patterns in their remarks find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

# Patterns. Those of BASE are, in this order, what every result holds; ADDED needs a checksum or a word nearby besides.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",  # [0-9]([\x20-]?[0-9])+
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = {
    "short_card": BASE["card"],  # the same matches, of 13 to 15 digits
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "social_security": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9(.-])(?<!\+[0-9]{1,3}[ .-]?)\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
KINDS = (*BASE, *ADDED)

# Lengths of bank account numbers by country.
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

# Scores before words are looked at, words that raise or lower them, by how much, and what an added span must reach.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "short_card": 0.4, "iban": 0.8, "social_security": 0.4, "local_phone": 0.4}
WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "address"),
    "ip": ("ip", "host", "server", "login", "address"),
    "card": ("card", "credit", "debit", "visa", "mastercard", "amex", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"),
    "short_card": ("card", "credit", "debit", "amex", "diners", "payment", "karte", "carte", "tarjeta"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "transfer"),
    "social_security": ("ssn", "social security", "social", "taxpayer"),
    "local_phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"),
}
AGAINST = ("version", "order", "invoice", "isbn", "serial", "build", "chapter", "section", "ticket")
RAISE, LOWER, ENOUGH = 0.35, 0.3, 0.7
#: Code points before and after a match in which words count; they end at the neighbouring match of the kind.
BEFORE, AFTER = 48, 16

#: Sums run in blocks of so many, so that long arrays aren't copied once an element.
BLOCK = 64

SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(x: Column) -> Column:
    """The sums of the first, the first two, ... of an array of longs that isn't empty."""
    last = lambda a: F.element_at(a, -1)
    follow = lambda start, values: F.aggregate(values, F.array(start), lambda a, v: F.concat(a, F.array(last(a) + v)))

    def blockwise(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, v: a + v))
        offsets = let(follow(F.lit(0).cast("long"), totals), lambda o: F.slice(o, 1, F.size(o) - 1))
        return F.flatten(F.zip_with(blocks, offsets, lambda b, o: let(follow(o, b), lambda s: F.slice(s, 2, F.size(s) - 1))))

    return let(x, lambda x: let(F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK))), blockwise))


def located(text: Column, kind: str, pattern: str) -> Column:
    """The pattern's matches, leftmost and without overlaps: kind, start and end (code points, end exclusive), the text of the match, and
    what stands before and after it."""

    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            sizes = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: (F.length(m) + F.length(g)).cast("long"))
            before, after = F.transform(gaps, lambda g: F.substring(g, -BEFORE, BEFORE)), F.transform(gaps, lambda g: F.substring(g, 1, AFTER))
            zipped = F.arrays_zip(
                found.alias("value"), running_sums(sizes).alias("end"), F.slice(before, 1, F.size(found)).alias("before"), F.slice(after, 2, F.size(found)).alias("after")
            )
            fields = lambda s: F.struct(F.lit(kind), s["end"] - F.length(s["value"]), s["end"], s["value"], s["before"], s["after"])
            return F.transform(zipped, fields).cast(SPAN)

        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(let(F.split(text, pattern, -1), with_gaps))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """From the right every second digit counts twice, less 9 above 9; the sum is a multiple of ten."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """The first four characters at the end, letters as 10 to 35: the number's remainder by 97 is 1."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))

    def follow(rest: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), follow) == 1


def valid(kind: str, value: Column) -> Column:
    """What a match must pass besides its pattern; a match that doesn't is dropped, its parts aren't tried."""
    digits = digits_of(value)
    count = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind in ("card", "short_card"):
        return F.when(count.between(16, 19) if kind == "card" else count.between(13, 15), luhn(digits)).otherwise(False)
    if kind == "phone":
        return count.between(8, 15)
    if kind == "iban":
        account = F.regexp_replace(value, " ", "")
        length = F.coalesce(*[F.when(F.substring(account, 1, 2) == country, n) for country, n in IBAN_LENGTH.items()])
        return F.when(F.length(account) == length, mod97(account)).otherwise(False)
    if kind == "social_security":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def scored(kind: str, span: Column) -> Column:
    """A kind's score, more if one of its words stands nearby, less if before it stands one
    that such numbers follow in other meanings."""
    before = F.lower(span["before"])
    near = F.concat(before, F.lit(" "), F.lower(span["after"]))
    says = lambda text, words: text.rlike(r"(?:^|[^\p{L}])(?:" + "|".join(words) + r")(?:[^\p{L}]|$)")
    raised = F.when(says(near, WORDS[kind]), F.lit(RAISE)).otherwise(0.0) - F.when(says(before, AGAINST), F.lit(LOWER)).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(SCORE[kind]) + raised)), 2)


def confirmed(kind: str, spans: Column) -> Column:
    """Those of a kind's matches that pass its check, with their score; of an added kind those that reach ENOUGH."""
    full = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), scored(kind, s).alias("score"))
    passed = F.transform(F.filter(spans, lambda s: valid(kind, s["value"])), full)
    return passed if kind in BASE else F.filter(passed, lambda s: s["score"] >= ENOUGH)


def find(docs: DataFrame, *more: str) -> DataFrame:
    """Returns a row a document: doc_id, the columns asked for, and spans: array of (kind, start, end, value, score), by kind (as in
    KINDS), then start; positions in code points, end exclusive.

    Matches of BASE stay if they pass their check, whatever their score; those of ADDED need a score of ENOUGH too. Null texts count as
    empty and have no spans; repeated rows give repeated rows; null ids stay."""
    text = F.coalesce("text", F.lit(""))
    spans = F.concat(*[confirmed(kind, located(text, kind, pattern)) for kind, pattern in (BASE | ADDED).items()])
    return documents(docs, *more).select("doc_id", *more, spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
