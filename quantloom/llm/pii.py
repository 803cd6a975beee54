"""Personal data: patterns propose spans, checksums and ranges confirm them, nearby words set the score.

Everything is one expression per kind over the text column, so rows never move: the matches and the
gaps between them (the text split at the same pattern) give every position by summing lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths are summed in blocks of this many matches, so texts with very many matches stay cheap.
BLOCK = 256
#: Code points before a match in which context words count, and what they add to the score.
NEAR, BONUS = 40, 0.3


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a text without a match of this has no span of the kind
    words: str  # context
    score: float


# The patterns.  Possessive forms and look-behinds only keep matching linear; they
# find the same spans as the plain forms.
EMAIL = Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write", 0.7)
IP = Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", "ip|host|server|address", 0.6)
CARD = Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9]", "card|visa|credit|pay", 0.7)
PHONE = Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", "phone|call|tel|fax|mobile", 0.6)
IBAN = Kind("iban", r"(?<![A-Za-z0-9_])(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9_])", "[A-Z]{2}[0-9]{2}", "iban|account|bank", 0.7)
BASE = (EMAIL, IP, CARD, PHONE)
KINDS = (*BASE, IBAN)
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def counted(n: Column) -> Column:
    """0 .. n-1, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    def add(acc, i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)
    return F.aggregate(counted(F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, country and check digits moved to its end, leaves 1 modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    def add(acc, i):
        v = F.instr(F.lit(ALPHABET), F.substr(turned, i + 1, F.lit(1))) - 1
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(counted(F.length(turned)), F.lit(0), add) == 1


def confirmed(kind: Kind, value: Column) -> Column:
    if kind is IP:
        return value.rlike(IP_PARTS)
    if kind is CARD:
        return let(F.translate(value, " -", ""), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind is PHONE:
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    if kind is IBAN:
        return let(F.translate(value, " ", ""), lambda v: F.length(v).between(15, 34) & mod97(v))
    return F.lit(True)


def spans_of(kind: Kind, text: Column) -> Column:
    """Confirmed spans of one kind, in code points, as an array of structs; leftmost and non-overlapping."""
    pattern, nothing = F.lit(kind.pattern), F.array().cast(SPAN)
    near = F.lit(rf"(?i)(?<![A-Za-z0-9_])(?:{kind.words})(?![A-Za-z0-9_])")

    def positions(pairs: Column) -> Column:
        """Each pair (gap, value) with the start of its value: the block's offset plus the steps inside it."""
        def start(p, i, step, offsets):
            inside = total(F.slice(step, (i - i % BLOCK) + 1, i % BLOCK))
            return F.get(offsets, F.floor(i / BLOCK).cast("int")) + inside + F.length(p["gap"])
        def by_blocks(step: Column) -> Column:
            sums = F.transform(counted(F.ceil(F.size(step) / BLOCK).cast("int")), lambda b: total(F.slice(step, b * BLOCK + 1, F.lit(BLOCK))))
            offsets = let(sums, lambda x: F.transform(counted(F.size(x)), lambda b: total(F.slice(x, F.lit(1), b))))
            return let(offsets, lambda o: F.transform(pairs, lambda p, i: F.struct(p["gap"].alias("gap"), p["value"].alias("value"), start(p, i, step, o).alias("start"))))
        return let(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["value"])), by_blocks)

    def listed(found: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, f: F.struct(g.alias("gap"), f.alias("value")))
        good = F.filter(let(pairs, positions), lambda x: confirmed(kind, x["value"]))
        spans = F.transform(good, lambda x: F.struct(
            F.lit(kind.name).alias("kind"), x["start"].cast("int").alias("start"), (x["start"] + F.length(x["value"])).cast("int").alias("end"),
            x["value"].alias("value"),
            F.when(F.regexp_like(F.right(x["gap"], F.lit(NEAR)), near), F.lit(kind.score + BONUS)).otherwise(F.lit(kind.score)).alias("score")))
        return F.when(F.size(found) > 0, spans).otherwise(nothing)

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.when(text.rlike(kind.hint), let(found, listed)).otherwise(nothing)


def find(text: Column, kinds=KINDS) -> Column:
    """All confirmed spans of the text by kind as listed, then start; null text has none."""
    return F.coalesce(F.concat(*[spans_of(k, text) for k in kinds]), F.array().cast(SPAN))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    def step(acc, s):
        new = s["start"] >= acc["at"]
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(new, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = let(F.aggregate(ordered, start, step), lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found`` (array of kind, start, end, value, score) of every document (doc_id, text).

    Null and empty texts have no spans.  Null doc_ids and repeated rows pass through one by one, other
    columns are ignored, an empty table gives an empty result.  Spans of different kinds may overlap.
    """
    return docs.select("doc_id", find(F.col("text")).alias("found"))
