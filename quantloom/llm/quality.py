"""Quality rules whose limits come from the corpus itself: quantile sketches per language and source, then a joined filter.

Each rule is a whole number per document (symbols or repeated words a million words, repeated lines a million lines, thousandths of a character a
word).  A sketch counts the values of a group in buckets of equal width within a power of two (64 each, exact below 128), so it has at most
a few hundred rows whatever the group's size, two sketches merge by adding counts, and a quantile read from it is within 1/64 of the exact
one.  Sketches are kept per (language, source), and merged upwards for a language and for the whole corpus; a group of fewer than ``LEAST_DOCUMENTS``
documents uses the next level.  Limits lie ``REACH`` times the distance between the quartiles outside them, where the distance counts as no less than a
rule's ``least``, so a uniform group doesn't reject what hardly differs.  Documents that fail the fixed base rules don't shape the limits.

Rules for odd input.  A null text counts as empty: no words, base failed, not kept.  Null language and null source are groups like any other.
Whole texts are read; time is n log n in the words of a text, so very long ones are fine.  Repeated rows and ties are judged alike, one by one.  Other
columns are ignored; an empty table gives an empty result.  A group may hold any share of all rows: only counts per bucket are shuffled, and limits are joined
to the documents, broadcast only where their staged table is small enough for the planner's own size limit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .common import add_columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Words of a window; words a document needs; percent of its words that repeated windows may cover.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
LEAST_DOCUMENTS, REACH = 100, 3
#: Buckets to each power of two.
FINE = 64

COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rule:
    """A whole number ``top * scale div bottom``; ``least`` is the smallest distance between quartiles that counts."""

    name: str
    top: str
    bottom: str
    scale: int
    least: int
    below: bool = False

    @property
    def value(self) -> str:
        return f"{self.top} * {self.scale} div greatest({self.bottom}, 1)"


RULES = (
    Rule("symbols", "n_symbols", "n_words", 1_000_000, 30_000),
    Rule("lines", "n_dup_lines", "n_lines", 1_000_000, 50_000),
    Rule("repeats", "n_repeat_words", "n_words", 1_000_000, 50_000),
    Rule("length", "word_chars", "n_words", 1_000, 700, below=True),
)


def repeated_words(words: list[str]) -> int:
    """Words that stand in a window found twice or more.  Windows of 2, 4, 8 words are numbered in turn: equal numbers mean equal words."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == n:
        return 0
    for step in (1, 2, 4):
        ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1]
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[:len(ids)] += again
    edge[WINDOW:] -= again
    return int(np.count_nonzero(np.cumsum(edge[:n])))


def count(text: str | None) -> tuple[int, int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of each text, and base_failed; one pass over the texts, without a shuffle."""
    counted = add_columns(docs.select("doc_id", "lang", "source", "text"), "text", lambda text: count(text), COUNTS)
    return counted.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def bucket(v: Column) -> Column:
    """Number of the bucket of a whole number of 0 or more: equal steps within each power of two."""
    shift = F.greatest(F.length(F.bin(v)) - (FINE.bit_length()), F.lit(0))
    return (shift * FINE + F.call_function("shiftright", v, shift)).cast("int")


def least_of(b: Column) -> Column:
    """Smallest value of a bucket."""
    shift = F.greatest(F.floor(b / FINE).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (b - shift * FINE).cast("long"), shift)


def sketch(counted: DataFrame) -> DataFrame:
    """Mergeable sketches: documents per (lang, source, rule, bucket)."""
    values = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.expr(r.value).alias("v")) for r in RULES])).alias("x")
    each = counted.where(~F.col("base_failed")).select("lang", "source", values)
    return each.groupBy("lang", "source", F.col("x.rule").alias("rule"), bucket(F.col("x.v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """Documents and the quartiles of each group and rule; sketches of a group are merged by adding counts."""
    merged = sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    up = merged.select(*keys, "rule", "bucket", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("documents"))
    first = [F.min(F.when(4 * F.col("upto") >= k * F.col("documents"), F.col("bucket"))).alias(f"b{k}") for k in (1, 3)]
    found = up.groupBy(*keys, "rule").agg(F.first("documents").alias("documents"), *first)
    return found.select(*keys, "rule", "documents", least_of(F.col("b1")).alias("q1"), least_of(F.col("b3")).alias("q3"))


def limits(sketches: DataFrame) -> DataFrame:
    """lang, source and per rule low_ and high_ (null: none), from the narrowest level with enough documents."""
    own = quartiles(sketches, "lang", "source")
    spoken = quartiles(sketches, "lang").select(F.col("lang").alias("_lang"), F.col("rule").alias("_rule"), F.struct("documents", "q1", "q3").alias("spoken"))
    everything = quartiles(sketches).select(F.col("rule").alias("_all"), F.struct("documents", "q1", "q3").alias("everything"))
    joined = own.join(spoken, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rule") == F.col("_rule"))).join(everything, F.col("rule") == F.col("_all"))
    enough = lambda level: F.col(f"{level}documents") >= LEAST_DOCUMENTS
    used = F.when(enough(""), F.struct("documents", "q1", "q3")).when(enough("spoken."), F.col("spoken")).otherwise(F.col("everything"))
    rule = joined.select("lang", "source", "rule", used.alias("u"))
    columns = []
    for r in RULES:
        reach = F.greatest(F.col("u.q3") - F.col("u.q1"), F.lit(r.least)) * REACH
        columns += [F.max(F.when(F.col("rule") == r.name, F.col("u.q3") + reach)).alias(f"high_{r.name}")]
        columns += [F.max(F.when(F.col("rule") == r.name, F.col("u.q1") - reach)).alias(f"low_{r.name}")] if r.below else []
    return rule.groupBy("lang", "source").agg(*columns)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, counts, base_failed, the limits used, ``failed`` (names of the rules a document breaks) and kept."""
    counted = stage(measure(docs), "quality-counts")
    limit = stage(limits(sketch(counted)), "quality-limits").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    row = counted.join(limit, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    broken = []
    for r in RULES:
        v = F.expr(r.value)
        out = v > F.col(f"high_{r.name}")
        out = out | (v < F.col(f"low_{r.name}")) if r.below else out
        broken.append(F.when(out, F.lit(r.name)))
    row = row.withColumn("failed", F.array_compact(F.array(*broken)))
    return row.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def limits_sql() -> str:
    """The same limits and verdicts as plain SQL over a table ``m`` of counts with row number ``r``."""
    rows = " UNION ALL ".join(f"SELECT lang, source, '{r.name}' AS rule, {r.top} * {r.scale} // greatest({r.bottom}, 1) AS v FROM m WHERE NOT base_failed" for r in RULES)
    shift = f"greatest(length(bin(v)) - {FINE.bit_length()}, 0)"
    low = f"((b - greatest(b // {FINE} - 1, 0) * {FINE}) << greatest(b // {FINE} - 1, 0))"
    levels = []
    for name, keys in (("q2", "lang, source, "), ("q1", "lang, "), ("q0", "")):
        levels.append(f"""{name} AS (SELECT {keys}rule, max(documents) AS documents, min({low}) FILTER (4 * upto >= documents) AS a, min({low}) FILTER (4 * upto >= 3 * documents) AS z
  FROM (SELECT {keys}rule, b, sum(n) OVER (PARTITION BY {keys}rule ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}rule) AS documents FROM (SELECT {keys}rule, b, sum(n) AS n FROM k GROUP BY ALL)) GROUP BY {keys}rule)""")
    pick = lambda c: f"CASE WHEN q2.documents >= {LEAST_DOCUMENTS} THEN q2.{c} WHEN q1.documents >= {LEAST_DOCUMENTS} THEN q1.{c} ELSE q0.{c} END"
    tests = []
    for r in RULES:
        v, reach = f"{r.top} * {r.scale} // greatest({r.bottom}, 1)", f"{REACH} * greatest(z - a, {r.least})"
        tests.append(f"(rule = '{r.name}' AND ({v} > z + {reach}" + (f" OR {v} < a - {reach}" if r.below else "") + "))")
    return f"""k AS (SELECT lang, source, rule, b, count(*) AS n FROM (SELECT lang, source, rule, CAST({shift} * {FINE} + (v >> {shift}) AS BIGINT) AS b FROM ({rows})) GROUP BY ALL),
{", ".join(levels)},
lim AS (SELECT q2.lang, q2.source, q2.rule, {pick("a")} AS a, {pick("z")} AS z FROM q2 JOIN q1 ON q2.lang IS NOT DISTINCT FROM q1.lang AND q2.rule = q1.rule JOIN q0 ON q2.rule = q0.rule),
bad AS (SELECT DISTINCT r FROM m JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source WHERE {" OR ".join(tests)})"""
