"""Counts by brute force, limits and verdicts against the checking SQL, junk and clean documents."""

import random
import re

import duckdb
import pandas as pd
import pytest

from quantloom.llm import quality
from quantloom.llm.catalog import ORACLES

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[p:p + 8]) for p in range(len(words) - 7)]
    covered = {k for p, w in enumerate(windows) if windows.count(w) > 1 for k in range(p, p + 8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(len(w) for w in words), len(re.findall(r"[#*$%&|<>]", text)), len(lines), sum(line in lines[:k] for k, line in enumerate(lines)), len(covered)


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b", "a " * 8, "a " * 9, "a b c d e f g h " * 2, "x\n\nx\n x\nx", "é #| <>", "a b c d e f g h i a b c d e f g h j", "\x0b\x0c\r\x1f"])
def test_counts_of_odd_texts(text):
    assert quality.count(text) == brute(text)


def test_counts_of_random_texts():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices(["a ", "b ", "c\n", "#", " é", "\x0b"], k=rng.randint(0, 120)))
        assert quality.count(text) == brute(text)
    long = prose(rng, 200_000) + " " + prose(random.Random(2), 10) + " " + prose(random.Random(2), 10)
    assert quality.count(long)[5] == 20


def made_up():
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(30, 80)), ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 7 % 4], "z", 1) for i in range(600)]
    rows += [(i, prose(rng, 50) + " ###" * 20, "en", "a", None, 0) for i in range(1000, 1006)]
    rows += [(i, "\n".join(line for _ in range(8) for line in (prose(rng, 7), "same line here")), "de", "b", None, 0) for i in range(1100, 1103)]
    rows += [(i, prose(rng, 50, "xyz" * 30).replace(" ", "qqqqqqqq "), "en", "b", None, 0) for i in range(1200, 1203)]
    same = prose(rng, 10)
    rows += [(1300, prose(rng, 60) + f" {same}  {same}", None, "a", None, 0), (1301, f"{same} " * 6, "de", "a", None, 0), (None, None, None, None, None, None), (1302, "", "fr", "n", None, 0)]
    return rows + rows[:3]


def verdicts(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    con.execute("CREATE TABLE t AS SELECT doc_id, text, nullif(lang, 'NaN') AS lang, source FROM documents")
    con.unregister("documents")
    con.execute("ALTER TABLE t RENAME TO documents")
    return con.execute(ORACLES["op12_quality_rules"]).fetchall()


def test_verdicts_match_sql(spark):
    rows = made_up()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = quality.judge(docs.repartition(7))
    got = [tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(verdicts(rows), key=key)
    failed = {r["doc_id"]: r["failed"] for r in out.collect()}
    clean = [r["kept"] for r in out.collect() if r["doc_id"] is not None and r["doc_id"] < 600]
    assert all(clean) and len(clean) == 603
    assert all("symbols" in failed[i] for i in range(1000, 1006)) and all("lines" in failed[i] for i in range(1100, 1103))
    assert all("length" in failed[i] for i in range(1200, 1203)) and failed[1300] == ["repeats"]
    base = {r["doc_id"] for r in out.where("base_failed").collect()}
    assert base == {1301, None, 1302}
    assert quality.judge(docs.limit(0)).count() == 0


def test_sketches_merge_and_bound_the_error(spark):
    values = [0, 1, 63, 64, 127, 128, 129, 255, 256, 1000, 12345, 10**9, 10**12]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    rows = df.select("v", quality.bucket(df.v).alias("b")).withColumn("low", quality.least_of(quality.F.col("b"))).collect()
    for r in rows:
        assert r["low"] <= r["v"] <= r["low"] * (1 + 1 / 64) + 1e-9
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)
    docs = spark.createDataFrame(made_up(), SCHEMA)
    counted = quality.measure(docs)
    parts = [quality.sketch(counted.where(f"coalesce(doc_id, 0) % 2 = {k}")) for k in (0, 1)]
    whole = sorted(map(str, quality.quartiles(quality.sketch(counted), "lang").collect()))
    assert sorted(map(str, quality.quartiles(parts[0].union(parts[1]), "lang").collect())) == whole
