"""Personal data spans against plain patterns in Python, on made-up tricky texts."""

import random
import re

from pyspark.sql import functions as F

from quantloom.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def iban(v):
    v = v.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(re.sub("[ -]", "", v)) <= 19 and luhn(re.sub("[ -]", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
    "iban": (r"(?a:\b)(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?a:\b)", iban),
}


def brute(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text or "") if ok(m[0])]


def texts():
    rng = random.Random(5)
    bits = ["a@b.c", "a.b%", "@", "x-y.z", "é", "😀", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "0255.1.01.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "0000000000000000000",
            "+1 (017) 555-7713", "+", "++44 20 7946 0958", "12", " ", "\n", "-", "_", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "XX00ABCDEFGHIJKLMN", "card: ", "call "]
    out = [None, "", "a" * 5000, "1" * 30_000, "1.2.3.4 " * 3000, "a@" * 500 + "b.c", "+1" * 400]
    return out + ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(400)]


def test_spans_match_plain_patterns(spark):
    rows = [(i if i % 9 else None, t, "x", "y") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, kind string")
    got = [r["found"] for r in pii.scan(docs).coalesce(1).collect()]
    assert sorted([(s["kind"], s["start"], s["end"]) for s in r] for r in got) == sorted(brute(t) for t in texts())
    assert pii.scan(docs.limit(0)).count() == 0


def test_context_and_redaction(spark):
    df = spark.createDataFrame([("My card: 4111 1111 1111 1111, é a@b.co!",), ("4111111111111111",), ("no",), (None,), ("+4111 1111 1111 111",)], "text string")
    rows = df.select(pii.find(F.col("text")).alias("f"), pii.redact(F.col("text"), pii.find(F.col("text"))).alias("r")).collect()
    assert [[round(s["score"], 2) for s in r["f"]] for r in rows[:2]] == [[0.7, 1.0], [0.7]]
    assert [r["r"] for r in rows[:4]] == ["My card: [card], é [email]!", "[card]", "no", None]
