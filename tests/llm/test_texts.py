"""Mixing, language and secret operators on small tables with nulls, ties, repeats and extra columns."""

import base64
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from quantloom.llm import language, mixing, secrets

DOCS = "doc_id long, text string, lang string, source string, size string, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def test_mix_follows_brute_force(spark):
    rows = [(i, "w " * (i % 7), None, [None, "a", "b", "é"][i % 4]) for i in range(200)] + [(None, "w w", None, "a"), (3, "w w w", None, "é"), (3, "w w w", None, "é"), (900, None, None, "b")]
    docs = frame(spark, rows).select("doc_id", "source", F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("long").alias("size"), F.lit(1.0).alias("weight"), F.lit("z").alias("taken"))
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("source", dropna=False)["size"].sum()
    order = sorted(x for x in sizes.index if isinstance(x, str)) + [None]
    size = [float(sizes[sizes.index.isna()].iloc[0]) if x is None else float(sizes[x]) for x in order]
    weight = [5, 2, 1, 5]
    target, capped = [0.0] * 4, set()
    while True:
        left = 1.5 * sum(size) - sum(2 * size[i] for i in capped)
        w = sum(weight[i] for i in range(4) if i not in capped)
        target = [2 * size[i] if i in capped else left * weight[i] / w for i in range(4)]
        over = {i for i in range(4) if target[i] > 2 * size[i]}
        if not over:
            break
        capped |= over
    for name, t in zip(order, target):
        part = got[got["source"].isna()] if name is None else got[got["source"] == name]
        assert part["target"].iloc[0] == pytest.approx(t)
        assert part["taken"].sum() == int(t + 0.5)
        assert (part["taken"] <= 2 * part["size"]).all() and (part["taken"] >= part["epochs"] * part["size"]).all()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_language_of_small_tables(spark):
    en, de = "the house and the tree are here with the bird", "der baum und das haus sind hier mit dem vogel"
    rows = [(i, [en, de][i % 2] + " x" * (i % 5), ["en", "de"][i % 2], None) for i in range(60)] + [(101, None, "en", None), (102, "", "de", None), (103, "12 !", None, None), (None, de, None, None), (5, en, None, None), (5, en, None, None)]
    got = language.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (_, text, _, _) in zip(got, rows):
        assert r["lang_pred"] == ("und" if not text or not re.search("[a-z]", text) else "en" if text.startswith("the") else "de")
        assert 0 <= r["score"] <= 1
    assert language.identify(frame(spark, rows).limit(0)).count() == 0
    nothing = frame(spark, [(1, en, None, None)])
    assert [r["lang_pred"] for r in language.identify(nothing).collect()] == ["und"]


def test_pieces_of_long_texts_cover_everything(monkeypatch):
    text = "abc déf " * 50
    whole = sum(len(g) for g in language.trigrams(text))
    monkeypatch.setattr(language, "PIECE", 64)
    assert abs(sum(len(g) for g in language.trigrams(text)) - whole) < 60


def der(*items: bytes, tag: int = 0x30) -> bytes:
    body = b"".join(items)
    return bytes([tag, 0x82]) + len(body).to_bytes(2, "big") + body


def test_secrets(spark):
    number = b"\x02\x20" + bytes(range(32))
    good = base64.b64encode(der(b"\x02\x01\x00", der(number), number)).decode()
    bad = base64.b64encode(der(b"\x02\x01\x00", der(number), number)[:-3]).decode()
    token = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": "1"})) + ".c2ln"
    texts = [
        None, "", 'é😀 Token = "0123456789abcdef0123456789" x', "password: abc", "AKIA" + "A" * 16 + " AKIASHORT",
        f"see {good} now", f"see {bad} now", f"jwt {token}", f"-----BEGIN PRIVATE KEY-----\n{good}\n-----END PRIVATE KEY-----", "toKen=secret=aaaaaaaa secret=bbbbbb",
    ]
    got = secrets.scan(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "x", None, None)])).collect()
    assert [r["spans"] for r in got[:5]] == ["", "", "assign:3:38,hex:12:38", "", "access:0:20"]
    assert got[2]["base_sha256"] == hashlib.sha256(b"assign:3:38,hex:12:38").hexdigest()
    assert got[5]["spans"] == f"key:4:{4 + len(good)}" and got[6]["spans"] == ""
    assert got[7]["spans"] == f"jwt:4:{4 + len(token)}"
    assert got[8]["spans"].startswith("pem:0:") and got[8]["n_confirmed"] == 2
    assert got[9]["n_assign"] == 2
    assert secrets.scan(frame(spark, []).limit(0)).count() == 0
