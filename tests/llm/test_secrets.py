"""Encoded keys in the url-safe alphabet and wrapped over lines."""

import base64
import random
import re
import time

from quantloom.llm import secrets


def key(seed, size=100):
    body = bytes([0x02, size]) + random.Random(seed).randbytes(size)
    return bytes([0x30, len(body)]) + body


def keys_of(text):
    return [text[a:b] for kind, a, b in secrets.find(text) if kind == "key"]


def test_url_safe_keys_whatever_stands_first():
    late = 0
    for seed in range(60):
        for encode in (base64.b64encode, base64.urlsafe_b64encode):
            k = encode(key(seed)).decode()
            late += min((k + "-").find("-"), (k + "_").find("_")) >= 40
            assert keys_of(f"x = '{k}'") == [k]
            assert keys_of(f"x = '{k.rstrip('=')}'") == [k.rstrip("=")]
    assert late > 60


def test_wrapped_keys():
    for size in (70, 100, 118):
        k = base64.b64encode(key(5, size)).decode()
        for w in (24, 64, 76):
            lines = "\n  ".join(k[i:i + w] for i in range(0, len(k), w))
            assert keys_of(f"some words\n  {lines}\nmore words here") == [lines]
            pem = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----"
            assert [s[0] for s in secrets.find(pem)] == ["pem"]


def test_long_texts_take_time_in_proportion():
    texts = [("M" + "A" * 63 + "\n") * 16_000, ("MIIEowIBAAKC" + "A" * 52 + "\n") * 16_000, "eyJ" * 340_000, "eyJa." * 200_000, ("b3BlbnNz" + "A" * 56 + "\n") * 16_000, "a" * 1_000_000]
    for text in texts:
        start = time.process_time()
        assert all(kind != "key" for kind, _, _ in secrets.find(text))
        assert time.process_time() - start < 20, text[:20]


def plain(text):
    """Base spans straight from the patterns of the contract, one character class at a time."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [("assign", *m.span())] if len(m[2]) >= 6 else []
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.BASE.index(s[0])))


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    parts = ["token", "SECRET", "api_key", "apikey", "password", "passwd", " ", "=", ":", "'", '"', "AKIA", "AKIA" + "Q7" * 9, "abc123", "deadbeef" * 3, "f0" * 11, "é", "ſecret", "K", "\n", "x=y", "A-Z_/+."]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 16)))
        assert [s for s in secrets.find(text) if s[0] in secrets.BASE] == plain(text), text
