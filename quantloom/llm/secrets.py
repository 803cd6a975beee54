"""Secret scans: plain patterns propose spans, structure confirms encoded keys and signed tokens.

Base64 and hex candidates are decoded and reported only if their inside is well formed: a key
encoding whose nested lengths fill each other exactly, a length-prefixed private key file, or a
signed token whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame

from .common import add_columns

#: Kinds in listing order; the first three are the base kinds.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem", "key")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A longest run of token characters and single dots; taken whole, so no character is looked at twice.
DOTTED = re.compile(r"[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)*+")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----([A-Za-z0-9+/=\s\\]+)-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
#: Candidates over both base64 alphabets and over each, all on their longest runs.
ENCODED = tuple(re.compile(x + r"{40,}={0,2}") for x in (r"[A-Za-z0-9+/_-]", r"[A-Za-z0-9+/]", r"[A-Za-z0-9_-]"))
#: Consecutive lines of base64 alone, and one such line.
WRAPPED = re.compile(r"(?:^[ \t]*[A-Za-z0-9+/_-]{16,}={0,2}[ \t\r]*(?:\n|\Z)){1,}(?:^[ \t]*[A-Za-z0-9+/_-]+={0,2}[ \t\r]*$)?", re.M)
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
HEXED = re.compile(r"(?:[0-9A-F]{2}){30,}|(?:[0-9a-f]{2}){30,}")
MARKS = ("passw", "secret", "token", "api")
LONG = 24


def decoded(text: str) -> bytes | None:
    """Bytes of a base64 text in either alphabet, padded or not."""
    body = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the tag-length-value items that fill data[at:end] exactly."""
    found = []
    while at < end:
        if end - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            size, at = int.from_bytes(data[at:at + k], "big"), at + k
        if at + size > end:
            return None
        found.append((tag, at, at + size))
        at += size
    return found


def is_key(data: bytes | None) -> bool:
    """One sequence that fills the data, whose nested sequences are well formed too, holding a number or an object id."""
    if not data or len(data) < 30 or data[0] != 0x30:
        return False
    todo, tags, first = [(0, len(data))], set(), True
    while todo:
        found = elements(data, *todo.pop())
        if found is None or first and len(found) != 1:
            return False
        first = False
        tags.update(tag for tag, _, _ in found)
        todo.extend((a, b) for tag, a, b in found if tag in (0x30, 0x31))
    return 0x02 in tags or 0x06 in tags


def is_key_file(data: bytes | None) -> bool:
    """The length-prefixed private key format: magic, then cipher, derivation and options strings."""
    magic = b"openssh-key-v1\0"
    if not data or not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        at += 4 + size
    return at + 4 <= len(data) and int.from_bytes(data[at:at + 4], "big") >= 1


def sequence_size(text: str, at: int) -> int | None:
    """Bytes of the outer sequence whose base64 begins at ``at``, its head included."""
    head = decoded(text[at:at + 8])
    if not head or len(head) < 6 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    return None if k > 4 else 2 + k + (int.from_bytes(head[2:2 + k], "big") if k else head[1])


def wrapped(text: str) -> list[tuple[int, int]]:
    """Spans of keys in base64 that is wrapped over lines of one width and a last one that may be shorter.

    A sequence names its size, so only the lines that it fills are decoded; a key file ends with its run of lines, and a run is tried for one only at its first
    line with the magic.
    """
    spans = []
    for run in WRAPPED.finditer(text):
        lines = [m.span() for m in LINE.finditer(text, *run.span())]
        widths = [b - a for a, b in lines]
        until = [0] * len(lines)  # the end of the stretch of equally wide lines from here on
        for k in range(len(lines) - 1, -1, -1):
            until[k] = until[k + 1] if k + 1 < len(lines) and widths[k + 1] == widths[k] else k + 1
        at, tried = 0, -1
        while at < len(lines):
            end, width = at + 1, widths[at]
            lasts: tuple[int, ...] = ()
            if text[lines[at][0]] == "M":
                size = sequence_size(text, lines[at][0])
                whole = None if size is None else -(-(-(-size // 3) * 4) // width)  # lines, with padding
                lasts = () if whole is None else tuple(at + k for k in (whole, whole - 1) if k > 1)
            elif text.startswith("b3BlbnNz", lines[at][0]) and tried != until[at]:
                tried = until[at]
                lasts = (until[at] + 1, until[at])
            for last in lasts:
                if at + 1 < last <= len(lines) and last - 1 <= until[at]:
                    body = decoded("".join(text[a:b] for a, b in lines[at:last]))
                    if is_key(body) or is_key_file(body):
                        spans.append((lines[at][0], lines[last - 1][1]))
                        end = last
                        break
            at = end
    return spans


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of signed tokens: in a dotted run, the first part with the mark of an encoded object and the two after it, from left to right."""
    spans = []
    for run in DOTTED.finditer(text):
        if "eyJ" not in run[0]:
            continue
        parts, start, k = run[0].split("."), run.start(), 0
        while k + 2 < len(parts):
            at = parts[k].find("eyJ")
            if 0 <= at < len(parts[k]) - 3:
                length = len(parts[k]) + len(parts[k + 1]) + len(parts[k + 2]) + 2
                if is_signed_token(text[start + at:start + length]):
                    spans.append((start + at, start + length))
                step = 3
            else:
                step = 1
            start += sum(len(p) + 1 for p in parts[k:k + step])
            k += step
    return spans


def is_signed_token(text: str) -> bool:
    try:
        head, body = (json.loads(decoded(x) or b"") for x in text.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start and then kind."""
    if not text:
        return []
    spans = []
    low = text.lower()
    if any(x in low for x in MARKS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if max(map(len, text.split()), default=0) >= LONG:
        spans += [("hex", *m.span()) for m in HEX.finditer(text)]
        spans += [("key", *m.span()) for x in ENCODED for m in x.finditer(text) if is_key(decoded(m[0])) or is_key_file(decoded(m[0]))]
        spans += [("key", *m.span()) for m in HEXED.finditer(text) if is_key(bytes.fromhex(m[0]))]
    if "eyJ" in text:
        spans += [("jwt", a, b) for a, b in tokens(text)]
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            body = decoded(re.sub(r"\\[nr]|[\s\\]", "", m[1]))
            if is_key(body) or is_key_file(body):
                spans.append(("pem", *m.span()))
    if "\n" in text:
        pems = [s for s in spans if s[0] == "pem"]
        spans += [("key", a, b) for a, b in wrapped(text) if not any(s <= a and b <= e for _, s, e in pems)]
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame) -> DataFrame:
    """Secret spans of every document (doc_id, text); one row each.

    Null and empty texts have no spans: counts 0, ``spans`` empty, ``base_sha256`` the digest of the
    empty string.  Null doc_ids and repeated rows pass through one by one; other columns are ignored;
    an empty table gives an empty result.  Spans of different kinds may overlap; all are listed.
    Whole texts are read, in time that grows with their length.
    """

    def row(text: str | None) -> tuple:
        spans = find(text)
        kinds = [k for k, _, _ in spans]
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE)
        counts = [kinds.count(k) for k in BASE]
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        return (*counts, hashlib.sha256(base.encode()).hexdigest(), listed, len(spans) - sum(counts))

    added = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return add_columns(docs.select("doc_id", "text"), "text", row, added)
