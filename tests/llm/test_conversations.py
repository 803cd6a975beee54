"""Repair against an automaton that keeps the least (cost, audit) per state, row by row."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quantloom.llm import conversations
from quantloom.llm.catalog import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, position string, cost int"
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def automaton(rows, marks, start=0, final=(0, None, None, 0)):
    """Least (cost, audit) by states 0 start, 1 after s, 2 after u, 3 after a."""
    best = {start: (0, "")}

    def insertions(best):
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                to = 3 if state == 2 else 2
                best[to] = min(best.get(to, (10**9, "")), (cost + 3, audit + "I"))

    for (role, _), mark in zip(rows, marks):
        insertions(best)
        nxt = {}

        def offer(state, value):
            nxt[state] = min(nxt.get(state, (10**9, "")), value)  # noqa: B023

        for state, (cost, audit) in best.items():
            offer(state, (cost + 4, audit + "D"))
            if mark not in ("blank", "duplicate"):
                extra = 3 * (mark == "truncated")
                want, to = ("a", 3) if state == 2 else ("u", 2)
                same = role[:1] == want
                offer(to, (cost + extra + (0 if same else 3), audit + ("K" if same else "R")))
                if state == 0 and role[:1] == "s":
                    offer(1, (cost + extra, audit + "K"))
        best = nxt
    insertions(best)
    return min(best[s] for s in (0, 3) if s in best)


def brute(rows):
    """(conv_id, turn, role, text) after damage -> {conv_id: contract columns}."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:32], r[2][:32], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        turns = [t for t, _, _ in own if t is not None]
        said = [(r, x) for _, r, x in own]
        marks = faults(said)
        cost, audit = automaton(said, marks)
        fixed, k = [], 0
        for letter in audit:
            kept = [] if letter == "I" else [said[k]]
            k += letter != "I"
            if letter != "D":
                role = kept[0][0] if letter == "K" else "assistant" if fixed and fixed[-1][0][0] == "u" else "user"
                fixed.append((role, kept[0][1] if kept else ""))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest())
    return out


def damage(rows):
    out = []
    for c, t, r, x in rows:
        drawn = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if drawn == 1 else x.translate({ord(k): None for k in ".!?"}) if drawn == 2 else x
        out += [(c, t, "user" if drawn == 4 else r, x)] * (0 if drawn == 0 else 2 if drawn == 3 else 1)
    return out


def made_up(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ["user", "assistant"][t % 2] if t or rng.random() < 0.5 else "system"
            role = rng.choice(["system", "tool", "", None, "Users", "usher"]) if rng.random() < 0.1 else role
            text = rng.choice(["Yes.", "no", " ", "Fine!  ", "é?\n", None, "", "..", f"Say {rng.random()}.", "cut"]) if rng.random() < 0.5 else f"Word {rng.random()}."
            rows.append((c, rng.choice([None, t, t + 3, t]), role, text))
    return rows


def table(got):
    return {r["conv_id"]: (*[r[c] for c in conversations.FIGURES], r["audit"], r["repaired_sha256"]) for r in got}


@pytest.mark.parametrize("segment", [512, 3, 1])
def test_matches_automaton(spark, segment):
    rng = random.Random(segment)
    rows = made_up(rng, 60, 14) + [(None, None, None, None), (None, 5, "user", "Hi."), (None, 5, "user", "Hi."), (900, 1, "system", "Be brief."), (901, 1, "assistant", "Only."), (902, None, "s", "x.")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)
    out = conversations.audited(conversations.repair(df.repartition(6), segment))
    assert table(out.collect()) == brute(rows)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(9)
    rows = [(1, t, r, x) for _, t, r, x in made_up(rng, 90, 30)] + made_up(rng, 5, 8)[:20]
    rows = [r if r[0] == 1 else (r[0] + 10, *r[1:]) for r in rows]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)
    assert table(conversations.audited(conversations.repair(df.repartition(8), 64)).collect()) == brute(rows)


def test_turns_damage_and_empty_tables(spark):
    rng = random.Random(4)
    rows = made_up(rng, 80, 9) + [(5000, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)
    harmed = damage(rows)
    got = sorted(tuple(r) for r in conversations.damaged(df).collect() if r["turn"] is not None)
    assert got == sorted(r for r in harmed if r[1] is not None)
    want = brute(harmed)
    for c in {r[0] for r in rows} - set(want):
        want[c] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert table(conversations.report(df, conversations.damaged(df)).collect()) == want
    nothing = df.limit(0)
    assert conversations.report(nothing, nothing).collect() == [] and conversations.repair(nothing).collect() == []
    gone = conversations.report(df, nothing).collect()
    assert len(gone) == 81 and {r["audit"] for r in gone} == {""}
    turns = [r for r in conversations.repair(df).collect() if r["position"]]
    for c in {r["conv_id"] for r in turns}:
        own = sorted((r["position"], r["role"]) for r in turns if r["conv_id"] == c)
        roles = [r for _, r in own]
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert [r[0] for r in roles[roles[0][0] == "s":]] == ["u", "a"] * ((len(roles) - (roles[0][0] == "s")) // 2) and roles != ["system"]


def test_band_holds_every_cheapest_way():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 20):
        codes = rng.integers(0, 16, size=(50, n)).astype(np.int32)
        narrow = conversations.Alignment(codes)
        wide = conversations.Alignment.__new__(conversations.Alignment)
        wide.codes, wide.must, wide.match, wide.down, wide.width = codes, narrow.must, narrow.match, n, 4 * n + 8
        wide.costs = wide._fill(*codes.shape)
        assert (narrow.matrix() == wide.matrix()).all()
        after = rng.integers(0, 12, size=(50, 4)).astype(np.int64)
        for state in range(4):
            every = np.ones(50, bool)
            assert narrow.trace(state, after, ~every, every) == wide.trace(state, after, ~every, every)


def test_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(damage(rows))
    for c in {r[0] for r in rows} - set(want):
        want[c] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert table(QUERIES["op11_conversation_repair"](spark, sf).collect()) == want
