"""Repair of conversations: the cheapest edits that turn the roles into an optional system turn and then user, assistant, user, assistant ...

Turns are aligned to each feasible length of the alternating string by Wagner-Fischer tables.  All lengths share one table, since their ends are
alike: its cell (i, r) is the cost of aligning the turns from i on to the last r roles.  An incumbent, the cost of one pass of plain
edits, bounds how many more turns may be deleted or inserted than the other, so only that band of the table is filled.  Lengths of equal cost are
traced back and their audits compared; the ASCII-least wins.

A conversation may hold any share of all rows.  So turns are ordered by a range partition, cut into segments of at most ``SEGMENT`` turns, and
each segment is aligned by itself, from every state of the alternation to every state; segments are then chained by their 4 x 4 costs, streamed from
the last to the first, and traced back in parallel.  No insertion stands at the end of a segment but the last, so no audit of a segment begins
another, and the chained audit is the ASCII-least of the whole.  Only writing out the repaired turns, in their order, reads a conversation
in one task, as a stream.

Rules.  Null role and null text are read as one space; a null conv_id is a conversation like any other; null turns come first.  Turns with the same number are
ordered by the first 32 characters of role and text and then by a digest of both; equal rows follow each other, all but the first being duplicates.  Whole
texts are read.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import spread, stage

SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: Turns aligned at a time, and bytes that the tables aligned together may take.
SEGMENT, TABLES = 512, 1 << 26
#: Rows handed on at a time.
ROWS = 2000
#: States: at the start, after system, after user, after assistant.  What they cost at the end of a conversation, and the insertions behind that.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FINAL, CLOSING = (0, 2 * INSERT, INSERT, 0), (b"", b"II", b"I", b"")
BIG = 1 << 29
FAR = 1 << 60
#: Role initials s, u, a as 1, 2, 3, other ones 0; a row's code adds 4 times its fault.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LEGAL = {(1, 2), (2, 3), (3, 2)}

ORDER = ("turn", "role_head", "text_head", "digest", "row_id")


# ------------------------------------------------------------------ alignment


class Alignment:
    """Banded tables of segments of equal length: ``codes`` is (segments, turns)."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        s, n = codes.shape
        initial, fault = codes & 3, codes >> 2
        self.must = (fault == BLANK) | (fault == DUPLICATE)
        cut = np.where(fault == TRUNCATED, CUT_SHORT, 0).astype(np.int32)
        self.match = np.stack([np.where(self.must, BIG, cut + np.where(initial == role, 0, REROLE)) for role in (1, 2, 3)]).astype(np.int32)
        self.match[0][initial != 1] = BIG  # no other turn becomes a system turn
        most = int(self.incumbent().max())
        self.down, up = min(most // DELETE, n), most // INSERT
        self.width = self.down + up + 1
        self.costs = self._fill(s, n)

    def incumbent(self) -> np.ndarray:
        """A cost that no pair of states exceeds: one pass without insertions, or deletion of all, and what any start and end adds."""
        s, n = self.codes.shape
        cost, want = np.zeros(s, np.int64), np.zeros(s, np.int64)
        for i in range(n):
            go = ~self.must[:, i]
            cost += np.where(go, self.match[1 + want, np.arange(s), i], DELETE)
            want = np.where(go, 1 - want, want)
        return np.minimum(cost + 3 * INSERT + REROLE, n * DELETE + 2 * INSERT)

    def _fill(self, s: int, n: int) -> np.ndarray:
        """costs[i, e, segment, k]: turns from i on against the last r = n - i + k - down roles of a string ending in user (e = 0) or assistant (e = 1).

        One more column, never reached, stands at the end.
        """
        w = self.width
        t = np.full((n + 1, 2, s, w + 1), BIG, np.int32)
        t[n, :, :, self.down] = 0
        steps = np.arange(w, dtype=np.int32) * INSERT
        for i in range(n - 1, -1, -1):
            r = n - i + np.arange(w) - self.down
            u, a = self.match[1][:, i, None], self.match[2][:, i, None]
            odd = (r % 2 == 1)[None, :]
            role = np.stack([np.where(odd, u, a), np.where(odd, a, u)])
            new = np.minimum(t[i + 1, :, :, 1:] + DELETE, np.where(r >= 1, t[i + 1, :, :, :w] + role, BIG))
            new = np.where(r >= 0, new, BIG)
            new = np.minimum.accumulate(new - steps, axis=2) + steps
            t[i, :, :, :w] = np.minimum(np.where(r >= 0, new, BIG), BIG)
        return t

    def lengths(self, i: int, e: int, state: int) -> np.ndarray:
        """Which cells of row ``i`` are lengths that lead from ``state`` to the end ``e``."""
        r = self.codes.shape[1] - i + np.arange(self.width) - self.down
        even = (e == 1) == (state != AFTER_U)
        return (r >= (1 if state in (START, AFTER_S) else 0)) & (r % 2 == (0 if even else 1))

    def candidates(self, state: int, after: np.ndarray):
        """(turns deleted before a kept system turn or -1, end state, cells or None, cost) of all ways through the segments, cost per segment and cell; ``after`` is (segments, 4)."""
        s, n = self.codes.shape
        heads = [(-1, np.zeros(s, np.int64))]
        if state == START:
            heads += [(k, np.where(own < BIG, DELETE * k + own.astype(np.int64), FAR)) for k, own in enumerate(self.match[0].T) if (own < BIG).any()]
        for k, head in heads:
            here = state if k < 0 else AFTER_S
            for e in (0, 1):
                cells = self.lengths(k + 1, e, here)
                cost = self.costs[k + 1, e, :, :self.width].astype(np.int64)
                yield k, AFTER_U + e, cells, np.where(cells[None, :] & (cost < BIG), cost + (head + after[:, AFTER_U + e])[:, None], FAR)
            if here in (START, AFTER_S):  # nothing but the head is left
                yield k, here, None, (head + DELETE * (n - k - 1) + after[:, here])[:, None]

    def matrix(self) -> np.ndarray:
        """(segments, state before, state after) costs, FAR where there is no way."""
        out = np.full((len(self.codes), 4, 4), FAR, np.int64)
        none = np.zeros((len(self.codes), 4), np.int64)
        for state in range(4):
            for _, end, _, cost in self.candidates(state, none):
                out[:, state, end] = np.minimum(out[:, state, end], cost.min(axis=1))
        return np.minimum(out, FAR)

    def trace(self, state: int, after: np.ndarray, last: np.ndarray, some: np.ndarray) -> list[tuple[int, bytes] | None]:
        """State after and audit, the ASCII-least of the cheapest, of each of the segments ``some``; the last of a conversation with what closes it."""
        found = list(self.candidates(state, after))
        best = np.min([cost.min(axis=1) for *_, cost in found], axis=0)
        n = self.codes.shape[1]
        result: list[tuple[int, bytes] | None] = [None] * len(self.codes)

        def offer(segment: int, end: int, audit: bytes) -> None:
            audit += CLOSING[end] if last[segment] else b""
            if result[segment] is None or audit < result[segment][1]:
                result[segment] = (end, audit)

        for k, end, cells, cost in found:
            tied = (cost == best[:, None]) & (some & (best < FAR))[:, None]
            if not tied.any():
                continue
            head = b"D" * k + b"K" if k >= 0 else b""
            if cells is None:
                for segment in np.flatnonzero(tied[:, 0]):
                    offer(int(segment), end, head + b"D" * (n - k - 1))
                continue
            segments, at = np.nonzero(tied)
            for segment, audit in zip(segments.tolist(), self._walk(k + 1, end - AFTER_U, segments, at)):
                offer(segment, end, head + audit)
        return result

    def _walk(self, i0: int, e: int, segment: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Cheapest edits from row ``i0`` and the given cells on, least letter first at every step, all side by side."""
        n = self.codes.shape[1]
        letters = np.zeros((len(at), n + self.width + 1), np.uint8)
        i, k, length = np.full(len(at), i0), at.copy(), np.zeros(len(at), int)
        going = np.arange(len(at)) if i0 < n else np.empty(0, int)
        while len(going):
            ii, kk, ss = i[going], k[going], segment[going]
            r = n - ii + kk - self.down
            now = self.costs[ii, e, ss, kk]
            is_u = (r % 2 == 1) == (e == 0)
            role = np.where(is_u, self.match[1][ss, ii], self.match[2][ss, ii])
            drop = self.costs[ii + 1, e, ss, kk + 1] + DELETE == now
            insert = ~drop & (r >= 1) & (self.costs[ii, e, ss, kk - 1] + INSERT == now)
            keep = (self.codes[ss, ii] & 3) == np.where(is_u, 2, 3)
            letters[going, length[going]] = np.where(drop, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R"))))
            if not (drop | insert | (self.costs[ii + 1, e, ss, kk] + role == now)).all():
                raise AssertionError("a cell of the table has no way on")
            length[going] += 1
            k[going] += np.where(drop, 1, np.where(insert, -1, 0))
            i[going] += ~insert
            going = going[i[going] < n]
        return [row[:m].tobytes() for row, m in zip(letters, length)]


def batched(codes: list[bytes]) -> Iterator[tuple[list[int], Alignment]]:
    """Alignments of segments of equal length and like incumbents, as many together as their tables allow."""
    lengths: dict[int, list[int]] = {}
    for j, c in enumerate(codes):
        lengths.setdefault(len(c), []).append(j)
    for n, which in lengths.items():
        most = n * DELETE + 2 * INSERT
        together = max(TABLES // (8 * (n + 1) * (most // DELETE + most // INSERT + 2)), 1)
        for at in range(0, len(which), together):
            some = which[at:at + together]
            yield some, Alignment(np.frombuffer(b"".join(codes[j] for j in some), np.uint8).reshape(len(some), n).astype(np.int32))


# ------------------------------------------------------------------ rows


def described(conversations: DataFrame) -> DataFrame:
    """Rows with what orders and judges them; ``row_id`` tells equal rows apart."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    row = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    ended = F.substring(bare, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    return row.select(
        "*", F.substring("role", 1, 32).alias("role_head"), F.substring("text", 1, 32).alias("text_head"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"), F.monotonically_increasing_id().alias("row_id"),
        F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0).alias("initial"),
        F.when(bare == "", BLANK).when(ended, 0).otherwise(TRUNCATED).alias("fault"))


def place() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row_id")


def judged(rows: DataFrame) -> DataFrame:
    """Order columns and code of each row.  Only texts that occur again are joined back, so the join is small unless most texts repeat."""
    again = rows.where(F.col("fault") != BLANK).groupBy("conv_id", "digest").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stage(again.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first"), "repeated-turns")
    row = rows.select("conv_id", *ORDER, "initial", "fault").join(again, (F.col("digest") == F.col("_digest")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNotNull() & (place() != F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    return row.select("conv_id", *ORDER, (F.col("initial") + 4 * fault).alias("code"))


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


class Segment:
    """Turns of one conversation while they are read: codes, turn numbers, what lies inside."""

    def __init__(self, conv, number: int):
        self.conv, self.number, self.codes = conv, number, bytearray()
        self.turns = self.illegal = 0
        self.first = self.last = None

    def add(self, turn, code: int) -> None:
        if self.codes:
            self.illegal += (self.codes[-1] & 3, code & 3) not in LEGAL
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.codes.append(code)


def cut(batches, schema: pa.Schema, segment: int):
    """Segments of the ordered rows of a task, with the costs between all states."""
    part, held, now = TaskContext.get().partitionId(), [], None

    def out():
        codes = [bytes(s.codes) for s in held]
        costs = [None] * len(held)
        for which, alignment in batched(codes):
            for j, m in zip(which, alignment.matrix()):
                costs[j] = m.ravel().tolist()
        faults = [[sum(c >> 2 == f for c in s.codes) for f in (BLANK, DUPLICATE, TRUNCATED)] for s in held]
        rows = [(s.conv, part, s.number, codes[j], costs[j], s.first, s.last, s.turns, *faults[j], s.illegal) for j, s in enumerate(held)]
        held.clear()
        return table_of(rows, schema)

    for batch in batches:
        for conv, turn, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code"))):
            if now is None or now.conv != conv or len(now.codes) >= segment:
                now = Segment(conv, now.number + 1 if now is not None and now.conv == conv else 0)
                held.append(now)
                if len(held) > ROWS:
                    held.pop()
                    yield out()
                    held.append(now)
            now.add(turn, code)
    if held:
        yield out()


def chain(batches, schema: pa.Schema):
    """Segments of each conversation from its last to its first: costs from each state to the end, and what lies between segments."""
    conv, known, ahead = None, False, None  # ahead: the segment after this one
    togo, rows, waiting = None, [], None
    for batch in batches:
        for s in batch.to_pylist():
            new = not known or s["conv_id"] != conv
            if waiting is not None:
                rows.append((*waiting, new))
            if new:
                conv, known, ahead, togo = s["conv_id"], True, None, list(FINAL)
            after, m = togo, s["costs"]
            togo = [min(FAR, min(m[4 * a + b] + after[b] for b in range(4))) for a in range(4)]
            illegal, turns = s["illegal"], s["turns"]
            if ahead is not None:
                illegal += (s["codes"][-1] & 3, ahead["codes"][0] & 3) not in LEGAL
                turns -= s["last"] is not None and s["last"] == ahead["first"]
            waiting = (s["conv_id"], s["part"], s["segment"], s["codes"], after, togo[START], s["first"], s["last"], turns, s["blank"], s["duplicate"], s["truncated"], illegal, ahead is None)
            ahead = s
            if len(rows) >= ROWS:
                yield table_of(rows, schema)
                rows = []
    if waiting is not None:
        rows.append((*waiting, True))
    if rows:
        yield table_of(rows, schema)


def trace(batches, schema: pa.Schema):
    """For each segment and state before it the state after it and the audit; a first segment has only one state before it."""
    for whole in batches:
        for batch in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
            segments = batch.to_pylist()
            found = [[None] * 4 for _ in segments]
            for which, alignment in batched([s["codes"] for s in segments]):
                after = np.array([segments[j]["after"] for j in which], np.int64)
                last, first = (np.array([segments[j][c] for j in which]) for c in ("is_last", "is_first"))
                for state in range(4):
                    some = np.ones(len(which), bool) if state == START else ~first
                    if some.any():
                        for j, piece in zip(which, alignment.trace(state, after, last, some)):
                            found[j][state] = piece
            rows = [(s["conv_id"], s["part"], s["segment"], [p and p[0] for p in f], [p and p[1].decode() for p in f], s["togo"], s["first"], s["last"], s["turns"], s["blank"],
                     s["duplicate"], s["truncated"], s["illegal"]) for s, f in zip(segments, found)]
            yield table_of(rows, schema)


ROLES = {AFTER_U: "user", AFTER_A: "assistant"}


def write(batches, schema: pa.Schema):
    """Per conversation a row of position 0 with its figures and audit, then its repaired turns in order."""
    rows, size = [], 0
    conv, known = None, False
    pieces: list[str] = []
    report = audit = None
    at = position = 0
    state = end = START

    def step(role: str, text: str):
        nonlocal position, size, state
        position += 1
        size += len(text)
        rows.append((conv, position, role, text, *[None] * 8))
        state = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[role[0]]

    def begin():
        """The figures are whole when the first turn comes, or the next conversation."""
        nonlocal audit
        audit = "".join(pieces)
        low, high = report["low"], report["high"]
        gaps = 0 if low is None else high - low + 1 - report["turns"]
        rows.append((conv, 0, None, None, gaps, report["blank"], report["duplicate"], report["truncated"], report["illegal"], report["cost"], audit, True))

    def inserted():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            step(ROLES[AFTER_A if state == AFTER_U else AFTER_U], "")
            at += 1

    for whole in batches:
        for batch in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
            for r in batch.to_pylist():
                if not known or r["conv_id"] != conv:
                    if known:
                        begin() if audit is None else None
                        inserted()
                    conv, known, pieces, audit, at, position, state, end = r["conv_id"], True, [], None, 0, 0, START, START
                    report = {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": r["togo"]}
                if r["kind"] == 0:
                    pieces.append(r["audits"][end])
                    end = r["ends"][end]
                    for c in ("turns", "blank", "duplicate", "truncated", "illegal"):
                        report[c] += r[c]
                    report["low"] = r["first"] if report["low"] is None else report["low"]
                    report["high"] = r["last"] if r["last"] is not None else report["high"]
                    continue
                if audit is None:
                    begin()
                inserted()
                letter = audit[at]
                at += 1
                if letter == "K":
                    step(r["role"], r["text"])
                elif letter == "R":
                    step(ROLES[AFTER_A if state == AFTER_U else AFTER_U], r["text"])
            if len(rows) >= ROWS or size > TABLES:
                yield table_of(rows, schema)
                rows, size = [], 0
    if known:
        begin() if audit is None else None
        inserted()
    if rows:
        yield table_of(rows, schema)


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Repaired conversations: position 1 .. with role and text of the turns, and a row of position 0 per conversation with its figures and audit, before its turns.

    Rows of a conversation follow each other, in order, within a partition.
    """
    conv = conversations.schema["conv_id"].dataType.simpleString()
    spark = conversations.sparkSession

    def schema(text: str) -> tuple[StructType, pa.Schema]:
        made = spark.createDataFrame([], f"conv_id {conv}, {text}").schema
        return made, to_arrow_schema(made)

    sums = "first long, last long, turns long, blank long, duplicate long, truncated long, illegal long"
    rows = stage(described(conversations), "turns")
    ordered = judged(rows).repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    made, arrow = schema(f"part int, segment int, codes binary, costs array<long>, {sums}")
    segments = stage(ordered.select("conv_id", "turn", "code").mapInArrow(partial(cut, schema=arrow, segment=segment), made), "turn-segments")
    made, arrow = schema(f"part int, segment int, codes binary, after array<long>, togo long, {sums}, is_last boolean, is_first boolean")
    falling = segments.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("segment"))
    chained = stage(falling.mapInArrow(partial(chain, schema=arrow), made), "chained-segments")
    made, arrow = schema(f"part int, segment int, ends array<int>, audits array<string>, togo long, {sums}")
    pieces = spread(chained, "conv_id", "part", "segment").mapInArrow(partial(trace, schema=arrow), made)
    both = pieces.withColumn("kind", F.lit(0)).unionByName(rows.select("conv_id", *ORDER, "role", "text").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    together = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "segment", *ORDER)
    made, arrow = schema("position long, role string, text string, " + ", ".join(f"{c} long" for c in FIGURES) + ", audit string, is_report boolean")
    kept = ("conv_id", "kind", "role", "text", "ends", "audits", "togo", "first", "last", "turns", "blank", "duplicate", "truncated", "illegal")
    return together.select(*kept).mapInArrow(partial(write, schema=arrow), made)


def digest(batches, schema: pa.Schema):
    """One row per conversation: its figures, audit and the digest of its repaired turns."""
    report, sha, rows = None, None, []

    def done():
        rows.append((*report, sha.hexdigest()))

    for batch in batches:
        names = ("conv_id", *FIGURES, "audit")
        for position, role, text, *figures in zip(*(batch.column(c).to_pylist() for c in ("position", "role", "text", *names))):
            if position == 0:
                if report is not None:
                    done()
                report, sha = figures, hashlib.sha256()
            else:
                sha.update(f"{'' if position == 1 else '\n'}{role}:{text}".encode())
        if len(rows) >= ROWS:
            yield table_of(rows, schema)
            rows = []
    if report is not None:
        done()
    if rows:
        yield table_of(rows, schema)


def audited(repaired: DataFrame) -> DataFrame:
    """conv_id, figures, audit and repaired_sha256 of each repaired conversation, without a shuffle."""
    conv = repaired.schema["conv_id"].dataType.simpleString()
    made = repaired.sparkSession.createDataFrame([], f"conv_id {conv}, " + ", ".join(f"{c} long" for c in FIGURES) + ", audit string, repaired_sha256 string").schema
    return repaired.mapInArrow(partial(digest, schema=to_arrow_schema(made)), made)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults that a row's conv_id and turn decide: one row in twenty each dropped, emptied, without sentence ends, repeated, made a user's."""
    space = F.lit(" ")
    drawn = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    row = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), drawn.alias("_drawn")).where("_drawn <> 0")
    text = F.when(F.col("_drawn") == 1, F.lit("")).when(F.col("_drawn") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("_drawn") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_time")
    return row.select("conv_id", "turn", F.when(F.col("_drawn") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), times).drop("_time")


def report(conversations: DataFrame, rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The audit of every conv_id of ``conversations`` whose rows are now ``rows``; zeros, an empty audit and the digest of nothing where none is left."""
    found = audited(repair(rows, segment)).withColumnRenamed("conv_id", "_conv")
    joined = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in FIGURES], F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
