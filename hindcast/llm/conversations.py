"""Repair of conversation structure by the cheapest edits, decided by one minimum over integers.

The rows of a conversation, by turn, become ``(system? (user assistant)+)?`` by keeping
(0), re-roling (3) or deleting (4) rows and inserting empty ones (3); a truncated row
that stays costs 3 more.  Among the cheapest repairs the one whose letters (K, R, D, I)
come first in ASCII order wins.

A path through the DAG of (row, grammar state) is one integer: its cost in the high
digits, its letters in fixed-width positional digits below, padded with zeros at the end,
so that the smaller integer is the better path and no other comparison is needed.  Every
step ends in the letter of a row; all paths to one node have as many such letters, so none
is a proper prefix of another, and the minimum at a node holds whatever follows.
After ``LOT`` rows the letters of the few live paths are set aside and one digit, their
rank, stands for them: integers keep their length in conversations of any length.

One exchange by conversation brings the rows together; Spark sorts and counts repeats, and a
task reads its rows as a stream with one lot of rows in memory.  A digest of a whole
conversation is sequential by nature, so a conversation is read by one task, however long.

Defined cases: null role, text, or (in the damage key) conv_id or turn count as one space;
rows of a null conv_id are one conversation; rows of equal turn go by role, then text; roles
that do not start with s, u or a cannot be kept; repeated rows are repeated turns; gaps beyond
a long are its largest value.  Columns other than the four are ignored, empty tables give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOT = 32
KEEP, REROLE, DELETE, INSERT, LATE = 0, 3, 4, 3, 3
#: Digits of the letters, in ASCII order; 0 pads the end.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {d: x for x, d in DIGIT.items()}
BITS = 3
#: Grammar states: nothing yet, after system, after user, after assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ENDS = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
GAP = "\x20\x09\x0a\x0b\x0c\x0d"
_INSERTED = ("", "u", "a", "ua", "au")
_WIDE = BITS * 3 * LOT + BITS * 2
_HIGH = _WIDE + BITS
#: Kinds of rows: must go; or initial (s, u, a, other), complete or truncated.
GONE = 8
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _walk(state: int | None, roles: str) -> int | None:
    for x in roles:
        state = NEXT.get((state, x))
    return state


def _moves(state: int, kind: int) -> list[tuple[int, int, int, int]]:
    """Cheapest ways over one row: target state, cost, digits and their number; inserts come before the row."""
    best: dict[int, tuple[int, str]] = {}
    initial, late = "sua-"[kind % 4], kind // 4
    for put in _INSERTED:
        at = _walk(state, put)
        if at is None:
            continue
        edits = [("D", at, DELETE)]
        if kind != GONE:
            edits.append(("K", NEXT.get((at, initial)), KEEP + LATE * late))
            edits += [("R", NEXT.get((at, x)), REROLE + LATE * late) for x in "ua"]
        for letter, to, cost in edits:
            if to is not None:
                way = (cost + INSERT * len(put), "I" * len(put) + letter)
                best[to] = min(best.get(to, way), way)
    return [(to, cost, _digits(letters), len(letters)) for to, (cost, letters) in sorted(best.items())]


def _digits(letters: str) -> int:
    out = 0
    for x in letters:
        out = out << BITS | DIGIT[x]
    return out


MOVES = [[_moves(state, kind) for kind in range(GONE + 1)] for state in range(4)]
CLOSING = [(state, INSERT * len(put), _digits("I" * len(put)), len(put)) for state in range(4) for put in _INSERTED if _walk(state, put) in ENDS]


def _edited(state: int, letters: str, rows: list[tuple[int, str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of what the letters leave of the rows, starting in a grammar state."""
    at = iter(rows)
    for letter in letters:
        _, role, text = next(at) if letter != "I" else (0, "", "")
        if letter == "D":
            continue
        initial = role[:1] if letter == "K" else "a" if state == 2 else "u"
        state = NEXT[state, initial]
        yield letter, role if letter == "K" else ROLE[initial], text


class Repair:
    """The rows of one conversation, one after the other; the result at the end."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, str, str]] = []
        # State: cost, rank among the live paths, letters set aside, running digest.
        self.live: dict[int, tuple[int, int, tuple, object]] = {0: (0, 0, (), hashlib.sha256())}

    def add(self, kind: int, role: str, text: str) -> None:
        if len(self.rows) == LOT:
            self._set_aside()
        self.rows.append((kind, role, text))

    def _values(self) -> dict[int, tuple[int, int, int]]:
        """For each state the least integer, the number of its letters and the state in which the lot began."""
        values = {s: (cost << _HIGH | rank << _WIDE, 0, s) for s, (cost, rank, _, _) in self.live.items()}
        for kind, _, _ in self.rows:
            after: dict[int, tuple[int, int, int]] = {}
            for state, (value, n, began) in values.items():
                for to, cost, digits, k in MOVES[state][kind]:
                    now = value + (cost << _HIGH) + (digits << (_WIDE - BITS * (n + k)))
                    if to not in after or now < after[to][0]:
                        after[to] = (now, n + k, began)
            values = after
        return values

    def _path(self, value: int, n: int, began: int) -> tuple[tuple, object]:
        letters = "".join(LETTER[value >> (_WIDE - BITS * (i + 1)) & 7] for i in range(n))
        _, _, before, digest = self.live[began]
        digest, empty = digest.copy(), began == 0
        for _, role, text in _edited(began, letters, self.rows):
            digest.update(f"{'' if empty else '\n'}{role}:{text}".encode())
            empty = False
        return (before, letters), digest

    def _set_aside(self) -> None:
        values = self._values()
        ranks = {v: i for i, v in enumerate(sorted({v & ((1 << _HIGH) - 1) for v, _, _ in values.values()}))}
        self.live = {s: (v >> _HIGH, ranks[v & ((1 << _HIGH) - 1)], *self._path(v, n, began)) for s, (v, n, began) in values.items()}
        self.rows = []

    def end(self) -> tuple[int, str, str]:
        """Cost, letters and digest of the repaired conversation."""
        values = self._values()
        done = [(values[s][0] + (cost << _HIGH) + (digits << (_WIDE - BITS * (values[s][1] + k))), values[s][1] + k, values[s][2]) for s, cost, digits, k in CLOSING if s in values]
        best = min(done)
        pieces, digest = self._path(*best)
        letters = []
        while pieces:
            pieces, last = pieces
            letters.append(last)
        return best[0] >> _HIGH, "".join(reversed(letters)), digest.hexdigest()


class _Faults:
    """Counts over the rows of one conversation in order."""

    def __init__(self) -> None:
        self.counts = [0, 0, 0, 0]
        self.first = self.last = self.initial = None
        self.turns = 0
        self.repair = Repair()

    def add(self, turn: int | None, role: str, text: str, fault: int, kind: int) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if fault:
            self.counts[fault - 1] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts[3] += 1
        self.initial = initial
        self.repair.add(kind, role, text)

    def end(self) -> list:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        return [gaps, *self.counts, *self.repair.end()]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32 of ``conv_id:turn`` modulo 20; a dropped row stays with alive = false."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(how == 1, F.lit("")).when(how == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    slim = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), (how != 0).alias("alive"),
        F.when(how == 0, F.lit("")).when(how == 4, F.lit("user")).otherwise(space("role")).alias("role"),
        F.when(how == 0, F.lit("")).otherwise(text).alias("text"), F.when(how == 3, 2).otherwise(1).alias("times"),
    )
    return slim.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows of each conversation together and in order, with their first fault (0 none, 1 blank, 2 duplicate, 3 truncated) and kind."""
    if "alive" not in rows.columns:
        rows = rows.withColumn("alive", F.lit(True))
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "alive", role.alias("role"), text.alias("text"))
    # One exchange: the window asks for the conversation and more, so it is met by it.
    rows = rows.repartition("conv_id").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "alive", "role", "text").orderBy("turn")))
    end = F.rtrim(F.col("text"), F.lit(GAP))
    fault = F.when(end == "", 1).when(F.col("nth") > 1, 2).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    first = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.withColumn("fault", fault).withColumn("kind", F.when(F.col("fault").isin(1, 2), GONE).otherwise(first + F.when(F.col("fault") == 3, 4).otherwise(0)))
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text", "nth").drop("nth")


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    now, own, done = None, None, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    for part in batches:
        columns = [part.column(c).to_pylist() for c in ("conv_id", "turn", "alive", "role", "text", "fault", "kind")]
        for conv, turn, alive, role, text, fault, kind in zip(*columns):
            if own is None or conv != now:
                if own is not None:
                    done.append([now, *own.end()])
                now, own = conv, _Faults()
            if alive:
                own.add(turn, role, text, fault, kind)
        if done:
            yield batch()
            done = []
    if own is not None:
        done.append([now, *own.end()])
        yield batch()


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and letters of its repair, and the digest of the result.

    ``rows`` has conv_id, turn, role, text and perhaps alive; a conversation without live rows
    has zeros, no letters and the digest of nothing.
    """
    return ordered(rows).mapInArrow(_decided, f"conv_id long, {COUNTS}")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, at, letters, place = object(), 0, 0, "", 0
    for part in batches:
        done = []
        for conv, audit, role, text in zip(*[part.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")]):
            if audit is not None:
                now, state, at, letters, place = conv, 0, 0, audit, 0
                rows: list[tuple[int, str, str]] = []
            else:
                rows = [(0, role, text)]
            # Inserts before the row and the row's own letter; inserts at the end come with the last row.
            stop = at
            if rows:
                while letters[stop] == "I":
                    stop += 1
                stop += 1
                if not letters[stop:].strip("I"):
                    stop = len(letters)
            for letter, new_role, new_text in _edited(state, letters[at:stop], rows):
                state = NEXT[state, new_role[:1]]
                done.append((now, place, letter, new_role, new_text))
                place += 1
            at = stop
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "place", "edit", "role", "text"])


def repaired(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, place from 0, edit, role, text) under the letters that ``repair`` found."""
    own = ordered(rows).where("alive").select("conv_id", F.lit(1).alias("part"), "turn", F.lit(None).cast("string").alias("audit"), "role", "text", (F.col("kind") == GONE).alias("gone"))
    head = decided.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), "audit", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("gone"))
    both = head.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "text", "gone")
    return both.mapInArrow(_applied, "conv_id long, place long, edit string, role string, text string")
