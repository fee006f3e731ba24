"""Conversation structure repair by square-root checkpointed dynamic programming.

The rows of a conversation, ordered by turn (null first; rows of one turn by role, then by the
hash of the text), are edited at least cost until their role initials read `(s?(ua)+)?`. Keep
costs 0, Rerole to user or assistant 3, Delete 4 (the only edit for blank and duplicate rows),
Insert of an empty user or assistant row 3; a truncated row that is not deleted adds 3. Of the
cheapest edit strings the ASCII-least wins.

A row's first fault counts: blank (nothing but ASCII white space), duplicate (role and text
stand in an earlier row), truncated (its last character that is not white space is none of
`.!?`). Spark finds blanks, endings and first sightings of each text row by row; what a row
then is to the search fits in one byte. Each conversation streams through one task twice in one
sorted pass: first its bytes, from which the edits follow, then its texts, which the edits turn
into output as they pass. The search keeps state-cost vectors at every sqrt(n)-th row only,
walking backward, and computes each block's vectors again while it walks forward. So a
conversation costs two bytes a row of memory (its row byte and its edit), never its texts.

Null roles and texts count as one space. A null id is a conversation of its own; ids without
rows (see `ids`) give an empty repair. Repeated rows are duplicates; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from adledger.llm.common import arrow_map

BLANK = r"[^\x20\x09-\x0D]"
CUT_OFF = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
START, SYSTEM, USER, DONE = range(4)  # what the output ends in: nothing, s, u, a
INITIALS = "sua"  # row byte: initial (3: another) + 4 * condition (0 sound, 1 truncated, 2 to delete)
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (DONE, 1): USER, (USER, 2): DONE}
NEXT = (USER, USER, DONE, USER)  # the state after an output row of the role that is due
DUE = ("user", "user", "assistant", "user")


def _moves(row: int) -> list[list[tuple[int, int, int]]]:
    """Per state, the edits that consume a row: (letter, cost, next state)."""
    initial, condition = row % 4, row // 4
    extra = TRUNCATED if condition == 1 else 0
    out = []
    for state in range(4):
        edits = [(ord("D"), DELETE, state)]
        if condition < 2:
            if (state, initial) in KEPT:
                edits.append((ord("K"), KEEP + extra, KEPT[state, initial]))
            edits.append((ord("R"), REROLE + extra, NEXT[state]))
        out.append(edits)
    return out


MOVES = [_moves(row) for row in range(12)]


def _with_inserts(e0: float, e1: float, e2: float, e3: float) -> tuple:
    """State costs once rows may be inserted before the next one is read."""
    v2, v3 = min(e2, INSERT + e3), min(e3, INSERT + e2)
    return min(e0, INSERT + v2), min(e1, INSERT + v2), v2, v3


END = _with_inserts(0, inf, inf, 0)


def _before(row: int, after: tuple) -> tuple:
    return _with_inserts(*(min(cost + after[to] for _, cost, to in edits) for edits in MOVES[row]))


def cheapest_edits(rows: bytes | bytearray) -> tuple[int, bytearray]:
    """(cost, the ASCII-least of the cheapest edit strings) for row bytes."""
    n = len(rows)
    step = max(1, isqrt(n))
    marks, costs = {n: END}, END
    for i in range(n - 1, -1, -1):
        costs = _before(rows[i], costs)
        if i % step == 0:
            marks[i] = costs
    audit, state, total = bytearray(), START, costs[START]
    for begin in range(0, n, step):
        end = min(begin + step, n)
        block = [marks[end]]
        for i in range(end - 1, begin, -1):
            block.append(_before(rows[i], block[-1]))
        block.append(marks[begin])
        block.reverse()
        for i in range(begin, end):
            state = _walk(audit, state, block[i - begin], MOVES[rows[i]], block[i - begin + 1])
    _walk(audit, state, END, None, None)
    return total, audit


def _walk(audit: bytearray, state: int, here: tuple, moves: list | None, after: tuple | None) -> int:
    """Appends the least letters of tight edits until the row is consumed (or nothing is left to do)."""
    while True:
        tight = [(letter, to) for letter, cost, to in moves[state] if cost + after[to] == here[state]] if moves else []
        insert = INSERT + here[NEXT[state]] == here[state]
        if tight and (not insert or min(tight)[0] < ord("I")):
            letter, to = min(tight)
            audit.append(letter)
            return to
        if not insert:
            return state
        audit.append(ord("I"))
        state = NEXT[state]


def repaired(audit: bytes, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what stays or is put in, in order; rows are taken one by one as the edits ask."""
    state = START
    for letter in map(chr, audit):
        if letter == "I":
            yield letter, DUE[state], ""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            yield letter, role if letter == "K" else DUE[state], text
            if letter == "K":
                state = KEPT[state, INITIALS.find(role[:1])]
                continue
        state = NEXT[state]


@dataclass
class Report:
    """What one conversation's first pass finds."""
    key: object = None
    rows: bytearray = field(default_factory=bytearray)
    counts: list[int] = field(default_factory=lambda: [0, 0, 0])  # blank, duplicate, truncated
    illegal: int = 0
    turns: list = field(default_factory=lambda: [None, None, 0])  # least, greatest, distinct
    last: tuple | None = None
    edits: tuple[int, bytearray] | None = None

    def add(self, turn, role: str, digest: bytes, fault: int, first_turn, has_first: bool) -> None:
        same = (turn, role, digest)
        if fault != 1 and (self.last == same or (has_first and first_turn != turn)):
            fault = 2
        initial = INITIALS.find(role[:1]) if role else -1
        if self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if fault:
            self.counts[fault - 1] += 1
        self.rows.append((3 if initial < 0 else initial) + 4 * (0, 2, 2, 1)[fault])
        if turn is not None:
            if self.turns[1] != turn:
                self.turns[2] += 1
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2]]
        self.last = same

    def gaps(self) -> int:
        low, high, distinct = self.turns
        return 0 if low is None else high - low + 1 - distinct


def _stream(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Every conversation's head, row bytes and texts in this order, conversations dealt by id."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = df.select(F.col(id_col).alias("id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("body"),
                     F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"))
    blank = ~F.col("body").rlike(BLANK)
    fault = F.when(blank, 1).when(F.col("body").rlike(CUT_OFF), 3).otherwise(0)
    small = rows.select("id", "turn", "role", "digest", fault.alias("fault"))
    # where a text of a role stands more than once, the turn of its first row
    nulls_first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    again = (small.where("fault <> 1").groupBy("id", "role", "digest").agg(nulls_first.alias("first"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("id").alias("i"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    seen = small.join(again, F.col("id").eqNullSafe(F.col("i")) & (F.col("role") == F.col("r"))
                      & (F.col("digest") == F.col("d")), "left")
    none = {c: F.lit(None).cast(t) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("fault", "int"),
                                                ("first_turn", "long"), ("body", "string"))}
    cols = ["id", "step", *none, "again"]

    def shaped(part: DataFrame, step: int) -> DataFrame:
        have = part.columns
        return part.select(*[F.lit(step).alias(c) if c == "step" else F.col(c) if c in have
                             else F.lit(False).alias(c) if c == "again" else none[c].alias(c) for c in cols])

    heads = shaped(ids.select(F.col(id_col).alias("id")).distinct(), 0)
    bytes_of = shaped(seen.select("id", "turn", "role", "digest", "fault", F.col("first.turn").alias("first_turn"),
                                  F.col("first").isNotNull().alias("again")), 1)
    texts = shaped(rows.select("id", "turn", "role", "digest", "body"), 2)
    return (heads.unionByName(bytes_of).unionByName(texts).repartition("id")
            .sortWithinPartitions("id", "step", F.col("turn").asc_nulls_first(), "role", "digest"))


def _conversations(batches) -> Iterator[tuple[Report, Iterator[tuple[str, str]]]]:
    """Each conversation's finished report with an iterator over its rows, to be used before the next one."""
    def events():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))

    source = events()
    event = next(source, None)
    while event is not None:
        report = Report(event[0])
        while event is not None and event[0] == report.key and event[1] < 2:
            if event[1] == 1:
                _, _, turn, role, digest, fault, first, _, again = event
                report.add(turn, role, digest, fault, first, again)
            event = next(source, None)
        report.edits = cheapest_edits(report.rows)

        def rows(key=report.key):
            nonlocal event
            while event is not None and event[0] == key and event[1] == 2:
                yield event[3], event[7]
                event = next(source, None)

        left = rows()
        yield report, left
        for _ in left:
            pass


def _mapped(df: DataFrame, ids: DataFrame, id_col: str, rows_of, schema: str, rows_a_batch: int = 1000) -> DataFrame:
    """One output row per tuple of rows_of(report, rows), in batches of about 1 MB of text at most."""
    out_schema = StructType([StructField(id_col, df.schema[id_col].dataType), *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out_schema)

    def run(batches):
        out, size = [], 0
        for report, rows in _conversations(batches):
            for row in rows_of(report, rows):
                out.append((report.key, *row))
                size += sum(len(v) for v in row if isinstance(v, str))
                if len(out) >= rows_a_batch or size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return arrow_map(_stream(df, ids, id_col), run, out_schema)


def repair(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The repaired conversations: id, position (from 1), role, text, edit (K, R or I)."""
    def rows_of(report, rows):
        for position, (edit, role, text) in enumerate(repaired(report.edits[1], rows), 1):
            yield position, role, text, edit

    return _mapped(df, df, id_col, rows_of, "position long, role string, text string, edit string")


def audits(df: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation of df, and of `ids` where given: gaps, faults, cost, edits and the repaired text's hash."""
    def rows_of(report, rows):
        digest, between = hashlib.sha256(), ""
        for _, role, text in repaired(report.edits[1], rows):
            digest.update(f"{between}{role}:{text}".encode())
            between = "\n"
        cost, audit = report.edits
        yield report.gaps(), *report.counts, report.illegal, int(cost), audit.decode(), digest.hexdigest()

    return _mapped(df, df if ids is None else ids, id_col, rows_of,
                   "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                   "audit string, repaired_sha256 string")


def damaged(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Conversations with faults put in by the checksum of `id:turn`, for tests of a repair.

    Of each 20 checksums one drops the row, one empties its text, one takes out `.!?`, one
    repeats the row and one makes the role user. Nulls become one space first.
    """
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(spaced(id_col), F.lit(":"), spaced("turn"))) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(spaced("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (df.select(id_col, "turn", "role", "text", fate.alias("fate")).where("fate <> 0")
            .select(id_col, "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("times")).drop("times"))
