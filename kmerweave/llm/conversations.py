"""Repair of conversations' turn structure by iterative-deepening A* (operator 13)."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerweave.llm.common import table

SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

#: Costs of the edits, and of a truncated row that stays.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: White space, as the faults are defined.
SPACE = " \t\n\v\f\r"
LARGEST = (1 << 63) - 1

#: A conversation in good order is a system message or none, then pairs of user and assistant, or nothing at all. Where one stands:
#: at the start, after the system message, after a user, after an assistant; and where a user or assistant leads from there.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Kinds of rows: initial of the role, whether it must go, whether it is truncated.
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def keeps(initial: int, state: int) -> int | None:
    """The state to which a kept row of that initial leads, if it may stand there."""
    if initial == SYSTEM:
        return SYSTEM if state == START else None
    return initial if initial == FOLLOWS[state] else None


def estimate(rows: bytes) -> tuple[array, ...]:
    """For each state, a lower bound of the cost of the rows from each on (and of none): the cheapest edits where the end is free, so
    that a last user need not be answered. One pass from the end."""
    n = len(rows)
    start, user, assistant = (array("q", bytes(8 * (n + 1))) for _ in range(3))  # by what follows: anything, a user, an assistant
    for i in range(n - 1, -1, -1):
        initial, must_go, more = rows[i] & 3, rows[i] & 4, TRUNCATED if rows[i] & 8 else 0
        to_start, to_user, to_assistant = start[i + 1] + DELETE, user[i + 1] + DELETE, assistant[i + 1] + DELETE
        if not must_go:
            to_user = min(to_user, assistant[i + 1] + more + (0 if initial == USER else REROLE))
            to_assistant = min(to_assistant, user[i + 1] + more + (0 if initial == ASSISTANT else REROLE))
            to_start = min(to_start, user[i + 1] + more) if initial == SYSTEM else to_start
        user[i], assistant[i] = min(to_user, to_assistant + INSERT), min(to_assistant, to_user + INSERT)
        start[i] = min(to_start, user[i])
    return start, user, assistant, user


def repair(rows: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation; of equally cheap ones the least audit.

    rows has a byte for each: the initial's state (0: another) + 4 if it must go + 8 if it is truncated. Depth-first search
    in the order Delete, Insert, Keep, Rerole under a bound on cost so far + estimate; the bound rises to the least that was
    cut off until a path is accepted, which is the answer. A table holds with what budget a state has failed: with no more
    than that it fails again. Memory is some 80 bytes a row.
    """
    n = len(rows)
    least = estimate(rows)
    failed = array("q", [-1]) * (4 * (n + 1))
    bound = least[START][0]
    while True:
        beyond = None
        # The path: where it stands after each edit, what it has cost, the edits, and how many of the four were tried there.
        rows_at, states, spent, edits, tried = array("q", [0]), array("b", [START]), array("q", [0]), bytearray(), array("b", [0])
        while states:
            at, state, g, step = rows_at[-1], states[-1], spent[-1], tried[-1]
            if step == 0:
                f = g + max(least[state][at], failed[4 * at + state] + 1)
                if f <= bound and at == n and state in (START, ASSISTANT):
                    return g, edits.decode()
                if f > bound:
                    beyond = f if beyond is None else min(beyond, f)
                    step = 4
            moved = False
            while step < 4 and not moved:
                row = rows[at] if at < n else 4
                if step == 0 and at < n:
                    nxt, to, cost, name = at + 1, state, DELETE, 68
                    moved = True
                elif step == 1:
                    nxt, to, cost, name = at, FOLLOWS[state], INSERT, 73
                    moved = True
                elif step == 2 and not row & 4 and (kept := keeps(row & 3, state)) is not None:
                    nxt, to, cost, name = at + 1, kept, TRUNCATED if row & 8 else 0, 75
                    moved = True
                elif step == 3 and not row & 4:
                    nxt, to, cost, name = at + 1, FOLLOWS[state], REROLE + (TRUNCATED if row & 8 else 0), 82
                    moved = True
                step += 1
            if moved:
                tried[-1] = step
                rows_at.append(nxt)
                states.append(to)
                spent.append(g + cost)
                tried.append(0)
                edits.append(name)
            else:
                failed[4 * at + state] = max(failed[4 * at + state], bound - g)
                for x in (rows_at, states, spent, tried):
                    x.pop()
                if edits:
                    edits.pop()
        bound = beyond


class Conversation:
    """What is held of the conversation that streams by: a byte and a digest for each row, never its texts."""

    def __init__(self, conv_id):
        self.conv_id, self.kinds, self.seen = conv_id, bytearray(), set()
        self.turns, self.first, self.last = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.audit, self.cost, self.row, self.edits = None, 0, 0, None
        self.hash, self.lines = hashlib.sha256(), 0

    def look(self, turn, initial: str, blank: bool, cut: bool, digest: bytes) -> None:
        """A row, in order: its fault and its place among the others."""
        kind = _INITIALS.get(initial, 0)
        if self.kinds and (self.kinds[-1] & 3, kind) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            self.illegal += 1
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if blank:
            self.blank += 1
            kind |= 4
        elif digest in self.seen:
            self.duplicate += 1
            kind |= 4
        elif cut:
            self.truncated += 1
            kind |= 8
        self.seen.add(digest)
        self.kinds.append(kind)

    def solve(self) -> None:
        self.seen = set()
        self.cost, self.audit = repair(bytes(self.kinds))
        self.edits = iter(self.audit)
        self.state = START

    def _line(self, text: str) -> None:
        self.hash.update(("\n" if self.lines else "").encode() + text.encode("utf-8", "surrogatepass"))
        self.lines += 1

    def write(self, role: str, text: str) -> None:
        """The same row again, after solve: what the edits make of it."""
        for edit in self.edits:
            if edit == "I":
                self.state = FOLLOWS[self.state]
                self._line(f"{NAMES[self.state]}:")
                continue
            if edit == "K":
                self.state = keeps(self.kinds[self.row] & 3, self.state)
                self._line(f"{role}:{text}")
            elif edit == "R":
                self.state = FOLLOWS[self.state]
                self._line(f"{NAMES[self.state]}:{text}")
            break
        self.row += 1

    def result(self) -> tuple:
        if self.audit is None:
            self.solve()
        for _ in self.edits:  # inserts at the end
            self.state = FOLLOWS[self.state]
            self._line(f"{NAMES[self.state]}:")
        gaps = 0 if self.first is None else min(LARGEST, self.last - self.first + 1 - self.turns)
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.hash.hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, tie, copy, gone) of the rows with faults put in, by crc32 of ``conv_id:turn`` mod 20: 0 is marked
    gone, 1 has no text, 2 no ``.!?``, 3 stands twice, 4 is a user's. Nulls of any column count as one space there, in
    role and in text; turn itself stays null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("h"))
    rows = rows.withColumn("tie", F.sha2(F.concat("role", F.lit(":"), "text"), 256)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("h") == 3, 1).otherwise(0))))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "tie", "copy", (F.col("h") == 0).alias("gone"))


def whole(conversations: DataFrame) -> DataFrame:
    """The same columns for rows that are taken as they are; nulls of role and text count as one space."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    return rows.select("*", F.sha2(F.concat("role", F.lit(":"), "text"), 256).alias("tie"), F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def mend(rows: DataFrame) -> DataFrame:
    """SCHEMA for each conv_id of ``damage`` or ``whole``: counts of faults, the cheapest edits that put it in order, what they cost, and
    the sha256 of the lines ``role:text`` they leave.

    Rows are taken by turn, nulls first; those of one turn by the sha256 of ``role:text`` as given (before damage), copies side by side.
    A null conv_id is a conversation like another; a conversation whose rows are all gone has zeros, no edits and the hash of nothing.
    Turns beyond the longs' range apart give the largest long as gaps. No rows: none. Only the columns named are read.

    Rows meet by conversation in one exchange and stream by in order, twice: first without their texts, as a role's
    initial, two flags and a digest, from which the edits follow; then with them, to be hashed. So a task holds of a
    conversation about 200 bytes a row (digests of the texts seen, and the search), however long its texts are. The
    hash of one conversation is one stream by its nature, so a conversation is one task's.
    """
    bare = F.rtrim("text", F.lit(SPACE))
    kind = F.struct(F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"))
    # A marker for each conversation whose rows may all be gone; it comes first.
    keyed = rows.withColumn("phase", F.explode(F.when(F.col("gone"), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))))
    slim = keyed.select("conv_id", "phase", "turn", "tie", "copy", F.when(F.col("phase") == 1, kind).alias("kind"), *(F.when(F.col("phase") == 2, F.col(c)).alias(c) for c in ("role", "text")))
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "phase", F.asc_nulls_first("turn"), "tie", "copy")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i > 6 else pa.int64()) for i, x in enumerate(zip(*done, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])
            done.clear()
            return out

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(3)]
            kinds = [b.column(3).field(i).to_pylist() for i in range(4)]
            for conv_id, phase, turn, initial, blank, cut, digest, role, text in zip(*columns, *kinds, b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id)
                if phase == 1:
                    now.look(turn, initial, blank, cut, bytes.fromhex(digest))
                elif phase == 2:
                    if now.audit is None:
                        now.solve()
                    now.write(role, text)
            if done:
                yield batch()
        if now is not None:
            done.append(now.result())
            yield batch()

    return dealt.select("conv_id", "phase", "turn", "kind", "role", "text").mapInArrow(stream, SCHEMA)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mend(damage(table(spark, sf_dir, "conversations")))
