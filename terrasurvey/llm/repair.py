"""Repair of the turn structure of conversations: A* over an edit lattice, cheapest edits first, then the least audit."""

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: What an edit costs, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Rows of a conversation that are aligned at once, and characters of them.
BLOCK_ROWS, BLOCK_CHARS = 1_024, 1 << 24
#: States of what was written so far: nothing, a system turn, a user turn, an assistant turn. A repaired conversation ends in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may follow in each state besides a system turn at the start, and the state after it.
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}


def align(rows: str, start: int, goals: tuple[int, ...], inserts_after: bool = True) -> dict[int, tuple[int, str]]:
    """{state: (cost, audit)} of the cheapest edits, and of these the least audit, that lead from state `start` over all rows to each of the goals.

    rows: two characters a row, its role's initial (`-` if no other fits) and its fault (`d` must go, `t` is truncated, `.` is sound). A*: a node of the
    lattice is (rows done, state); the heuristic is the suffix sum of a deletion for each row that must go and of a truncation charge for each truncated
    one, which no edits can avoid (deleting it costs more). Nodes are taken by (cost + heuristic, audit). No audit of a node is the beginning of another
    of equal cost, so the first one that arrives is the least. With inserts_after false nothing is inserted behind the last row, so that blocks can be
    joined without counting an insertion at their border twice.
    """
    n = len(rows) // 2
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[2 * i + 1] == "d" else CUT if rows[2 * i + 1] == "t" else 0)
    queue, done, found = [(rest[0], "", 0, start)], set(), {}
    while queue and len(found) < len(goals):
        f, audit, i, state = heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in goals:
            found[state] = (f, audit)
        cost = f - rest[i]
        need, then = NEXT[state]
        if i < n or inserts_after:
            heappush(queue, (f + INSERT, audit + "I", i, then))
        if i == n:
            continue
        role, fault, after = rows[2 * i], rows[2 * i + 1], rest[i + 1]
        heappush(queue, (cost + DELETE + after, audit + "D", i + 1, state))
        if fault != "d":
            charge = cost + (CUT if fault == "t" else 0) + after
            if role == need:
                heappush(queue, (charge, audit + "K", i + 1, then))
            elif role == "s" and state == START:
                heappush(queue, (charge, audit + "K", i + 1, SYSTEM))
            if role != need:
                heappush(queue, (charge + REROLE, audit + "R", i + 1, then))
    return found


@lru_cache(maxsize=1 << 14)
def align_short(rows: str, start: int, goals: tuple[int, ...], inserts_after: bool) -> dict[int, tuple[int, str]]:
    """align for short rows: many conversations have the same roles and faults."""
    return align(rows, start, goals, inserts_after)


def repaired(audit: str, state: int, rows: list[tuple[str, str]]) -> list[str]:
    """The lines `role:text` that the edits leave. rows: (role, text); state: that before them."""
    out, at = [], iter(rows)
    for edit in audit:
        need, then = NEXT[state]
        name = "user" if need == "u" else "assistant"
        if edit == "I":
            out.append(f"{name}:")
            state = then
            continue
        role, text = next(at)
        if edit == "D":
            continue
        system = edit == "K" and role[:1] == "s"
        out.append(f"{role if edit == 'K' else name}:{text}")
        state = SYSTEM if system else then
    return out


class Conversation:
    """One conversation's rows as they arrive in order. Only a block of rows is held, besides the audits so far.

    For each state that a finished block can end in the cheapest edits, their audit and the running digest of the repaired text are kept, so a
    conversation of any length is repaired as a whole.
    """

    def __init__(self):
        self.rows, self.codes, self.chars = [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.before = None
        self.settled = []  # the audit that all ways share, in pieces
        self.ways = {START: (0, "", hashlib.sha256(), True)}
        self.seen = False

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += self.high is None or turn != self.high
            self.high = turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        initial = role[:1]
        self.illegal += self.seen and self.before + initial not in ("su", "ua", "au")
        self.before, self.seen = initial, True
        self.rows.append((role, text))
        self.codes.append((initial if initial in ("s", "u", "a") else "-") + ("d" if fault in ("blank", "duplicate") else "t" if fault == "truncated" else "."))
        self.chars += len(text)
        if len(self.rows) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS:
            self.close(False)

    def close(self, last: bool) -> None:
        """Aligns the rows held; the best way to each state goes on."""
        codes = "".join(self.codes)
        goals = (START, ASSISTANT) if last else (START, SYSTEM, USER, ASSISTANT)
        edits_of = align_short if len(codes) <= 128 else align
        best: dict[int, tuple] = {}
        for state, (cost, audit, _, _) in self.ways.items():
            for end, (more, edits) in edits_of(codes, state, goals, last).items():
                way = (cost + more, audit + edits, state, edits)
                if end not in best or way < best[end]:
                    best[end] = way
        origins = {state for _, _, state, _ in best.values()}
        if shared := len(origins) == 1:
            self.settled.append(self.ways[min(origins)][1])
        ways = {}
        for end, (cost, audit, state, edits) in best.items():
            _, _, digest, first = self.ways[state]
            digest = digest.copy()
            for line in repaired(edits, state, self.rows):
                digest.update((line if first else "\n" + line).encode())
                first = False
            ways[end] = (cost, edits if shared else audit, digest, first)
        self.ways, self.rows, self.codes, self.chars = ways, [], [], 0

    def result(self) -> tuple:
        self.close(True)
        cost, audit, digest, _ = min(self.ways.values(), key=lambda way: way[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.settled) + audit, digest.hexdigest()


FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with `fault`, the first of blank, duplicate and truncated, sorted by turn in one partition for each conversation."""
    seen = Window.partitionBy("conv_id", "there", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(F.row_number().over(seen) > 1, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
        .otherwise("sound")
    )
    dealt = rows.repartition("conv_id").withColumn("fault", fault)
    return dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", F.desc("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation; see op12_conversations.

    rows: conv_id, turn, role and text (both not null), and `there`: false marks a conversation that is to be returned though it may have no rows left.
    Rows move once, to their conversation's partition; sorts spill, and the fold over it holds one block of rows. The digest of a repaired
    conversation is that of one text, so it is made in one task, also where one conversation has very many rows; its memory stays bounded (but for the audit itself).
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = with_faults(rows)

    def run(batches):
        key, conversation, out, begun = None, None, [], False

        def batch_of(found):
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in found], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in numbers], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            names = ("conv_id", "turn", "role", "text", "there", "fault")
            for conv, turn, role, text, there, fault in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names], strict=True):
                if not begun or conv != key:
                    if begun:
                        out.append((key, *conversation.result()))
                    key, conversation, begun = conv, Conversation(), True
                    if len(out) >= 1024:
                        yield batch_of(out)
                        out = []
                if there:
                    conversation.add(turn, role, text, fault)
        if begun:
            out.append((key, *conversation.result()))
        if out:
            yield batch_of(out)

    return turns.mapInArrow(run, f"conv_id {kind}, {FIELDS}")


def damaged(rows: DataFrame) -> DataFrame:
    """rows with the damage that crc32 of `conv_id:turn` tells, each once (a repeated one twice); dropped rows stay as marks with `there` false."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    new = F.when(what <= 1, "").when(what == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    role: Column = F.when(what == 4, "user").otherwise(text("role"))
    there = F.explode(F.when(what == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(what != 0)))
    return rows.select("conv_id", "turn", role.alias("role"), new.alias("text"), there.alias("there"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and repaired digest of every damaged conversation.

    Null roles and texts are one space, also in the key of the damage; rows without conv_id are one conversation. Rows of one turn go by role, then
    text, after the damage, so that equal ones follow each other; repeated rows are rows like any other (duplicates of the first). Very long texts are taken
    whole. Conversations of which all rows are dropped have zeros, an empty audit and the digest of the empty text; an empty table gives no
    rows; further columns don't matter.
    """
    return repair(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
