"""Conversation structure repair: the cheapest edits that give every conversation a lawful order of roles.

A conversation is lawful when its roles' initials are ``(s?(ua)+)?``: nothing, or
perhaps a system turn and then pairs of user and assistant.  Its grammar has four
states: nothing yet, after a system, a user, an assistant turn.  Spark deals the
turns out by a hash of the conversation; in every task DuckDB runs one recursive
query over a batch of conversations, each step of which advances all of them by
one turn and keeps, per state, the least cost and the least audit among these.

Only numbers travel to that query: a turn's kind and its place.  Conversations of
more than ``SEGMENT`` turns are cut; a later segment is solved from every state,
and segments are then chained, so no step's size follows a conversation's length.
The texts are shuffled once, to be hashed in a stream beside the audit of their
conversation, and no conversation's texts are ever held together.  A digest of a
whole conversation is one pass over it in order, so a conversation is one task's
work, in bounded memory.

Defined results.  A null conversation is a conversation of its own, under null.  A
null turn, role or text counts as one space; null turns come first and are no part
of ``gaps``.  Rows of equal turn stand by the SHA-256 of role and text.  A role
that doesn't begin with ``s``, ``u`` or ``a`` (an empty one too) can't be kept.  An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import WORD_PATTERN, free_name, ship

#: Turns that one recursion advances over, and turns of one batch.
SEGMENT, BATCH = 512, 16_384
#: States of the grammar, and the edits' costs (fixed by the contract).
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Remainders of the damage (fixed by the contract).
DROPPED, EMPTIED, UNSTOPPED, REPEATED, USERED, OUT_OF = 0, 1, 2, 3, 4, 20

BLANKS = "' \\t\\n\\u000B\\f\\r'"


def after(state: int, made: int) -> bool:
    """Whether a turn that leads to ``made`` may follow in ``state``."""
    return made == (ASSISTANT if state == USER else USER) or (state == NOTHING and made == SYSTEM)


def wanted(state: int) -> int:
    """The only state that an inserted or changed turn may lead to."""
    return ASSISTANT if state == USER else USER


def moves() -> list[tuple[str, bool, int, int, int, str]]:
    """``kind, truncated, state, next, cost, letters``: inserts before a turn (two at most lead to new states), then its own edit."""
    best: dict[tuple, tuple[int, str]] = {}
    kept = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
    for first in range(4):
        state, cost, letters = first, 0, ""
        for _ in range(3):
            for kind in ("s", "u", "a", "x", "d"):
                for truncated in (False, True):
                    edits = [(DELETE, "D", state)]
                    if kind != "d":
                        edits.append((REROLE + TRUNCATED * truncated, "R", wanted(state)))
                        if kind in kept and after(state, kept[kind]):
                            edits.append((KEEP + TRUNCATED * truncated, "K", kept[kind]))
                    for extra, letter, to in edits:
                        key = kind, truncated, first, to
                        best[key] = min(best.get(key, (1 << 30, "")), (cost + extra, letters + letter))
            state, cost, letters = wanted(state), cost + INSERT, letters + "I"
    return [(*key, *value) for key, value in sorted(best.items())]


def endings() -> dict[int, tuple[int, str]]:
    """What each state still needs at the end."""
    return {NOTHING: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}


#: One step advances every unit (a conversation or a segment of one) by a turn.
RECURSION = """
WITH RECURSIVE best(unit, start, state, turn, told) USING KEY (unit, start, state) AS (
    SELECT unit, start, start, 0, {'cost': 0::BIGINT, 'audit': ''} FROM starts
    UNION
    SELECT b.unit, b.start, m.next, b.turn + 1, min({'cost': b.told.cost + m.cost, 'audit': b.told.audit || m.letters})
    FROM best b JOIN turns t ON t.unit = b.unit AND t.turn = b.turn JOIN moves m ON m.kind = t.kind AND m.truncated = t.truncated AND m.state = b.state
    GROUP BY b.unit, b.start, m.next, b.turn
)
SELECT unit, start, state, told.cost AS cost, told.audit AS audit FROM best JOIN lengths USING (unit, turn) ORDER BY unit
"""


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage; a repeated row is there twice."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % OUT_OF
    role = F.when(F.col("harm") == USERED, "user").otherwise(known("role"))
    text = F.when(F.col("harm") == EMPTIED, "").when(F.col("harm") == UNSTOPPED, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    times = F.when(F.col("harm") == REPEATED, 2).otherwise(1)
    kept = rows.select("conv_id", "turn", "role", "text", harm.alias("harm")).where(F.col("harm") != DROPPED)
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("_copy")).drop("_copy")


def _digest() -> Column:
    """Tells role and text apart from all others: the role's length stands before it."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("digest").asc()]


def numbered(rows: DataFrame) -> DataFrame:
    """``conv_id, place, turn, initial, fault, first_of_turn, lawful``: what the repair needs of each turn, without its text.

    ``fault`` is ``blank``, ``duplicate``, ``truncated`` or null; ``lawful`` tells whether the turn may stand after the one before it.
    """
    blank = ~F.col("text").rlike(WORD_PATTERN)
    open_end = ~F.substring(F.expr(f"trim(TRAILING {BLANKS} FROM text)"), -1, 1).isin(".", "!", "?")
    light = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), open_end.alias("truncated"), _digest().alias("digest"))
    # both windows are met by one exchange on the conversation
    light = light.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("truncated"), "truncated")
    # of equal rows in one turn the first is the one that isn't a duplicate
    inside = Window.partitionBy("conv_id").orderBy(*_order(), "again")
    placed = light.withColumn("again", again).select("conv_id", "turn", "initial", fault.alias("fault"), "digest", "again").withColumn("place", F.row_number().over(inside))
    placed = placed.withColumn("_turn", F.lag("turn").over(inside)).withColumn("_initial", F.lag("initial").over(inside))
    first_of_turn = F.col("turn").isNotNull() & ((F.col("place") == 1) | ~F.col("turn").eqNullSafe(F.col("_turn")))
    lawful = (F.col("place") == 1) | F.concat("_initial", "initial").isin("su", "ua", "au")
    return placed.select("conv_id", "place", "turn", "initial", "fault", first_of_turn.alias("first_of_turn"), lawful.alias("lawful"))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task in tables of whole units; only an open unit waits for its end."""
    held: list[pa.RecordBatch] = []
    many = 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many < BATCH:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = pc.indices_nonzero(pc.equal(_segment_place(table), 0))
        last = starts[-1].as_py() if len(starts) else 0
        if last:
            yield table.slice(0, last)
        held, many = table.slice(last).to_batches(), table.num_rows - last
    if many:
        yield pa.Table.from_batches(held).combine_chunks()


def _segment_place(table: pa.Table) -> pa.ChunkedArray:
    place = pc.subtract(table.column("place").cast(pa.int64()), 1)
    return pc.subtract(place, pc.multiply(pc.divide(place, SEGMENT), SEGMENT))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, cost, audit`` of every conversation of a task, whose rows come by conversation and place."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    con.execute("CREATE TABLE moves (kind VARCHAR, truncated BOOLEAN, state INTEGER, next INTEGER, cost BIGINT, letters VARCHAR)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())
    ends = endings()
    ids = None
    owner, best = None, None

    def closed():
        cost, audit = min((c + ends[s][0], a + ends[s][1]) for s, (c, a) in best.items())
        return owner, cost, audit

    for table in _units(batches):
        ids = table.schema.field("conv_id").type
        within = _segment_place(table).to_numpy()
        unit = (within == 0).cumsum() - 1
        firsts = (within == 0).nonzero()[0]
        owners = table.column("conv_id").take(pa.array(firsts)).to_pylist()
        opens = (table.column("place").to_numpy()[firsts] == 1).tolist()
        fault = table.column("fault")
        required = pc.is_in(fault, value_set=pa.array(["blank", "duplicate"]))
        initial = table.column("initial")
        kind = pc.if_else(required, "d", pc.if_else(pc.is_in(initial, value_set=pa.array(["s", "u", "a"])), initial, "x"))
        turns = pa.table({"unit": unit, "turn": within.astype("int32"), "kind": kind, "truncated": pc.fill_null(pc.equal(fault, "truncated"), False)})  # noqa: F841
        sizes = [*firsts[1:].tolist(), table.num_rows]
        lengths = pa.table({"unit": list(range(len(firsts))), "turn": [b - a for a, b in zip(firsts.tolist(), sizes)]})  # noqa: F841
        pairs = [(u, s) for u, fresh in enumerate(opens) for s in ((NOTHING,) if fresh else range(4))]
        starts = pa.table({"unit": [u for u, _ in pairs], "start": pa.array([s for _, s in pairs], pa.int32())})  # noqa: F841
        found: list[dict] = [{} for _ in firsts]
        for u, start, state, cost, audit in con.execute(RECURSION).fetchall():
            found[u].setdefault(start, []).append((state, cost, audit))
        out = []
        for u, steps in enumerate(found):
            if opens[u]:
                if best is not None:
                    out.append(closed())
                owner, best = owners[u], {NOTHING: (0, "")}
            chained: dict[int, tuple[int, str]] = {}
            for start, (cost, audit) in best.items():
                for state, more, letters in steps.get(start, ()):
                    if state not in chained or cost + more <= chained[state][0]:
                        told = cost + more, audit + letters
                        chained[state] = min(chained.get(state, told), told)
            best = chained
        yield _batch(out, ids)
    if best is not None:
        yield _batch([closed()], ids)


def _batch(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
    owner, cost, audit = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(owner, ids), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["conv_id", "cost", "audit"])


def repairs(turns: DataFrame) -> DataFrame:
    """``conv_id, cost, audit`` of ``numbered`` turns."""
    ship(turns.sparkSession)
    # the optimizer may swap the windows, so their order alone doesn't hold
    lean = turns.select("conv_id", "place", "initial", "fault").sortWithinPartitions("conv_id", "place")
    return lean.mapInArrow(_solve, f"conv_id {dict(turns.dtypes)['conv_id']}, cost bigint, audit string")


class _Writer:
    """The repaired turns of one conversation, as its audit tells them."""

    names = {USER: "user", ASSISTANT: "assistant"}
    kept = {"s": SYSTEM, "u": USER, "a": ASSISTANT}

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = wanted(self.state)
            yield self.names[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = self.kept[role[0]]
            yield role, text
        elif letter == "R":
            self.state = wanted(self.state)
            yield self.names[self.state], text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserts()


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, role, text)`` of every repaired turn, and ``(conv_id, None, None)`` after a conversation's last one."""
    writer, owner = None, None
    for batch in batches:
        audits, roles, texts = batch.column("audit"), batch.column("role"), batch.column("text")
        heads = audits.is_valid().to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            if heads[i]:
                if writer:
                    yield from ((owner, *turn) for turn in writer.end())
                    yield owner, None, None
                writer, owner = _Writer(audits[i].as_py()), batch.column("conv_id")[i].as_py()
            else:
                yield from ((owner, *turn) for turn in writer.turn(roles[i].as_py(), texts[i].as_py()))
    if writer:
        yield from ((owner, *turn) for turn in writer.end())
        yield owner, None, None


def _joined(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns in order, a conversation in one partition; sorting spills."""
    turns = rows.withColumn("digest", _digest()).withColumn("audit", F.lit(None).cast("string"))
    heads = audits.select("conv_id", "audit")
    mixed = turns.unionByName(heads, allowMissingColumns=True).repartition("conv_id")
    return mixed.sortWithinPartitions("conv_id", F.col("audit").isNull(), *_order()).select("conv_id", "role", "text", "audit")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the turns after the repair, in their new order."""
    ids = dict(rows.dtypes)["conv_id"]

    def run(batches):
        names, place, out, kind = ["conv_id", "place", "role", "text"], 0, [], None

        def packed():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names)

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        for owner, role, text in _walk(typed()):
            if role is None:
                place = 0
                continue
            place += 1
            out.append((owner, place, role, text))
            if len(out) == 1024:
                yield packed()
                out = []
        if out:
            yield packed()

    return _joined(rows, audits).mapInArrow(run, f"conv_id {ids}, place bigint, role string, text string")


def hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of every conversation that has an audit: ``role:text`` of its repaired turns, by newline."""
    ids = dict(rows.dtypes)["conv_id"]

    def run(batches):
        kind, out, sha, between = None, [], hashlib.sha256(), b""

        def packed():
            owners, told = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(owners, kind), pa.array(told, pa.string())], ["conv_id", "repaired_sha256"])

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        for owner, role, text in _walk(typed()):
            if role is None:
                out.append((owner, sha.hexdigest()))
                sha, between = hashlib.sha256(), b""
                if len(out) == 1024:
                    yield packed()
                    out = []
            else:
                sha.update(between + f"{role}:{text}".encode())
                between = b"\n"
        if out:
            yield packed()

    return _joined(rows, audits).mapInArrow(run, f"conv_id {ids}, repaired_sha256 string")


def faults(turns: DataFrame) -> DataFrame:
    """``conv_id`` with its ``gaps, blank, duplicate, truncated, illegal`` from ``numbered`` turns."""
    count = lambda when: F.sum(F.when(when, 1).otherwise(0)).cast("long")
    span = F.max("turn") - F.min("turn") + 1 - count(F.col("first_of_turn"))
    kinds = [count(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    return turns.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *kinds, count(~F.col("lawful")).alias("illegal"))


def repair(conversations: DataFrame, id_col: str = "conv_id", harm: bool = True) -> DataFrame:
    """One row per conversation: its faults, the least cost, the audit and the digest of the repaired turns; ``harm`` damages the rows first."""
    rows = conversations.select(F.col(id_col).alias("conv_id"), "turn", "role", "text")
    after_harm = damaged(rows) if harm else rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    turns = numbered(after_harm)
    audits = repairs(turns)
    # a group has one row of each kind, and null is a group like any other
    parts = rows.select("conv_id").distinct()
    for part in (faults(turns), audits, hashes(after_harm, audits)):
        parts = parts.unionByName(part, allowMissingColumns=True)
    number = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    counts = [number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    told = parts.groupBy("conv_id").agg(*counts, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"))
    return told.withColumnRenamed("conv_id", id_col)
