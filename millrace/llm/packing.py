"""Best-fit packing of documents into fixed-length training sequences.

How many pieces there are of each length says all that a packing needs, and
that table has at most ``capacity`` rows at any size of the input.  So the
packing is planned on the driver over (length, count) classes:

1. *Dominance reduction* (Martello and Toth).  From the longest class down, a
   small set of pieces that no other filling of a sequence with this piece can
   beat is fixed for good, for all equal pieces at once: a full piece alone; a
   piece with an exact complement; a piece that nothing fits beside; a piece
   beside which at most one other fits, with the longest such.
2. *Best fit decreasing* over what remains, again by classes: equal sequences
   are kept as one group with a multiplicity.

Pieces then get a rank in their length class by a distributed prefix sum
(counts per class and shard, then a rank within the shard), so that neither a
hot length nor the plan needs all rows in one place, and the rank finds the
piece's sequence and offset.

Edge cases: null or empty texts hold the end token alone; documents of more
than ``capacity`` tokens are cut into full pieces, the first of which may be
shorter; repeated rows and rows with a null id are packed as rows of their own;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._shared import materialize, ship
from .bpe import WHITE_SPACE, _class_of, encoder, slices

#: A run of this many characters without white space, or of nothing but it, is encoded by the trie, whose time is linear in the run.
LONG_RUN = 400
#: Pieces that one shard ranks.
SHARD_ROWS = 20_000

_fast: dict[str, object] = {}


def _fast_encoder(path: str):
    """The vocabulary file as a tiktoken encoding: the same ids, several times faster."""
    if path not in _fast:
        import tiktoken

        own = encoder(path)
        special = own.special
        letters, numbers = _class_of("L"), _class_of("N")
        classes = [re.sub(r"\\U([0-9a-f]{8})", r"\\x{\1}", c) for c in (letters, numbers)]
        space = "".join(c if c in "-" or c.isascii() and c not in " " else f"\\x{{{ord(c):x}}}" for c in WHITE_SPACE)
        pattern = "'s|'t|'re|'ve|'m|'ll|'d| ?[{0}]+| ?[{1}]+| ?[^{2}{0}{1}]+|[{2}]+(?![^{2}])|[{2}]+".format(*classes, space)
        ranks = {piece: i for piece, i in own.id_of.items()}
        long_run = re.compile(f"[^{WHITE_SPACE}]{{{LONG_RUN}}}|[{WHITE_SPACE}]{{{LONG_RUN}}}")
        _fast[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), own, long_run
    return _fast[path]


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a text as unsigned 32-bit integers."""
    if not text:
        return np.empty(0, np.uint32)
    fast, own, long_run = _fast_encoder(path)
    if long_run.search(text):
        return np.frombuffer(own.encode_packed([text])[0], np.uint32)
    return fast.encode_to_numpy(text, allowed_special="all")


def cut(docs: DataFrame, vocabulary: str, end_token: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in slices(batches, text_col):
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(text_col).to_pylist()):
                ids = np.append(token_ids(text, vocabulary), np.uint32(end_token)).astype("<u4")
                at, size = 0, len(ids) % capacity or capacity
                for k in range(-(-len(ids) // capacity)):
                    part = ids[at : at + size]
                    rows.append(row), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                    kept.append(part.astype(np.int32) if with_ids else None)
                    at, size = at + size, capacity
            columns = [batch.column(id_col).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.list_(pa.int32()))][: 5 + with_ids], [id_col, "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    chosen = docs.select(id_col, text_col)
    schema = f"`{id_col}` {dict(chosen.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return chosen.mapInArrow(run, schema)


class Plan:
    """Groups of equal sequences: (how many, the lengths in one of them)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.groups: list[tuple[int, tuple[int, ...]]] = []

    def reduce(self, left: dict[int, int]) -> None:
        """Fix dominating sets and take them out of ``left`` (length -> count)."""
        room = self.capacity

        def fix(many: int, *lengths: int) -> None:
            self.groups.append((many, lengths))
            for x in lengths:
                left[x] -= many
                if not left[x]:
                    del left[x]

        for longest in sorted(left, reverse=True):
            while left.get(longest):
                here, rest = left[longest], room - longest
                if not rest:
                    fix(here, longest)
                    continue
                if rest == longest:
                    if here < 2:
                        break
                    fix(here // 2, longest, longest)
                    continue
                if rest in left:
                    fix(min(here, left[rest]), longest, rest)
                    continue
                others = sorted(x for x in left if x <= rest and (x != longest or here > 1))
                if not others:
                    fix(here, longest)
                    continue
                second = others[0] if left[others[0]] - (others[0] == longest) > 1 else others[1] if len(others) > 1 else room
                if others[0] + second > rest:  # at most one other fits beside it: the longest dominates
                    best = others[-1]
                    if best == longest:
                        fix(here // 2, longest, longest)
                    else:
                        fix(min(here, left[best]), longest, best)
                    continue
                break

    def best_fit(self, left: dict[int, int]) -> None:
        """Longest first, each piece into the open sequence with the least room that takes it."""
        open_by_room: dict[int, list[list]] = defaultdict(list)
        for length in sorted(left, reverse=True):
            count = left[length]
            while count:
                room = min((r for r, groups in open_by_room.items() if groups and r >= length), default=None)
                if room is None:
                    per = self.capacity // length
                    for many, each in ((count // per, per), (1, count % per)):
                        if many and each:
                            open_by_room[self.capacity - each * length].append([many, (length,) * each])
                    break
                group = open_by_room[room][-1]
                many = min(group[0], count)
                group[0] -= many
                if not group[0]:
                    open_by_room[room].pop()
                open_by_room[room - length].append([many, (*group[1], length)])
                count -= many
        left.clear()
        self.groups += [(many, lengths) for groups in open_by_room.values() for many, lengths in groups]

    def slots(self) -> dict[int, np.ndarray]:
        """Per length, rows of (first rank, first sequence id, offset); each holds for the ranks up to the next row's."""
        out, used, sequence = defaultdict(list), defaultdict(int), 0
        for many, lengths in self.groups:
            offset = 0
            for x in lengths:
                out[x].append((used[x], sequence, offset))
                used[x] += many
                offset += x
            sequence += many
        return {x: np.array(rows, np.int64) for x, rows in out.items()}


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    plan, left = Plan(capacity), {x: n for x, n in counts.items() if n}
    plan.reduce(left)
    plan.best_fit(left)
    return plan


def pack(pieces: DataFrame, capacity: int, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``capacity``."""
    ship(pieces.sparkSession)
    pieces = materialize(pieces, "pieces")  # ranks need the same rows at each reading
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = plan_packing(counts, capacity).slots()
    shards = max(1, -(-sum(counts.values()) // SHARD_ROWS))
    sharded = pieces.withColumn("_shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sharded.groupBy("length", "_shard").agg(F.count("*").alias("_n")).select("length", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = sharded.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_shard").orderBy(*order)))
    ranked = ranked.join(offsets, ["length", "_shard"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    names = pieces.columns

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for x in np.unique(lengths):
                of, rows = lengths == x, slots[int(x)]
                slot = np.searchsorted(rows[:, 0], ranks[of], "right") - 1
                sequence[of] = rows[slot, 1] + ranks[of] - rows[slot, 0]
                offset[of] = rows[slot, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return ranked.select(*names, "_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_token: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack ``docs`` into as few sequences of ``capacity`` tokens as it can."""
    return pack(cut(docs, vocabulary, end_token, capacity, id_col, text_col), capacity, (id_col, "piece"))
