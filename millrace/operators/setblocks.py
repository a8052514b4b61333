"""Dice pairs where most texts share words: classes compared in blocks, under bounds by bits, exactly.

A block is a bounded part of the left classes, of neighbouring sizes.  It stands in every task while the classes whose
sizes allow a partner pass it where they lie; the next block follows, so a table of any size takes bounded memory, and no
list of words or of meetings is exchanged.  Words are 64-bit marks.  Of two sets with marks dealt over some bits, the
common words are at most the common bits and the lesser number of words beyond a set's own bits:

* few bits for all pairs of a block, by one product of matrices;
* eight times as many for the pairs that are left;
* then the common marks are counted.

Pairs are counted by marks only where no two words of the tables share one (:func:`told_apart` sees to that).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators import mapside
from millrace.packages import ship

#: Marks of a block, bits that it has at most, and rows that it may always have.
MARKS, CELLS, ROWS = 8_000_000, 12_000_000, 64
#: Bits a set, at least and at most, of these for a word of a block's largest set, and how many more the second bound takes.
LEAST, MOST, WORD, MORE = 128, 1 << 16, 1.5, 8
#: Cells that a task holds at a time, and classes of a block in one product.
HELD, COLUMNS = 2_000_000, 1_024
#: A rounding must not lose a pair that just reaches the threshold.
SLACK = 1e-9


def marked(sets: DataFrame) -> DataFrame:
    """``set_key, copies, size, marks`` of classes, those of a part by size."""
    many = 2 * sets.sparkSession.sparkContext.defaultParallelism
    rows = sets.select("set_key", "copies", F.size("words").alias("size"), F.sort_array(F.transform("words", lambda w: F.xxhash64(w))).alias("marks"))
    return rows.repartition(many).sortWithinPartitions("size")


def told_apart(words: DataFrame) -> Column:
    """Whether the words of a mark are one, over the rows of a mark in ``words (word)``; they are compared by 64 other bits."""
    other = F.xxhash64(F.lit(1), "word")
    return F.min(other) == F.max(other)


def bits(size: int) -> int:
    return int(min(MOST, max(LEAST, -(-size * WORD // 64) * 64)))


def blocks(sizes: list[tuple[int, int]], cells: int) -> Iterator[tuple[int, int, int]]:
    """Least and largest size and number of parts of every block, of the numbers of classes by size, ascending."""
    first, rows, marks = None, 0, 0
    for at, (size, many) in enumerate(sizes):
        first, rows, marks = size if first is None else first, rows + many, marks + many * size
        ahead = sizes[at + 1] if at + 1 < len(sizes) else None
        fits = ahead and (rows + ahead[1]) * bits(ahead[0]) <= cells and marks + ahead[0] * ahead[1] <= MARKS
        # a wide block has more bits than its small sets need
        fits = fits and (rows * bits(size) < cells // 8 or bits(ahead[0]) <= max(LEAST, 1.5 * bits(first)))
        if not fits:
            room = max(ROWS, min(cells // bits(size), MARKS // max(1, size)))
            yield first, size, -(-rows // room)
            first, rows, marks = None, 0, 0


class Sets:
    """Some sets with their marks as bits."""

    def __init__(self, batch: pa.Table | pa.RecordBatch, width: int):
        one = (lambda c: mapside.column(batch, c)) if isinstance(batch, pa.Table) else batch.column
        self.keys, self.copies, self.size = one("set_key"), one("copies"), one("size").to_numpy().astype(np.int64)
        marks = one("marks")
        self.first, self.marks, self.many, self.width = marks.offsets.to_numpy().astype(np.int64), marks.values.to_numpy(), len(marks), width
        self.few, self.over = self._few()

    def _told(self, a: int, b: int, width: int) -> np.ndarray:
        """The bits of the sets from ``a`` to ``b``."""
        own = self.marks[self.first[a] : self.first[b]].view(np.uint64)
        # other bits of a mark for every width, so that the second bound doesn't repeat the first
        place = (own >> np.uint64(32 if width == self.width else 0)) & np.uint64(0xFFFFFFFF)
        place = (place % np.uint64(width)).astype(np.int64) + np.repeat(np.arange(b - a) * width, self.size[a:b])
        out = np.zeros((b - a) * width, bool)
        out[place] = True
        return out.reshape(b - a, width)

    def _few(self) -> tuple[np.ndarray, np.ndarray]:
        out, over = np.zeros((self.many, self.width + 2), np.float32), np.zeros(self.many, np.int64)
        step = max(1, HELD // self.width)
        for a in range(0, self.many, step):
            b = min(self.many, a + step)
            told = self._told(a, b, self.width)
            out[a:b, :-2] = told
            over[a:b] = self.size[a:b] - told.sum(1)
        return out, over

    def more(self) -> tuple[np.ndarray, np.ndarray]:
        """The bits of the second bound, 64 in one number, and the words beyond them."""
        wide = MORE * self.width
        out, over, step = np.zeros((self.many, wide // 64), np.uint64), np.zeros(self.many, np.int64), max(1, HELD // wide)
        for a in range(0, self.many, step):
            b = min(self.many, a + step)
            told = self._told(a, b, wide)
            out[a:b] = np.packbits(told, axis=1).view(np.uint64)
            over[a:b] = self.size[a:b] - told.sum(1)
        return out, over


def _met(block: Sets, wide: tuple[np.ndarray, np.ndarray], rows: Sets, held: np.ndarray, least: float, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Classes of the block, rows and their common words, of pairs that may have Dice of ``least`` or more; ``held`` is room for a product."""
    half = least / 2.0
    # what is left of the bound once the halves of the sizes are taken off; the product rounds to 24 bits
    rows.few[:, -2], rows.few[:, -1] = 1.0, -half * (1 - 1e-5) * rows.size + 0.01
    # the block lies by size, and rows that come together are of about one size: only a part of the block can be near them
    ratio = least / (2.0 - least)
    begin = np.searchsorted(block.size, rows.size.min() * ratio * (1 - SLACK))
    end = np.searchsorted(block.size, rows.size.max() if itself else rows.size.max() / ratio * (1 + SLACK), "right")
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(begin, end, COLUMNS):
        part = block.few[a : min(end, a + COLUMNS)]
        cells = held[: rows.many * len(part)].reshape(rows.many, len(part))
        np.matmul(rows.few, part.T, out=cells)
        cell = np.flatnonzero((cells >= 0).reshape(-1))
        x.append(a + cell % len(part)), y.append(cell // len(part))
    x, y = np.concatenate(x), np.concatenate(y)
    if itself and len(x):
        after = rows.size[y] > block.size[x]
        same = np.flatnonzero(rows.size[y] == block.size[x])
        after[same] = np.asarray(rows.keys.take(pa.array(y[same])).to_numpy(zero_copy_only=False) > block.keys.take(pa.array(x[same])).to_numpy(zero_copy_only=False), bool)
        x, y = x[after], y[after]
    if not len(x):
        return
    needed = np.ceil((block.size[x] + rows.size[y]) * half - SLACK)
    bits, over = rows.more()
    step, near = max(1, HELD // bits.shape[1]), np.zeros(len(x), bool)
    for a in range(0, len(x), step):
        i, j = x[a : a + step], y[a : a + step]
        near[a : a + step] = np.bitwise_count(wide[0][i] & bits[j]).sum(1, dtype=np.int64) + np.minimum(wide[1][i], over[j]) >= needed[a : a + step]
    x, y = x[near], y[near]
    order = np.argsort(y, kind="stable")
    x, y = x[order], y[order]
    begins = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1]))) if len(y) else []
    for first, last in zip(begins, [*begins[1:], len(y)]):
        own = rows.marks[rows.first[y[first]] : rows.first[y[first] + 1]]
        ends = first + np.flatnonzero(np.diff(np.cumsum(block.size[x[first:last]]) // HELD, append=-1)) + 1
        for a, b in zip([first, *ends[:-1]], ends):
            of = x[a:b]
            size = block.size[of]
            other = block.marks[np.repeat(block.first[of] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
            yield of, y[a:b], np.bincount(np.repeat(np.arange(len(of)), size), hit, len(of)).astype(np.int64)


def compared(block: DataFrame, others: DataFrame, width: int, least: float, itself: bool) -> tuple[DataFrame, object]:
    """``x_key, y_key, x_copies, y_copies, lex`` of a block against other classes, and what is broadcast for it.

    ``itself``: both are of one table, and a row meets only what comes before it by size and key.
    """
    spark = others.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(block.toArrow().sort_by("size"))

    def run(batches):
        held = wide = None
        room = np.zeros(COLUMNS * 1024, np.float32)
        for batch in batches:
            for rows in mapside.slices(batch, min(1024, max(1, HELD // width))):
                if held is None:
                    held = Sets(shared.value, width)
                    held.few[:, -2], held.few[:, -1] = held.over - least / 2.0 * (1 - 1e-5) * held.size, 1.0
                    wide = held.more()
                if not held.many:
                    return
                told = Sets(rows, width)
                for x, y, common in _met(held, wide, told, room, least, itself):
                    lex = 2.0 * common / (held.size[x] + told.size[y])
                    near = lex >= least
                    x, y = pa.array(x[near]), pa.array(y[near])
                    yield pa.RecordBatch.from_arrays([held.keys.take(x), told.keys.take(y), held.copies.take(x), told.copies.take(y), pa.array(lex[near])], ["x_key", "y_key", "x_copies", "y_copies", "lex"])

    kinds = dict(block.dtypes)["set_key"], dict(others.dtypes)["set_key"]
    return others.mapInArrow(run, f"x_key {kinds[0]}, y_key {kinds[1]}, x_copies long, y_copies long, lex double"), shared
