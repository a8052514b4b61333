"""Embedding near-duplicates by collision-counting projections.

Vectors are scaled to length one and projected on random lines.  Near vectors
stay near on every line: two vectors at the similarity threshold differ by a
normal amount of known spread.  So

* a *table* cuts a few lines into cells and brings vectors of one label and
  cell together; how many lines follows from the label's number of vectors
  (cells of about ``CELL``), and how many tables from the recall wanted;
* inside a cell the vectors are sorted along further lines, and every vector
  counts, per partner, how many of its query-centred windows the partner falls
  into.  Pairs with at least ``least_collisions`` (calibrated so that a pair at
  the threshold passes with probability ``RECALL``) are verified by their
  cosine in double precision.

A pair that meets in several tables counts in the first.  Equal vectors are one
row with a weight, so a vector with any number of copies costs one row.  Cells
that are still large are dealt out in blocks that meet pairwise; a task returns
each vector's number of links and a spanning forest of them, never all pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, null labels and null identifiers link with nothing; vectors of
different dimension don't link; repeated rows are vectors of their own; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import join_hot, materialize, ship
from .components import components

#: Width of a cell on a line, in units of a unit vector's spread; half a window, in standard deviations at the threshold.
CELL_WIDTH, WINDOW = 1.0, 2.5
#: Vectors that a cell should hold, about, and that one block of a large cell holds.
CELL, BLOCK = 500, 4000
#: Lines along which collisions are counted.
LINES = 8
#: Chance that a pair at the threshold meets in a table, and that it passes the count.
RECALL = 0.98
SEED = 20_240_601


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def same_cell(distance: float) -> float:
    """Chance that two vectors at a distance share a cell of one randomly shifted line."""
    r = CELL_WIDTH / distance
    return 1 - 2 * _normal(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def layout(vectors: int, threshold: float) -> tuple[int, int]:
    """Lines per table and tables for a label with so many vectors; both grow with its logarithm and a small power."""
    lines = max(0, math.ceil(math.log(max(1.0, vectors / CELL)) / -math.log(same_cell(math.sqrt(2)))))
    meet = same_cell(math.sqrt(2 * (1 - threshold))) ** lines
    return lines, 1 if not lines else math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def least_collisions() -> int:
    """The largest count that a pair at the threshold reaches with probability ``RECALL``."""
    p = 2 * _normal(WINDOW) - 1
    at_least = lambda c: sum(math.comb(LINES, k) * p**k * (1 - p) ** (LINES - k) for k in range(c, LINES + 1))
    return max(c for c in range(LINES + 1) if at_least(c) >= RECALL)


def _lines(dim: int, first: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Random lines number ``first`` and on, with their shifts; the same in every task."""
    directions, shifts = np.empty((many, dim)), np.empty(many)
    for k in range(many):
        source = np.random.default_rng((SEED, dim, first + k))
        directions[k], shifts[k] = source.standard_normal(dim), source.random() * CELL_WIDTH
    return directions.T, shifts


def cells(unit: np.ndarray, table: int, lines: int) -> np.ndarray:
    """Each vector's cell in a table as one 64-bit integer."""
    out = np.zeros(len(unit), np.uint64)
    if lines:
        directions, shifts = _lines(unit.shape[1], LINES + table * 64, lines)
        for column in np.floor((unit @ directions + shifts) / CELL_WIDTH).astype(np.int64).T:
            out = (out * np.uint64(0x100000001B3)) ^ (column.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out ^= out >> np.uint64(29)
    return out


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def colliding(left: np.ndarray, right: np.ndarray, threshold: float):
    """Index pairs whose projections collide often enough, a block of queries at a time."""
    directions, _ = _lines(left.shape[1], 0, LINES)
    half, least = WINDOW * math.sqrt(2 * (1 - threshold)), least_collisions()
    a, b = left @ directions, right @ directions
    orders = [np.argsort(b[:, k], kind="stable") for k in range(LINES)]
    lows = [np.searchsorted(b[o, k], a[:, k] - half, "left") for k, o in enumerate(orders)]
    highs = [np.searchsorted(b[o, k], a[:, k] + half, "right") for k, o in enumerate(orders)]
    for first in range(0, len(left), 256):
        last = min(len(left), first + 256)
        counts = np.zeros((last - first, len(right)), np.int8)
        for order, low, high in zip(orders, lows, highs, strict=True):
            for q in range(first, last):
                counts[q - first, order[low[q] : high[q]]] += 1
        x, y = np.nonzero(counts >= least)
        yield x + first, y


def _forest(nodes: int, x: np.ndarray, y: np.ndarray, parent: np.ndarray, out: list) -> None:
    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = root(i), root(j)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((i, j))


def near(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col, n_links, component_id, kept`` of every row."""
    spark = rows.sparkSession
    ship(spark)
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    if dict(own.dtypes)["v"] != "array<float>":  # which is exact in doubles, and half as large
        own = own.withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    usable = usable & F.when(F.coalesce(F.size("v"), F.lit(0)) > 0, F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))).otherwise(False)
    classes = materialize(own.where(usable).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")).withColumn("dim", F.size("v")), "classes")
    told = materialize(_meet(classes, threshold), "links")
    linked = components(told.where("b is not null").select("a", "b"))
    sums = told.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    facts = classes.select("label", "v", "rep", "weight").join(sums.withColumnRenamed("a", "rep"), "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"), "weight")
    single = own.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    joined = join_hot(own.where(usable), materialize(facts, "facts"), ["label", "v"], "weight").select("id", "n_links", "component")
    out = joined.unionByName(single)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def _meet(classes: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, n)``: rows without b tell how many vectors a's links hold, the others are a spanning forest."""
    label = dict(classes.dtypes)["label"]
    numbers = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("vectors"))
    counted = classes.join(numbers, ["label", "dim"])

    def deal(batches):
        for batch in batches:
            dims, vectors = batch.column("dim").to_numpy(), batch.column("vectors").to_numpy()
            for dim, many in {*zip(dims.tolist(), vectors.tolist(), strict=True)}:
                part = batch.filter(pa.array((dims == dim) & (vectors == many)))
                unit = _matrix(part.column("v"), dim)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                lines, tables = layout(many, threshold)
                for table in range(tables):
                    cell = cells(unit, table, lines).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c) for c in ("label", "rep")] + [pa.array([dim] * len(unit), pa.int32()), pa.array([lines] * len(unit), pa.int32()), pa.array([table] * len(unit), pa.int32()), pa.array(cell)],
                        ["label", "rep", "dim", "lines", "tab", "cell"],
                    )

    # where each vector falls, without the vector: most are alone in their cells and never dealt out
    dealt = materialize(counted.select("label", "dim", "rep", "v", "vectors").mapInArrow(deal, f"label {label}, rep long, dim int, lines int, tab int, cell long"), "cells")
    place = ["label", "dim", "tab", "cell"]
    full = dealt.groupBy(*place).agg(F.count(F.lit(1)).alias("many")).where("many > 1").withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
    # vectors alone in their cell meet nobody; blocks of a large cell meet pairwise
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.concat_ws(":", *place, F.least(j, F.col("block")), F.greatest(j, F.col("block"))))
    placed = join_hot(dealt, materialize(full, "full-cells"), place, "many").withColumn("block", block).withColumn("tasks", meets)
    # each vector goes to the tasks of all its cells at once
    by_vector = placed.groupBy("label", "rep").agg(F.collect_list(F.struct("tasks", "block", "dim", "lines", "tab")).alias("places"))
    sent = classes.select("label", "rep", "weight", "v").join(by_vector, ["label", "rep"])
    sent = sent.select("rep", "weight", "v", F.explode("places").alias("p")).select(F.explode("p.tasks").alias("task"), "p.block", "rep", "weight", "v", "p.dim", "p.lines", "p.tab")

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, lines, tab = (int(table.column(c)[0].as_py()) for c in ("dim", "lines", "tab"))
        reps, weights, block = (table.column(c).to_numpy() for c in ("rep", "weight", "block"))
        vectors = _matrix(table.column("v").chunk(0), dim)
        norms = np.linalg.norm(vectors, axis=1)
        unit = vectors / norms[:, None]
        earlier = np.stack([cells(unit, t, lines) for t in range(tab)], 1) if tab else np.zeros((len(unit), 0), np.uint64)
        low = block == block.min()
        left, right = np.flatnonzero(low), np.flatnonzero(~low if not low.all() else low)
        links, parent, forest = np.zeros(len(reps), np.int64), np.arange(len(reps)), []
        for x, y in colliding(unit[left], unit[right], threshold):
            x, y = left[x], right[y]
            if low.all():  # a block with itself: each pair once
                x, y = x[x < y], y[x < y]
            if tab:
                new = ~(earlier[x] == earlier[y]).any(1)
                x, y = x[new], y[new]
            hit = [np.empty(0, bool)]
            for at in range(0, len(x), 1 << 14):
                i, j = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
                hit.append(np.einsum("ij,ij->i", vectors[i], vectors[j]) / (norms[i] * norms[j]) >= threshold)
            hit = np.concatenate(hit)
            x, y = x[hit], y[hit]
            np.add.at(links, x, weights[y])
            np.add.at(links, y, weights[x])
            _forest(len(reps), x, y, parent, forest)
        some = np.flatnonzero(links)
        a = np.concatenate((reps[some], reps[[i for i, _ in forest]])).astype(np.int64)
        b = pa.array([None] * len(some) + reps[[j for _, j in forest]].tolist(), pa.int64())
        return pa.table([pa.array(a), b, pa.array(np.concatenate((links[some], np.zeros(len(forest), np.int64))))], ["a", "b", "n"])

    return sent.groupBy("task").applyInArrow(count, "a long, b long, n long")
