"""Exact cosine top-k of all vectors against all: pivots, rings and the triangle inequality.

Vectors of length one are as near as their cosine is large, and their distances obey
the triangle inequality.  A vector belongs to its nearest pivot, and there to a ring
by its distance from it.  No vector of a ring is nearer to a query than the query's
distance from the pivot leaves it.  A query first meets one cell of about ``CELL``
vectors of each of the few rings that may be nearest, until these hold ``AHEAD`` times
k vectors; the k-th distance found is its floor, and what it met is dropped.

Then the queries are broadcast in blocks of a checked size (``mapside.POSTINGS``), one
after another, and the vectors, written once in the order of their rings, are compared
where they lie: of a block only those queries meet a piece of a ring whose bound is
within their floor, and only what reaches the floor leaves a task, k rows a query at
most.  So no vector is copied for a ring that it meets, and disk follows the input; the
time of the exact job grows with the square of it where the bounds spare little.

The pivots are a fixed number of vectors and the rings' facts a bounded table, so
both are broadcast.

The rows are those of ``search.cosine_topk``: null vectors have no cosine; empty
and zero vectors, vectors with a part that isn't finite, and vectors of different
lengths have the cosine 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from millrace.functions.similarity import TOP_INSTRUCTIONS
from millrace.operators import mapside
from millrace.operators.search import DIGITS, top
from millrace.packages import ship
from millrace.tables import written

#: Pivots, rings for a distance of one, vectors of a cell, queries of a chunk, and how many times k vectors are met first.
PIVOTS, RINGS, CELL, CHUNK, AHEAD = 256, 32, 4096, 65_536, 4
#: Distances are compared with this to spare, as cosines are rounded.
SLACK = 1e-6


def _matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _by_kind(kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for k in np.unique(kind).tolist():
        yield k, np.flatnonzero(kind == k)


def _units(vectors: DataFrame) -> DataFrame:
    """``key, kind, v``: vectors of length one and their number of parts, or kind 0 for those whose cosine is 0 with all."""
    told = vectors.where(F.col("v").isNotNull()).select("key", F.transform("v", lambda x: x.cast("double")).alias("v"))
    told = told.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(float("nan"))))))
    usable = (F.col("norm") > 0) & ~F.isnan("norm") & (F.col("norm") < float("inf"))
    unit = F.transform("v", lambda x: x / F.col("norm"))
    return told.select("key", F.when(usable, F.size("v")).otherwise(0).alias("kind"), F.when(usable, unit).otherwise(F.array().cast("array<double>")).alias("v"))


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (v @ pivots.T), 0.0))


class _Pivots:
    """The pivots by kind: their numbers and a matrix."""

    def __init__(self, table: pa.Table):
        kind = mapside.column(table, "kind").to_numpy()
        v = mapside.column(table, "v")
        self.of = {k: (at, _matrix(v.take(pa.array(at)))) for k, at in _by_kind(kind)}


def _placed(units: DataFrame) -> tuple[DataFrame, _Pivots]:
    """``key, kind, v, pivot, near``: every usable vector with its nearest pivot (-1 where its kind has none) and the distance from it."""
    usable = units.where("kind > 0")
    chosen = _Pivots(usable.orderBy(F.xxhash64("key", "v"), "key").limit(PIVOTS).select("kind", "v").toArrow())
    shared = units.sparkSession.sparkContext.broadcast(chosen)

    def place(batches):
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            pivot, near = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for k, rows in _by_kind(kind):
                if k in shared.value.of:
                    number, matrix = shared.value.of[k]
                    d = _distances(_matrix(batch.column("v").take(pa.array(rows))), matrix)
                    pivot[rows], near[rows] = number[d.argmin(1)], d.min(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "kind", "v")), pa.array(pivot), pa.array(near)], ["key", "kind", "v", "pivot", "near"])

    key = dict(units.dtypes)["key"]
    return mapside.spread(usable).mapInArrow(place, f"key {key}, kind int, v array<double>, pivot int, near double"), chosen


class _Rings:
    """The facts of all rings, at most some hundred for every pivot."""

    def __init__(self, table: pa.Table):
        columns = {c: mapside.column(table, c).to_numpy() for c in ("kind", "pivot", "ring", "low", "high", "many", "cells")}
        self.of = {k: {c: x[at] for c, x in columns.items()} for k, at in _by_kind(columns["kind"])}


def _visits(rows: DataFrame, pivots: _Pivots, rings: _Rings, k: int, first: bool) -> DataFrame:
    """``q_key, kind, v, pivot, ring, cells``: the rings that a vector meets first, or all under its ``floor``."""
    shared = rows.sparkSession.sparkContext.broadcast((pivots, rings))

    def bounds(kind: int, v: np.ndarray) -> np.ndarray:
        own, facts = shared.value[0].of.get(kind), shared.value[1].of[kind]
        out = np.zeros((len(v), len(facts["ring"])))
        if own:
            at = np.searchsorted(own[0], facts["pivot"])
            known = facts["pivot"] >= 0
            d = _distances(v, own[1])[:, at[known]]
            out[:, known] = np.maximum(np.maximum(d - facts["high"][known], facts["low"][known] - d), 0.0)
        return out

    def visit(batches):
        for batch in batches:
            kind, v = batch.column("kind").to_numpy(), batch.column("v")
            for number, rows in _by_kind(kind):
                facts = shared.value[1].of[number]
                step = max(1, mapside.PAIRS // len(facts["ring"]))
                for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                    bound = bounds(number, _matrix(v.take(pa.array(part))))
                    order = np.argsort(bound, axis=1, kind="stable")
                    met = np.cumsum(facts["many"][order], axis=1)
                    ahead = np.zeros(bound.shape, bool)
                    np.put_along_axis(ahead, order, np.concatenate((np.ones((len(part), 1), bool), met[:, :-1] < AHEAD * k + 1), axis=1), 1)
                    wanted = ahead if first else (bound <= batch.column("floor").take(pa.array(part)).to_numpy(zero_copy_only=False)[:, None] + SLACK)
                    row, ring = np.nonzero(wanted)
                    at = pa.array(part[row])
                    for i in range(0, len(row), mapside.ROWS):
                        here, own = at.slice(i, mapside.ROWS), ring[i : i + mapside.ROWS]
                        yield pa.RecordBatch.from_arrays([batch.column("key").take(here), batch.column("kind").take(here), v.take(here), *(pa.array(facts[c][own]) for c in ("pivot", "ring", "cells"))], ["q_key", "kind", "v", "pivot", "ring", "cells"])

    return rows.mapInArrow(visit, f"q_key {dict(rows.dtypes)['key']}, kind int, v array<double>, pivot int, ring int, cells int")


def _compared(visits: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``q_key, c_key, sem``: the k nearest of one cell of every ring that a query meets, without itself."""
    place = ["kind", "pivot", "ring", "cell"]
    asked = visits.withColumn("cell", F.pmod(F.xxhash64("q_key"), F.col("cells")).cast("int")).drop("cells")
    chunks = asked.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    of = lambda rows, key: rows.select(F.col(key).alias("key"), "v", *place, "chunks")
    queries = of(asked.join(chunks, place), "q_key").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).withColumn("asks", F.lit(True))
    held = of(members.join(chunks, place), "key").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asks", F.lit(False))
    where = [*place, "chunk"]
    mixed = held.unionByName(queries).repartition(*where).sortWithinPartitions(*where, "asks", "key")

    def compare(batches):
        cell, keys, parts, matrix = None, [], [], None
        for batch in batches:
            spot = np.stack([batch.column(c).to_numpy() for c in where], 1)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((spot[1:] != spot[:-1]).any(1) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if cell is None or (spot[a] != cell).any():
                    cell, keys, parts, matrix = spot[a], [], [], None
                own, v = batch.column("key").slice(a, b - a), _matrix(batch.column("v").slice(a, b - a).take(pa.array(range(b - a))))
                if not asks[a]:
                    keys.append(own), parts.append(v)
                    continue
                if not parts:  # by the hash a cell may be empty
                    continue
                if matrix is None:
                    matrix, names = np.concatenate(parts), pa.concat_arrays(keys)
                for i in range(0, len(v), max(1, mapside.PAIRS // len(matrix))):
                    part = v[i : i + max(1, mapside.PAIRS // len(matrix))]
                    sem = part @ matrix.T
                    asking = own.slice(i, len(part))
                    itself = pc.index_in(asking, value_set=names)
                    known = itself.is_valid().to_numpy(zero_copy_only=False)
                    order = -np.round(sem, DIGITS)
                    order[np.flatnonzero(known), itself.drop_null().to_numpy()] = np.inf
                    best = np.argsort(order, axis=1, kind="stable")[:, :k]  # a cell's keys are in order
                    row = np.repeat(np.arange(len(part)), best.shape[1])
                    best = best.reshape(-1)
                    stays = ~np.isinf(order[row, best])
                    row, best = row[stays], best[stays]
                    yield pa.RecordBatch.from_arrays([asking.take(pa.array(row)), names.take(pa.array(best)), pa.array(np.clip(sem[row, best], -1.0, 1.0))], ["q_key", "c_key", "sem"])

    key = dict(members.dtypes)["key"]
    return mixed.mapInArrow(compare, f"q_key {key}, c_key {key}, sem double")


def _within(members: DataFrame, asked: DataFrame, pivots: _Pivots, k: int) -> DataFrame:
    """``q_key, c_key, sem``: of every task the k nearest within a query's ``floor``, without itself."""
    shared = members.sparkSession.sparkContext.broadcast(pivots)

    def run(block, batches):
        best, limit = mapside.Best(k, block.many), block.floors
        # the least cosine that counts, with what rounding may take
        best.floor = np.where(limit < 2.0, limit * limit / 2.0 - 1.0 + SLACK, np.inf)
        last, d = None, {}
        for batch in batches:
            kind, pivot, ring, near = (batch.column(c).to_numpy() for c in ("kind", "pivot", "ring", "near"))
            spot = np.stack([kind, pivot, ring], 1)
            cuts = [0, *(np.flatnonzero((spot[1:] != spot[:-1]).any(1)) + 1).tolist(), len(spot)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b or kind[a] not in block.vectors:
                    continue
                at, queries, _ = block.vectors[kind[a]]
                if last != (kind[a], pivot[a]):
                    last, own = (kind[a], pivot[a]), shared.value.of.get(kind[a])
                    d = _distances(queries, own[1][own[0] == pivot[a]])[:, 0] if own and pivot[a] >= 0 else None
                step = max(1, mapside.PAIRS // len(at))
                for i in range(a, b, step):
                    j = min(b, i + step)
                    v = _matrix(batch.column("v").slice(i, j - i).take(pa.array(range(j - i))))
                    some = np.arange(len(at)) if d is None else np.flatnonzero(np.maximum(d - near[i:j].max(), near[i:j].min() - d) <= limit[at] + SLACK)
                    if not len(some):
                        continue
                    sem = v @ (queries if len(some) == len(at) else queries[some]).T
                    row, found = np.nonzero(-sem <= best.floor[at[some]] + SLACK)
                    sem, query = sem[row, found], at[some[found]]
                    keys = batch.column("c_key").take(pa.array(row + i))
                    others = pc.not_equal(keys, block.keys.take(pa.array(query))).to_numpy(zero_copy_only=False)
                    best.add(query[others], [-np.round(sem[others], DIGITS)], keys.filter(pa.array(others)), [np.clip(sem[others], -1.0, 1.0)])
        yield from best.rows(block, ["sem"])

    return mapside._met(members, asked, run, "sem double")


class AllNearest:
    """The steps of one join: ``first`` rows, which give floors, ``later`` rows, which are the result, ``rings`` and what is visited of them."""

    def __init__(self, vectors: DataFrame, k: int = TOP_INSTRUCTIONS):
        spark = vectors.sparkSession
        ship(spark)
        self.k = k
        self.units = written(_units(vectors), "units")
        placed, pivots = _placed(self.units)
        ring = F.floor(F.col("near") * RINGS).cast("int")
        placed = written(placed.withColumn("ring", ring), "placed")
        place = ["kind", "pivot", "ring"]
        cells = F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells")
        facts = placed.groupBy(*place).agg(F.min("near").alias("low"), F.max("near").alias("high"), F.count(F.lit(1)).alias("many"), cells)
        self.rings = written(facts, "rings")
        rings = _Rings(self.rings.toArrow())  # PIVOTS times twice RINGS rows at most, and one for each length without a pivot
        members = placed.join(F.broadcast(self.rings.select(*place, "cells")), place).withColumn("cell", F.pmod(F.xxhash64("key", F.lit(1)), F.col("cells")).cast("int"))
        many = max(placed.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
        members = members.select("key", "v", *place, "cell", "near").repartitionByRange(many, *place, "key").sortWithinPartitions(*place, "key")
        members = written(members, "members")
        visits = _visits(placed.select("key", "kind", "v"), pivots, rings, k, True)
        self.first = written(_compared(visits, members, k), "first")
        floors = top(self.first, "q_key", "sem", "c_key", k).where(F.col("rank") == k).select(F.col("q_key").alias("key"), F.sqrt(2.0 - 2.0 * F.col("sem")).alias("floor"))
        asked = written(placed.select("key", "kind", "v").join(floors, "key", "left").withColumn("floor", F.coalesce("floor", F.lit(3.0))), "asked")
        #: What is met first, and later; only told apart by :meth:`compared`.
        self.visits = [visits, _visits(asked, pivots, rings, k, False)]
        self.later = _within(members.withColumnRenamed("key", "c_key").drop("cell"), asked.select(F.col("key").alias("q_key"), "v", "floor"), pivots, k)

    def _nothing(self) -> DataFrame:
        """``q_key, c_key, sem`` with the cosine 0: of every other kind the first keys are enough, k and one more."""
        keys = self.units.select("key", "kind")
        kinds = [r.kind for r in keys.select("kind").distinct().collect()]
        out = None
        for kind in kinds:
            # lengths are few; a vector of kind 0 has the cosine 0 with all others
            first = keys.where(F.lit(kind == 0) | (F.col("kind") != kind)).select(F.col("key").alias("c_key")).orderBy("c_key").limit(self.k + 1)
            pairs = keys.where(F.col("kind") == kind).select(F.col("key").alias("q_key")).crossJoin(F.broadcast(first)).where(F.col("q_key") != F.col("c_key"))
            out = pairs if out is None else out.unionByName(pairs)
        return out.withColumn("sem", F.lit(0.0)) if out is not None else self.first.limit(0)

    def top(self) -> DataFrame:
        """``q_key, rank, c_key, sem``: the k nearest of every vector, ties in the order of keys."""
        return top(self.later.unionByName(self._nothing()), "q_key", "sem", "c_key", self.k).select("q_key", "rank", "c_key", "sem")

    def compared(self) -> DataFrame:
        """``vectors, pairs, met``: how many pairs there are, and how many were compared."""
        place = ["kind", "pivot", "ring"]
        met = None
        for visits in self.visits:
            part = visits.join(F.broadcast(self.rings.select(*place, "many")), place).select("many")
            met = part if met is None else met.unionByName(part)
        sizes = self.rings.groupBy("kind").agg(F.sum("many").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("pairs"))
        return sizes.crossJoin(met.agg(F.coalesce(F.sum("many"), F.lit(0)).alias("met")))  # one row each


def all_topk(vectors: DataFrame, k: int = TOP_INSTRUCTIONS) -> DataFrame:
    """``q_key, rank, c_key, sem``: the k nearest vectors of every one of ``vectors (key, v)``, keys being unique."""
    return AllNearest(vectors, k).top()
