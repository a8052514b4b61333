"""Search without a shuffle of texts or vectors: a query set stands in every task, and only a task's best rows leave it.

The query side is a stated set.  It is broadcast in blocks of at most ``POSTINGS``
words and vector components, a checked size; a larger set is several blocks, each
with a pass of its own over the corpus, one after another.  The corpus is tokenised
in the JVM and scored where it lies: words are looked up in the block's postings,
vectors meet the block's matrix, a few rows at a time.  A task carries the k best
rows of every query through all its batches and lets nothing else out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from millrace.packages import ship
from millrace.tables import written

#: Words and vector components of the queries in one block (some 30 MB).
POSTINGS = 2_000_000
#: Pairs that a task scores at a time, and rows of one batch.
PAIRS, ROWS = 1_000_000, 4_096


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table out if it comes in fewer parts than there are cores; tables of many parts stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def column(table: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    whole = table.column(name).combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], whole.type)


class Block:
    """A block of queries with ``q_key`` and, as there are, ``words``, ``weights``, ``v``, ``name``, ``floor``."""

    def __init__(self, table: pa.Table):
        one = lambda c: column(table, c)
        self.keys, self.many = one("q_key"), table.num_rows
        self.floors = one("floor").to_numpy() if "floor" in table.column_names else None
        self.names = [n or "" for n in one("name").to_pylist()] if "name" in table.column_names else []
        self.named = np.array([n != "" for n in self.names], bool)
        self.vectors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        #: Queries that have a vector, and the matrix of frequent words once it is made.
        self.asked, self.bits = np.zeros(self.many, bool), None
        #: Rows of the corpus that are scored at a time.
        self.step = max(1, PAIRS // max(1, self.many)) if "v" in table.column_names else ROWS
        if "words" in table.column_names:
            words = one("words")
            sizes = np.diff(words.offsets.to_numpy())
            self.sizes, owner, coded = sizes, np.repeat(np.arange(self.many), sizes), words.flatten().dictionary_encode()
            self.own, self.begin = coded.indices.to_numpy(), np.concatenate(([0], np.cumsum(sizes)))[:-1]
            order = np.argsort(self.own, kind="stable")
            self.words, self.owner = coded.dictionary, owner[order]
            self.weights = one("weights").flatten().to_numpy()[order] if "weights" in table.column_names else None
            self.first = np.searchsorted(coded.indices.to_numpy()[order], np.arange(len(self.words) + 1))
        if "v" in table.column_names:
            self.vectors = _by_size(one("v"))
            self.asked = one("v").is_valid().to_numpy(zero_copy_only=False)

    def common(self, words: pa.ListArray, weights: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows and queries that share words, with how many, or the sum of the products of their weights; some rows at a time."""
        flat = words.flatten()
        if pa.types.is_dictionary(flat.type):  # a word is looked up once
            at = pc.index_in(flat.dictionary, value_set=self.words).take(flat.indices)
        else:
            at = pc.index_in(flat, value_set=self.words)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))[known]
        own = weights[known] if weights is not None else None
        at = at.drop_null().to_numpy()
        size = self.first[at + 1] - self.first[at]
        whole = np.concatenate([[0], np.cumsum(size)])
        ends = np.searchsorted(row, np.arange(len(words) + 1))
        first = 0
        while first < len(words):
            last = max(first + 1, int(np.searchsorted(whole[ends], whole[ends[first]] + PAIRS, "right")) - 1)
            a, b = ends[first], ends[last]
            many, base = size[a:b], whole[a:b] - whole[a]
            place = np.repeat(self.first[at[a:b]] - base, many) + np.arange(int(many.sum()))
            cell = np.repeat((row[a:b] - first) * self.many, many) + self.owner[place]
            product = None if own is None else np.repeat(own[a:b], many) * self.weights[place]
            cells = (last - first) * self.many
            if cells <= 4 * len(cell):
                total = np.bincount(cell, product, cells)
                # products of weights are over 0
                cell = np.flatnonzero(total)
                total = total[cell]
            else:
                cell, back, count = np.unique(cell, return_inverse=True, return_counts=True)
                total = count if product is None else np.bincount(back, product, len(cell))
            yield first + cell // self.many, cell % self.many, total.astype(np.float64)
            first = last

    def cosines(self, vectors: pa.ListArray) -> np.ndarray:
        """Per row and query their cosine: none (NaN) where either has no vector, 0 for empty, zero or unequally long ones."""
        out = np.full((len(vectors), self.many), np.nan)
        told, asked = vectors.is_valid().to_numpy(zero_copy_only=False), np.zeros(self.many, bool)
        for at, _, _ in self.vectors.values():
            asked[at] = True
        out[np.ix_(told, asked)] = 0.0
        for size, (row, own, norm) in _by_size(vectors).items():
            if size and size in self.vectors:
                at, other, length = self.vectors[size]
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[np.ix_(row, at)] = np.where((norm[:, None] > 0) & (length > 0), own @ other.T / (norm[:, None] * length), 0.0)
        return out


def _by_size(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, matrix and norms of the vectors of each dimension."""
    sizes = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        matrix = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), size)
        out[size] = rows, matrix, np.sqrt((matrix * matrix).sum(1))
    return out


class Best:
    """The k best rows of every query over all rows of a task.

    Rows are compared by ``orders``, of which less is better and the first counts most, then by key.  The first
    order of a query's k-th row is its ``floor``: what lies beyond it is dropped at once.  What passes waits until as
    much waits as is held, so a row is sorted a bounded number of times, and never more than k rows a query are held.
    """

    def __init__(self, k: int, many: int):
        self.k, self.floor = k, np.full(many, np.inf)
        #: The second order of a query's k-th row, which counts where the first is the floor.
        self.second = np.full(many, np.inf)
        self.held: tuple | None = None
        self.waiting: list[tuple] = []
        self.waits = 0

    def add(self, query: np.ndarray, orders: list[np.ndarray], keys: pa.Array, values: list[np.ndarray]) -> None:
        """``keys`` has a key for each place in ``query``."""
        passes = orders[0] <= self.floor[query]
        if len(orders) > 1:
            passes &= (orders[0] < self.floor[query]) | (orders[1] <= self.second[query])
        if not passes.any():
            return
        if not passes.all():
            query, orders, values, keys = query[passes], [o[passes] for o in orders], [v[passes] for v in values], keys.filter(pa.array(passes))
        self.waiting.append((query, orders, keys, values))
        self.waits += len(query)
        if self.waits >= max(PAIRS // 8, len(self.held[0]) if self.held else 0):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        parts = ([self.held] if self.held else []) + self.waiting
        self.waiting, self.waits = [], 0
        query = np.concatenate([p[0] for p in parts])
        orders = [np.concatenate(o) for o in zip(*(p[1] for p in parts))]
        values = [np.concatenate(v) for v in zip(*(p[3] for p in parts))]
        keys = pa.concat_arrays([p[2] for p in parts])
        place = pc.rank(keys, tiebreaker="dense").to_numpy()
        order = np.lexsort((place, *orders[::-1], query))
        query = query[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[nth < self.k]
        full = order[nth == self.k - 1]
        self.held = query[nth < self.k], [o[kept] for o in orders], keys.take(pa.array(kept)), [v[kept] for v in values]
        at = np.concatenate([p[0] for p in parts])[full]
        self.floor[at] = orders[0][full]
        if len(orders) > 1:
            self.second[at] = orders[1][full]

    def rows(self, block: Block, names: list[str]) -> Iterator[pa.RecordBatch]:
        """``q_key, c_key`` and the values of what is best, a part at a time."""
        self.settle()
        if not self.held:
            return
        query, _, keys, values = self.held
        for first in range(0, len(query), ROWS):
            part = slice(first, first + ROWS)
            columns = [block.keys.take(pa.array(query[part])), keys.slice(first, ROWS), *(pa.array(v[part], from_pandas=True) for v in values)]
            yield pa.RecordBatch.from_arrays(columns, ["q_key", "c_key", *names])


def _sized(queries: DataFrame) -> tuple[DataFrame, int]:
    """The query set, in so many blocks of a checked size; several are written once, with the column ``block``."""
    held = [F.coalesce(F.size(c), F.lit(0)) for c in ("words", "v") if c in queries.columns]
    total = queries.agg(F.coalesce(F.sum(sum(held, F.lit(1))), F.lit(0)).alias("n")).first()["n"]
    many = max(1, -(-total // POSTINGS))
    if many == 1:
        return queries, 1
    return written(queries.withColumn("block", F.pmod(F.xxhash64("q_key"), F.lit(many)).cast("int")), "queries", "block"), many


def _met(corpus: DataFrame, queries: DataFrame, run: Callable, fields: str) -> DataFrame:
    """What :func:`met` gives for a corpus with ``c_key``."""
    return met(corpus, queries, run, fields, dict(corpus.dtypes)["c_key"])


def met(corpus: DataFrame, queries: DataFrame, run: Callable, fields: str, key: str) -> DataFrame:
    """``run(block, batches)`` over the corpus for every block of the queries.

    One block is one lazy pass.  Of several blocks the driver holds one at a time: its pass is made and written
    before the next is read, so a query set of any size takes bounded memory everywhere.
    """
    spark = corpus.sparkSession
    ship(spark)
    schema = f"q_key {dict(queries.dtypes)['q_key']}, c_key {key}, {fields}"
    sized, many = _sized(queries)
    out = None
    for b in range(many):
        shared = spark.sparkContext.broadcast((sized if many == 1 else sized.where(F.col("block") == b).drop("block")).toArrow())

        def task(batches, shared=shared):
            block = Block(shared.value)
            if block.many:
                yield from run(block, batches)

        part = corpus.mapInArrow(task, schema)
        if many > 1:
            part = written(part, "search")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def slices(batch: pa.RecordBatch, step: int) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, step):
        # a copy of the slice, as offsets are read from its start
        yield batch.slice(first, step).take(pa.array(range(min(step, batch.num_rows - first))))


def scored(corpus: DataFrame, queries: DataFrame, score: Callable, fields: str) -> DataFrame:
    """``q_key, c_key`` and ``fields`` of the pairs that ``score(block, rows)`` gives.

    ``score`` gets a block and some rows of the corpus, and yields the rows and queries of the pairs that leave the
    task, and an array for each field.
    """
    names = [f.split()[0] for f in fields.split(", ")]

    def run(block, batches):
        for batch in batches:
            for rows in slices(batch, block.step):
                for row, query, *values in score(block, rows):
                    yield pa.RecordBatch.from_arrays([block.keys.take(pa.array(query)), rows.column("c_key").take(pa.array(row)), *(pa.array(v) for v in values)], ["q_key", "c_key", *names])

    return _met(corpus, queries, run, fields)


def best(corpus: DataFrame, queries: DataFrame, score: Callable, k: int, fields: str, zeros: bool = False) -> DataFrame:
    """``q_key, c_key`` and ``fields`` of the k best rows per query and task, of those that ``score(block, rows, floor)`` gives.

    ``score`` yields rows, queries, a list of orders (less is better) and a list of values, and may leave out what is
    beyond ``floor``.  ``zeros``: a pair that it leaves out has the order and value 0 and comes after all given ones;
    only the k first keys of a task can be among these, so no more are held.
    """
    names = [f.split()[0] for f in fields.split(", ")]

    def run(block, batches):
        top, first = Best(k, block.many), None
        for batch in batches:
            if zeros:
                keys = column(pa.Table.from_batches([batch]), "c_key")
                first = keys if first is None else pa.concat_arrays([first, keys])
                first = first.take(pc.sort_indices(first)[:k])
            for rows in slices(batch, block.step):
                block.second = top.second
                for row, query, orders, values in score(block, rows, top.floor):
                    top.add(query, orders, rows.column("c_key").take(pa.array(row)), values)
        if first is not None:
            _fill(top, block, first)
        yield from top.rows(block, names)

    return _met(corpus, queries, run, fields)


def _fill(top: Best, block: Block, first: pa.Array) -> None:
    """Give queries of fewer than k rows the first keys with a score of 0, but for those that they have."""
    top.settle()
    query, keys = (top.held[0], top.held[2]) if top.held else (np.zeros(0, np.int64), first.slice(0, 0))
    short = np.flatnonzero(np.bincount(query, minlength=block.many) < top.k)
    step = max(1, PAIRS // max(1, len(first)))
    has = pc.index_in(keys, value_set=first)
    known = has.is_valid().to_numpy(zero_copy_only=False)
    taken = np.unique(query[known] * len(first) + has.drop_null().to_numpy())
    for at in range(0, len(short), step):
        cells = (short[at : at + step, None] * len(first) + np.arange(len(first))).reshape(-1)
        cells = cells[~np.isin(cells, taken)]
        nothing = np.zeros(len(cells))
        top.add(cells // len(first), [nothing], first.take(pa.array(cells % len(first))), [nothing])
