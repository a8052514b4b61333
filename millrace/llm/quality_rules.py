"""Quality rules: counts of every text, fixed rules on them, and robust multivariate outliers per language and source.

A document that passes the fixed rules has a vector of five transformed statistics
(``STATISTICS``).  For every pair of language and source the minimum covariance
determinant gives a centre and a covariance that the worst quarter of its
documents can't move; a document is rejected when its squared Mahalanobis
distance is over ``CUTOFF``.

The estimate has two deterministic starts, the medians with the quartiles' spread
and the moments of values clipped to these, each improved by ``STEPS`` steps.  A
step measures all documents, takes the nearest ``SUBSET`` of a group and counts
their moments anew; the better determinant wins, and documents within
``REWEIGHT`` of it give the final moments.  A step is one aggregation: rows are
summed by group and by distance in ``BINS`` bins a doubling, so that the nearest
part of a group is a range of bins (its last bin is taken whole) and no group is
ever gathered, however many of all documents it holds.  Statistics are whole
numbers of ``SCALE`` parts, so sums don't depend on the order of rows.

Only DataFrame functions are used.  Per document one row of counts is written and
read by the steps; a text is read once and never shuffled.

Defined results.  A null text is an empty one, with no words; it fails the rules.
A null language or source is a value like any other.  Cells of under ``LEAST``
documents that pass the rules are judged together with the other small ones of
their language, these again with those of all languages where they are too few,
and kept where even these are.  ``FLOORS`` is added to the spread, so groups whose
documents are all alike (ties, repeated rows, no symbol anywhere) have a defined
distance.  An empty table gives no rows; other columns, and clashing names, are
not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import WORD_PATTERN, join_hot, materialize, text_or_empty

#: The fixed rules (by the contract): fewest words, and most words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"

#: Parts of one in a statistic's whole number.
SCALE = 1000
#: Statistics and the spread under which a difference is none of quality (in the statistic's own unit).
STATISTICS = {"length": 0.5, "word_length": 0.1, "symbols": 0.5, "lines": 0.7, "repeats": 0.15}
D = len(STATISTICS)
#: Share of a group that an estimate rests on, and what makes its covariance that of all (chi-squared of 5 and 7 degrees).
SUBSET, SUBSET_FACTOR = 0.75, 1.4126
#: Squared distance of 97.5 % of a normal group, and the factor for it.
REWEIGHT, REWEIGHT_FACTOR = 12.8325, 1.0549
#: Squared distance over which a document goes (a normal one once in 10^12).
CUTOFF = 65.0
#: Steps from each start, bins of distances per doubling, and documents of the smallest group.
STEPS, BINS, LEAST = 5, 32, 100
#: Groups whose estimates are broadcast; of more, those of large groups are.
BROADCAST_GROUPS = 20_000

FACTORS = [(i, j) for i in range(D) for j in range(i + 1)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(words: Column) -> Column:
    """Words of an array that lie in windows of three which the array has at least twice.

    Windows are sorted with their places, so equal ones are neighbours; of the places in order each adds the words that
    the one before it doesn't cover.
    """
    size = F.size(words)
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    # beyond the end a window is null, two times
    windows = F.zip_with(F.zip_with(words, F.slice(words, F.lit(2), size), joined), F.slice(words, F.lit(3), size), joined)
    placed = lambda ws: F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def places(sorted_: Column) -> Column:
        same = F.zip_with(sorted_, F.slice(sorted_, F.lit(2), F.size(sorted_)), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull()))))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])

    none = F.lit(0).cast("long")
    several = lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws) - 1, none).otherwise(_let(_let(placed(ws), places), covered))
    return F.when(size < 4, none).otherwise(_let(windows, several))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``lang``, ``source`` and the counts of every text."""
    rows = docs.select(F.col(id_col), "lang", "source", text_or_empty(text_col).alias("text"))
    text, words = F.col("text"), F.col("words")
    rows = rows.select("*", F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)).alias("words"))
    symbols = F.when(text.rlike(f"[{SYMBOLS}]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(0)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_PATTERN))
    duplicates = _let(lines, lambda some: F.size(some) - F.size(F.array_distinct(some)))
    out = [F.size(words), F.length(F.array_join(words, "")), symbols, duplicates, _repeated_words(words)]
    return rows.select(id_col, "lang", "source", *(c.cast("long").alias(n) for c, n in zip(out, COUNTS)))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _statistics() -> list[Column]:
    """The transformed statistics as whole numbers: logarithms of length, of a word's letters, of symbols in 1,000 characters and of copied lines in 1,000 words; the root of the repeated share."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    told = [F.log(words), F.log(chars / words), F.log1p(1000 * F.col("n_symbols") / chars), F.log1p(1000 * F.col("n_dup_lines") / words), F.sqrt(F.col("n_repeat_words") / words)]
    return [F.round(SCALE * x).cast("long").alias(f"x{i}") for i, x in enumerate(told)]


def _cells(rows: DataFrame) -> DataFrame:
    """``lang_key, source_key, n, g``: the group of every language and source."""
    many = rows.groupBy("lang_key", "source_key").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < LEAST
    pooled = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("lang_key"))
    group = F.when(~small, F.concat_ws("\x00", "lang_key", "source_key")).when(pooled >= LEAST, F.col("lang_key")).otherwise("")
    return many.withColumn("g", group)


def _moments(rows: DataFrame, by: list[str], x: list[Column]) -> DataFrame:
    """Count, sums and sums of products per key."""
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(D)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("many"), *sums, *(F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i, j in FACTORS))


def _estimate(moments: DataFrame, factor: float) -> DataFrame:
    """Centre ``m``, inverse Cholesky factor ``w`` and log determinant of the covariance of ``moments``."""
    floors = [(f * SCALE) ** 2 for f in STATISTICS.values()]
    mean = {i: F.col(f"s{i}").cast("double") / F.col("many") for i in range(D)}
    keys = [c for c in moments.columns if c in ("g", "start")]
    out = moments.select(*keys, *(mean[i].alias(f"m{i}") for i in range(D)), *((factor * (F.col(f"p{i}{j}").cast("double") / F.col("many") - mean[i] * mean[j]) + (floors[i] if i == j else 0.0)).alias(f"c{i}{j}") for i, j in FACTORS))
    return _factored(out)


def _factored(out: DataFrame) -> DataFrame:
    """Turn the covariance ``c`` into ``w``, a column of the factor at a time, so that no expression nests another."""
    l = lambda i, j: F.col(f"l{i}{j}")  # noqa: E731, E741
    total = lambda terms: reduce(lambda a, b: a + b, terms)
    for j in range(D):
        left = lambda i: F.col(f"c{i}{j}") - total([l(i, k) * l(j, k) for k in range(j)]) if j else F.col(f"c{i}{j}")  # noqa: B023, E731
        # a covariance with floors is positive; the least value only guards against rounding
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(left(j), F.lit(1.0))))
        out = out.withColumns({f"l{i}{j}": left(i) / l(j, j) for i in range(j + 1, D)}) if j + 1 < D else out
    w = lambda i, j: F.col(f"w{i}{j}")
    for i in range(D):
        new = {f"w{i}{i}": 1.0 / l(i, i)}
        new |= {f"w{i}{j}": -total([l(i, k) * w(k, j) for k in range(j, i)]) / l(i, i) for j in range(i)}
        out = out.withColumns(new)
    out = out.withColumn("log_det", 2 * total([F.log(l(i, i)) for i in range(D)]))
    return out.drop(*(f"{c}{i}{j}" for c in "cl" for i, j in FACTORS))


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x`` under ``m`` and ``w``."""
    part = lambda i: reduce(lambda a, b: a + b, [F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)])
    return reduce(lambda a, b: a + b, [F.pow(part(i), F.lit(2.0)) for i in range(D)])


class _Groups:
    """The cells, and how their facts reach their rows: broadcast when they are few, else those of large cells only."""

    def __init__(self, rows: DataFrame):
        self.cells = materialize(_cells(rows), "quality-cells")
        self.few = self.cells.count() <= BROADCAST_GROUPS

    def meet(self, rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
        """Join rows with the facts of their groups, ``(g, …)`` in one or two rows each."""
        keys = ["lang_key", "source_key"]
        if self.few:
            return rows.join(F.broadcast(self.cells.join(facts, "g").drop("n")), keys, how)
        # one row a cell: what a group has twice goes in an array
        values = [c for c in facts.columns if c != "g"]
        packed = facts.groupBy("g").agg(F.sort_array(F.collect_list(F.struct(*values))).alias("_facts"))
        met = join_hot(rows, self.cells.join(packed, "g"), keys, "n", how)
        opened = F.explode_outer("_facts") if how == "left" else F.explode("_facts")
        return met.select("*", opened.alias("_fact")).select(*(c for c in met.columns if c != "_facts"), "_fact.*")


def _starts(rows: DataFrame, groups: _Groups) -> DataFrame:
    """Medians with the quartiles' spread, and the moments of values clipped to twice that spread."""
    x = [F.col(f"x{i}") for i in range(D)]
    bare = groups.meet(rows, groups.cells.select("g").distinct())
    quartiles = bare.groupBy("g").agg(*(F.percentile(x[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(D)))
    floors = [f * SCALE for f in STATISTICS.values()]
    # 1.349: the quartiles' distance in a normal distribution of spread 1
    spread = lambda i: F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(2.0)) + floors[i] ** 2)
    quartiles = materialize(quartiles.select("g", *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(D)), *(spread(i).alias(f"v{i}") for i in range(D))), "quality-quartiles")
    diagonal = [F.col(f"v{i}") * F.col(f"v{i}") if i == j else F.lit(0.0) for i, j in FACTORS]
    first = _factored(quartiles.select("g", F.lit(0).alias("start"), *(f"m{i}" for i in range(D)), *(c.alias(f"c{i}{j}") for c, (i, j) in zip(diagonal, FACTORS))))
    near = groups.meet(rows, quartiles)
    clipped = [F.round(F.least(F.greatest(x[i].cast("double"), F.col(f"m{i}") - 2 * F.col(f"v{i}")), F.col(f"m{i}") + 2 * F.col(f"v{i}"))).cast("long") for i in range(D)]
    second = _estimate(_moments(near, ["g"], clipped), 1.0).withColumn("start", F.lit(1))
    return materialize(first.unionByName(second), "quality-starts")


def _step(rows: DataFrame, groups: _Groups, facts: DataFrame) -> DataFrame:
    """The estimates of the nearest ``SUBSET`` of every group under the estimates given."""
    met = groups.meet(rows, facts).withColumn("bin", F.floor(F.log2(F.greatest(_distance(), F.lit(1e-6))) * BINS).cast("int"))
    bins = _moments(met, ["g", "start", "bin"], [F.col(f"x{i}") for i in range(D)])
    below = Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    near = bins.withColumn("below", F.coalesce(F.sum("many").over(below), F.lit(0))).withColumn("all", F.sum("many").over(Window.partitionBy("g", "start")))
    near = near.where(F.col("below") < F.ceil(F.lit(SUBSET) * F.col("all")))
    # a bin's sums are whole numbers; over bins they may need more digits
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    sums = near.groupBy("g", "start").agg(F.sum("many").alias("many"), *(exact(f"s{i}") for i in range(D)), *(exact(f"p{i}{j}") for i, j in FACTORS))
    return materialize(_estimate(sums, SUBSET_FACTOR), "quality-step")


def estimates(rows: DataFrame, groups: _Groups) -> DataFrame:
    """``g`` with centre and inverse factor of every group of ``LEAST`` rows or more."""
    facts = _starts(rows, groups)
    for _ in range(STEPS):
        facts = _step(rows, groups, facts)
    values = [c for c in facts.columns if c not in ("g", "start", "log_det")]
    best = facts.groupBy("g").agg(F.min(F.struct("log_det", "start", *values)).alias("b")).select("g", *(f"b.{c}" for c in values))
    inside = groups.meet(rows, best).where(_distance() <= REWEIGHT)
    final = _estimate(_moments(inside, ["g"], [F.col(f"x{i}") for i in range(D)]), REWEIGHT_FACTOR)
    large = groups.cells.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("g")
    return materialize(final.join(large, "g", "left_semi").drop("log_det"), "quality-estimates")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the counts, ``base_failed``, ``kept`` and the squared ``distance`` (null where there is none) of every document."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    told = materialize(counts(docs, id_col, text_col).select(F.col(id_col).alias("_id"), key("lang").alias("lang_key"), key("source").alias("source_key"), *COUNTS), "quality-counts")
    rows = told.where(~base_failed()).select("lang_key", "source_key", *_statistics())
    groups = _Groups(rows)
    final = estimates(rows, groups)
    met = groups.meet(told.select("*", *_statistics()), final, "left")
    distance = F.when(~base_failed(), _distance())
    out = met.select(F.col("_id").alias(id_col), *COUNTS, base_failed().alias("base_failed"), distance.alias("distance"))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return out.select(id_col, *COUNTS, "base_failed", kept.alias("kept"), "distance")
