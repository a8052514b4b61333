"""Dice join of two tables of any size, or of one with itself: an exact prefix-filter join, both sides dealt out.

Texts of equal word sets are one class, so copies cost a row each and no pairs.
The words of a class stand in one order for all, rarest first.  For Dice of t or
more between sets of x and y words:

* sizes: ``min / max >= t / (2 - t)``, and the common words are at least ``t / 2 * (x + y)``;
* prefix: a set of x words has a common word among its first
  ``x - ceil(x * t / (2 - t)) + 1`` with every partner, so only these words meet;
* positions: common words at the places i and j leave at most the words before
  both, itself, and the words after either;
* count: words that meet in both prefixes and those after one of them must suffice.

What passes has its common words counted.  Every step is a join or a grouping on a
word, a class or a pair; no side is broadcast but by the optimizer's own check of
its size, and words that many texts share stand last, so that few texts meet on them.

Meetings can grow with the square of a table.  Where there are more than ``PAIRS`` pairs of classes and they share a
word each on the average, a pair costs less than its meetings: classes are compared in blocks (``setblocks``), one
bounded block of the left ones after another.  Of other tables the meetings are counted first, and where they are many
the join is made in waves of the left classes, each of at most about four times the words of all prefixes (or
``MEETINGS``): a wave's pairs are written and its shuffles deleted before the next.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import similarity as S, text as T
from millrace.operators import mapside, setblocks, tokens
from millrace.packages import ship
from millrace.tables import released, written

#: Meetings of words that are joined at a time, at least.
MEETINGS = 100_000_000
#: Pairs of classes from which on they may be compared in blocks.
PAIRS = 100_000
#: A rounding must not lose a pair that just reaches the threshold.
SLACK = 1e-9


def classes(texts: DataFrame) -> DataFrame:
    """``key, set_key``: the least key of the texts with the same words, for every text that has words."""
    told = _told(texts)
    return told.select("key", "digest").join(told.groupBy("digest").agg(F.min("key").alias("set_key")), "digest").select("key", "set_key")


def _told(texts: DataFrame) -> DataFrame:
    words = mapside.spread(texts).select("key", F.array_sort(T.token_set(F.col("text"))).alias("words")).where(F.size("words") > 0)
    # normalised words have no spaces, so joined by one they are told apart
    return words.withColumn("digest", F.sha2(F.array_join("words", " ").cast("binary"), 256))


def sets(texts: DataFrame) -> DataFrame:
    """``set_key, copies, words`` of every class of texts; words are told from the bytes of many texts at a time."""
    ship(texts.sparkSession)

    def tell(batches):
        for batch in batches:
            for part in mapside.slices(batch, 512):
                words = tokens.sets(part.column("text"), ordered=True)
                some = np.flatnonzero(np.diff(words.offsets.to_numpy()))
                joined = pc.binary_join(pa.ListArray.from_arrays(words.offsets, words.values.dictionary_decode()), " ").take(pa.array(some))
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(some)), pa.array([sha256(t).digest() for t in joined.cast(pa.binary()).to_pylist()], pa.binary()), joined], ["key", "digest", "words"])

    rows = mapside.spread(texts).select("key", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    told = rows.mapInArrow(tell, f"key {dict(rows.dtypes)['key']}, digest binary, words string")
    return told.groupBy("digest").agg(F.min("key").alias("set_key"), F.count(F.lit(1)).alias("copies"), F.first("words").alias("words")).select("set_key", "copies", F.split("words", " ").alias("words"))


def _least_common(size: Column, least: float) -> Column:
    """Words that a set has in common with any partner, at least."""
    return F.greatest(F.ceil(size * (least / (2.0 - least)) - SLACK), F.lit(1))


def prefixes(tables: list[DataFrame], least: float) -> list[DataFrame]:
    """``word, key, size, place, after`` of the first words of every class of the tables, in an order that all share: rarest first.

    ``after`` is the number of words behind the prefix.
    """
    each = [t.select("set_key", F.size("words").alias("size"), F.explode("words").alias("word")) for t in tables]
    every = each[0] if len(each) == 1 else each[0].select("word").unionByName(each[1].select("word"))
    often = every.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    out = []
    for words in each:
        ordered = words.join(often, "word").groupBy("set_key", "size").agg(F.sort_array(F.collect_list(F.struct("often", "word"))).alias("ordered"))
        length = (F.col("size") - _least_common(F.col("size"), least) + 1).cast("int")
        cut = ordered.select("set_key", "size", (F.col("size") - length).alias("after"), F.slice("ordered", F.lit(1), length).alias("first"))
        out.append(cut.select("set_key", "size", "after", F.posexplode("first").alias("place", "w")).select(F.col("w.word").alias("word"), F.col("set_key").alias("key"), "size", "place", "after"))
    return out


def _pairs(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """``a_key, b_key, lex`` of the classes with Dice of ``least`` or more; of one table, each pair once and no class with itself."""
    itself = right is None
    if _dense(left, right):
        return _blocks(left, right, least)
    told = [written(t, "prefixes") for t in prefixes([left] if itself else [left, right], least)]
    a, b = (told[i if not itself else 0].select("word", *(F.col(c).alias(f"{side}_{c}") for c in ("key", "size", "place", "after"))) for i, side in enumerate("ab"))
    waves = _waves(a, b)
    released(left.sparkSession)
    if waves == 1:
        return _near(a, b, left, right, least)
    out = None
    for wave in range(waves):
        found = written(_near(a.where(F.pmod(F.xxhash64("a_key", F.lit("wave")), F.lit(waves)) == wave), b, left, right, least), "wave")
        released(found.sparkSession)
        out = found if out is None else out.unionByName(found)
    return out


def _dense(left: DataFrame, right: DataFrame | None) -> bool:
    """Whether the pairs of classes are many and fewer than those of their equal words, and words are told apart by their marks."""
    x, y = left.count(), right.count() if right is not None else 0
    pairs = x * y if right is not None else x * (x - 1) // 2
    if pairs <= min(PAIRS, MEETINGS):
        return False
    each = lambda t, *n: t.select(F.explode("words").alias("word"), *(F.lit(v).alias(c) for v, c in zip(n, "xy")))
    words = each(left, 1, 0) if right is None else each(left, 1, 0).unionByName(each(right, 0, 1))
    counts = words.groupBy(F.xxhash64("word")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), setblocks.told_apart(words).alias("apart"))
    x, y = F.col("x").cast("double"), F.col("y")
    met, apart = counts.agg(F.sum(x * (x - 1) / 2 if right is None else x * y), F.bool_and("apart")).first()
    return apart and met >= pairs


def _blocks(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """The pairs of classes, compared in blocks; those of a block are written before the next."""
    a = written(setblocks.marked(left), "marks")
    b = a if right is None else written(setblocks.marked(right), "marks")
    sizes = [(r["size"], r["count"]) for r in a.groupBy("size").count().orderBy("size").collect()]
    ratio, out = least / (2.0 - least), None
    for low, high, parts in setblocks.blocks(sizes, min(setblocks.CELLS, MEETINGS)):
        own = a.where(F.col("size").between(low, high))
        others = b.where(F.col("size").between(low if right is None else int(low * ratio), int(high / ratio) + 1))
        for part in range(parts):
            block = own if parts == 1 else own.where(F.pmod(F.xxhash64("set_key", F.lit("part")), F.lit(parts)) == part)
            found, shared = setblocks.compared(block, others, setblocks.bits(high), least, right is None)
            found = written(found, "wave")
            shared.destroy()
            out = found if out is None else out.unionByName(found)
    if right is not None:
        return out.select(F.col("x_key").alias("a_key"), F.col("y_key").alias("b_key"), F.col("x_copies").alias("a_copies"), F.col("y_copies").alias("b_copies"), "lex")
    before = F.col("x_key") < F.col("y_key")
    side = lambda c, first, second: F.when(before, F.col(f"{first}_{c}")).otherwise(F.col(f"{second}_{c}"))
    return out.select(*(side(c, *s).alias(f"{n}_{c}") for c in ("key", "copies") for n, s in (("a", "xy"), ("b", "yx"))), "lex")


def _waves(a: DataFrame, b: DataFrame) -> int:
    """In how many waves the meetings of two tables of prefixes are joined."""
    many = lambda t, name: t.groupBy("word").agg(F.count(F.lit(1)).alias(name))
    counts = many(a, "x").join(many(b, "y"), "word", "full").select(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    met, words = counts.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)), F.coalesce(F.sum(F.col("x") + F.col("y")), F.lit(0))).first()
    return max(1, -(-met // max(MEETINGS, 4 * words)))


def _near(a: DataFrame, b: DataFrame, left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """The pairs of classes that meet in their prefixes ``a`` and ``b``."""
    itself = right is None
    x, y = F.col("a_size"), F.col("b_size")
    needed = F.ceil((x + y) * (least / 2.0) - SLACK)
    sizes = F.least(x, y) >= F.greatest(x, y) * (least / (2.0 - least)) - SLACK
    reach = F.least("a_place", "b_place") + F.least(x - F.col("a_place"), y - F.col("b_place")) >= needed
    met = a.join(b, "word").where(sizes & reach & ((F.col("a_key") < F.col("b_key")) if itself else F.lit(True)))
    counted = met.groupBy("a_key", "b_key", "a_size", "b_size", "a_after", "b_after").agg(F.count(F.lit(1)).alias("common"))
    near = counted.where(F.col("common") + F.greatest("a_after", "b_after") >= needed).select("a_key", "b_key")
    words = lambda t, side: t.select(F.col("set_key").alias(f"{side}_key"), F.col("copies").alias(f"{side}_copies"), F.col("words").alias(f"{side}_words"))
    whole = near.join(words(left, "a"), "a_key").join(words(left if itself else right, "b"), "b_key")
    common = F.size(F.array_intersect("a_words", "b_words"))
    lex = S.dice(common, F.size("a_words"), F.size("b_words"))
    return whole.select("a_key", "b_key", "a_copies", "b_copies", lex.alias("lex")).where(F.col("lex") >= least)


def self_pairs(texts: DataFrame, least: float = S.DUAL) -> DataFrame:
    """``a_key, b_key, a_copies, b_copies, lex``: all pairs of different word sets of ``texts (key, text)`` with Dice of ``least`` (over 0) or more, by the least keys of their classes."""
    return _pairs(written(sets(texts), "word-sets"), None, least)


def pairs(left: DataFrame, right: DataFrame, least: float = S.DUAL) -> DataFrame:
    """``a_key, b_key, a_copies, b_copies, lex`` of the classes of two tables; equal sets have Dice 1."""
    return _pairs(written(sets(left), "word-sets"), written(sets(right), "word-sets"), least)


def search(queries: DataFrame, corpus: DataFrame, least: float = S.DUAL) -> DataFrame:
    """``q_key, c_key, lex``: what ``search.dice_threshold`` gives, for query sets as large as the corpus; every text of a class is listed."""
    of = lambda t, side, key: classes(t).select(F.col("set_key").alias(f"{side}_key"), F.col("key").alias(key))
    found = pairs(queries, corpus, least).select("a_key", "b_key", "lex")
    return found.join(of(queries, "a", "q_key"), "a_key").join(of(corpus, "b", "c_key"), "b_key").select("q_key", "c_key", "lex")
