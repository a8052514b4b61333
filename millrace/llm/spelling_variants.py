"""Spelling variant grouping: words one edit apart, and the far more frequent word that each is a variant of.

Two words are near when exactly one code point is inserted, deleted or replaced.
Such words share, besides one end of them, all positional two-letter grams that the
edit doesn't touch.  So words are dealt out by an end and joined within it:

* Of near words the shorter has m code points and either both begin with the same
  m // 2 or both end with the same m - m // 2.  A word goes to four such shards, by
  either end, as the shorter and as the longer of a pair (``WORDS`` bounds a shard;
  a larger one is dealt out once more by an end of what its words don't share, and
  so on, which loses no pair and leaves no shard that grows with the vocabulary).
* In a shard an inverted index takes from a gram and its position to the words that
  have it.  Postings are merged, a word's grams at a time, under the limits of length
  (equal or one more) and position (equal, or one more in a longer word); pairs with
  as many common grams as one edit must leave (``count filter``) are candidates, and
  candidates are compared letter by letter.

A pair that shares both ends is told in one shard only, so near words are counted
without a list of pairs: only counts and best forms per shard and word are summed.
Variants follow their forms to a last one by pointer doubling; counts grow tenfold
with every form, so a chain of forms is as long as the digits of the largest count.

Defined results.  A null text has no words; a null doc_id is empty in the checksum.
Repeated rows count as often as they occur.  Only A-Z are lower-cased, so a capital
with an accent differs from its small letter.  An empty table gives no rows; other
columns are not read.  A run of any length is a word like others.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import discard, materialize, ship

#: Runs of letters, fewest code points and occurrences of a word, and how many times as frequent a form is (fixed by the contract).
RUNS = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_TIMES, FORM_TIMES, DAMAGED_OF = 7, 2, 10, 31
#: Words of a shard beyond which it is dealt out again, and rows and gram matches that a task handles at a time.
WORDS, ROWS, MATCHES = 4096, 65_536, 2_000_000


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", harm: bool = True) -> DataFrame:
    """``word, n``: the words of all texts with their occurrences; ``harm`` deletes a code point of some runs first."""
    lowered = F.translate(F.col("run"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.filter(F.regexp_extract_all(F.col(text_col), F.lit(RUNS), F.lit(0)), lambda r: F.length(r) >= LEAST_LETTERS)).alias("run"))
    # a shorter run can't make a word, as damage only deletes
    runs = runs.select("id", lowered.alias("run"))
    if harm:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = F.col("h") % F.length("run")
        without = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
        runs = runs.select(F.when(F.col("h") % DAMAGED_OF == 0, without).otherwise(F.col("run")).alias("run"))
    counted = runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_TIMES))


def _shards(part: Column, m: Column, path: Column, parent: Column | None) -> Column:
    """The two shards of a word under one ``m``: by the first ``m // 2`` code points of ``part``, and by its last ``m - m // 2``.

    ``part`` is what the words of the shard above don't share, ``m`` its length in the shorter word.
    """
    half = F.floor(m / 2).cast("int")
    rest = (m - half).cast("int")
    begin, end = F.substring(part, F.lit(1), half), F.substring(part, F.length(part) - rest + 1, rest)
    above = [parent] if parent is not None else []
    one = lambda side, shared: F.struct(F.xxhash64(*above, m, F.lit(side), shared).alias("shard"), F.concat(path, F.lit(side)).alias("path"))
    return F.array(one("b", begin), one("e", end))


def _first(counted: DataFrame) -> DataFrame:
    """``shard, path, m, word, n``: every word in its four shards; ``m`` is the length of the shorter word of the shard's pairs."""
    size = F.length("word")
    shorter = counted.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    return shorter.select("word", "n", "m", F.explode(_shards(F.col("word"), F.col("m"), F.lit(""), None)).alias("s")).select("s.shard", "s.path", "m", "word", "n")


def bounds(path: Column, m: Column) -> tuple[Column, Column]:
    """Code points that the words of a shard share at their begin and at their end, from its path."""

    def walk(s: Column, side: Column) -> Column:
        half = F.floor(s["m"] / 2).cast("int")
        begin = side == "b"
        return F.struct(
            F.when(begin, s["m"] - half).otherwise(half).cast("int").alias("m"),
            F.when(begin, s["begin"] + half).otherwise(s["begin"]).cast("int").alias("begin"),
            F.when(begin, s["end"]).otherwise(s["end"] + s["m"] - half).cast("int").alias("end"),
        )

    start = F.struct(m.cast("int").alias("m"), F.lit(0).alias("begin"), F.lit(0).alias("end"))
    told = F.aggregate(F.filter(F.split(path, ""), lambda c: c != ""), start, walk)
    return told["begin"], told["end"]


def _again(rows: DataFrame) -> DataFrame:
    """Deal the rows of large shards out by an end of what their words don't share."""
    begin, end = bounds(F.col("path"), F.col("m"))
    rows = rows.withColumn("begin", begin).withColumn("end", end)
    part = F.substring("word", F.col("begin") + 1, F.length("word") - F.col("begin") - F.col("end"))
    deeper = rows.select("m", "word", "n", F.explode(_shards(part, F.col("m") - F.col("begin") - F.col("end"), F.col("path"), F.col("shard"))).alias("s"))
    return deeper.select("s.shard", "s.path", "m", "word", "n")


def dealt(counted: DataFrame) -> DataFrame:
    """All words in shards of at most ``WORDS`` words, or of words that share all but one code point."""
    rows = _first(counted)
    held = None
    while True:
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("many"), F.min("m").alias("m"), F.min("path").alias("path"))
        begin, end = bounds(F.col("path"), F.col("m"))
        large = materialize(sizes.where((F.col("many") > WORDS) & (F.col("m") - begin - end > 1)).select("shard"), "variants-large")
        if large.isEmpty():
            return rows if held is None else held.unionByName(rows)
        small = rows.join(large, "shard", "left_anti")
        held = small if held is None else held.unionByName(small)
        rows = materialize(_again(rows.join(large, "shard", "left_semi")), "variants-dealt")


def _letters(texts: list[str], size: int) -> np.ndarray:
    """Code points of texts of one length, a row each."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), size)


def _sides(path: str, m: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Shared code points at the begin and end of a shard's words, and what a pair that is told elsewhere shares too.

    A pair belongs to the first end that it shares: in a shard by the end, pairs whose begins agree as well are left out.
    """
    begin = end = 0
    elsewhere = []
    for side in path:
        left = m - begin - end
        if side == "b":
            begin += left // 2
        else:
            elsewhere.append((begin, left // 2))
            end += left - left // 2
    return begin, end, elsewhere


def _candidates(small: np.ndarray, large: np.ndarray, owner: np.ndarray, other: np.ndarray, longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``small`` and ``large`` in one shard with enough common positional grams.

    ``small`` and ``large`` are the unshared letters with the letter or end on either side; ``owner`` and ``other`` are their shards.
    """
    grams = lambda x: x[:, :-1].astype(np.uint64) << np.uint64(9) | x[:, 1:]
    places = small.shape[1] - 1

    def keyed(x, shards, shift):
        at = np.arange(x.shape[1] - 1) - shift
        kept = (at >= 0) & (at < places)
        key = (shards.astype(np.uint64)[:, None] * np.uint64(places) + at[kept].astype(np.uint64)) << np.uint64(18) | grams(x)[:, kept]
        return key.reshape(-1), np.repeat(np.arange(len(x)), int(kept.sum()))

    # a replaced letter is in two grams; an inserted one parts one gram of the shorter word
    least = places - (1 if longer else 2)
    if least < 1:
        # words that share all but one letter, as many as there are letters: nothing is left to count
        keyed = lambda x, shards, shift: (shards.astype(np.uint64), np.arange(len(x)))
        least = 1
    key, word = keyed(small, owner, 0)
    order = np.argsort(key, kind="stable")
    key, word = key[order], word[order]
    asked = [keyed(large, other, shift) for shift in ((0, 1) if longer else (0,))]
    ask, query = (np.concatenate(c) for c in zip(*asked))
    order = np.argsort(query, kind="stable")
    ask, query = ask[order], query[order]
    first, last = np.searchsorted(key, ask), np.searchsorted(key, ask, "right")
    size = last - first
    whole = np.concatenate([[0], np.cumsum(size)])
    starts = np.searchsorted(query, np.arange(len(large) + 1))
    at = 0
    while at < len(large):
        # so many words' postings are merged at a time
        to = max(at + 1, int(np.searchsorted(whole[starts], whole[starts[at]] + MATCHES, "right")) - 1)
        a, b = starts[at], starts[to]
        many = size[a:b]
        posting = np.repeat(first[a:b] - (whole[a:b] - whole[a]), many) + np.arange(int(many.sum()))
        pair, common = np.unique(np.repeat(query[a:b], many) * len(small) + word[posting], return_counts=True)
        pair = pair[common >= least]
        yield pair % len(small), pair // len(small)
        at = to


def _pairs(texts: list[str], shards: np.ndarray, m: int, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near words ``(shorter, longer)`` as places in ``texts``, of the shards of one ``m`` and path."""
    begin, end, elsewhere = _sides(path, m)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    short = np.flatnonzero(sizes == m)
    if not len(short):
        return
    whole = _letters([texts[i] for i in short], m)
    # one letter of the shared ends beside the rest, or the text's own end
    padded = lambda x: np.pad(x, ((0, 0), (1, 1)))[:, begin : x.shape[1] + 2 - end]
    for size in (m, m + 1):
        long = np.flatnonzero(sizes == size)
        if not len(long):
            continue
        other = whole if size == m else _letters([texts[i] for i in long], size)
        for a, b in _candidates(padded(whole), padded(other), shards[short], shards[long], size > m):
            if size == m:
                a, b = a[a < b], b[a < b]
            step = max(1, MATCHES // size)
            for part in range(0, len(a), step):
                i, j = a[part : part + step], b[part : part + step]
                x, y = whole[i], other[j]
                if size == m:
                    near = (x != y).sum(1) == 1
                else:
                    head = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(1)
                    tail = np.logical_and.accumulate(x[:, ::-1] == y[:, :0:-1], axis=1).sum(1)
                    near = head + tail >= m
                # equal hashes of different ends are no shard
                near &= (x[:, :begin] == y[:, :begin]).all(1) & (x[:, m - end :] == y[:, size - end :]).all(1)
                for at, many in elsewhere:
                    near &= ~(x[:, at : at + many] == y[:, at : at + many]).all(1)
                yield short[i[near]], long[j[near]]


def _tell(words_: list[str], times: np.ndarray, shards: np.ndarray, m: np.ndarray, paths: list[str]) -> pa.RecordBatch:
    """Near words counted, and the best of them, per word of whole shards; words without any are left out."""
    kinds: dict[tuple[int, str], list[int]] = {}
    same = np.concatenate([[0], np.cumsum(shards[1:] != shards[:-1])])
    crowd = np.bincount(same)[same] > 1
    for i in np.flatnonzero(crowd).tolist():
        kinds.setdefault((int(m[i]), paths[i]), []).append(i)
    ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for (size, path), rows in kinds.items():
        rows = np.array(rows)
        for a, b in _pairs([words_[i] for i in rows.tolist()], same[rows], size, path):
            ones += [rows[a], rows[b]]
            others += [rows[b], rows[a]]
    one, other = np.concatenate(ones), np.concatenate(others)
    place = np.empty(len(words_), np.int64)
    place[sorted(range(len(words_)), key=words_.__getitem__)] = np.arange(len(words_))
    order = np.lexsort((place[other], -times[other], one))
    told, first, many = np.unique(one[order], return_index=True, return_counts=True)
    best = other[order][first]
    out = [pa.array([words_[i] for i in told.tolist()], pa.string()), pa.array(many, pa.int64()), pa.array(times[best], pa.int64()), pa.array([words_[i] for i in best.tolist()], pa.string())]
    return pa.RecordBatch.from_arrays(out, ["word", "n_near", "best_n", "best"])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join shard by shard; rows come sorted by shard, and only an open shard waits for its end."""
    held: list[pa.RecordBatch] = []

    def told(table: pa.Table):
        column = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        return _tell(table.column("word").to_pylist(), column("n"), column("shard"), column("m"), table.column("path").to_pylist())

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        shards = table.column("shard").to_numpy()
        last = int(np.searchsorted(shards, shards[-1]))
        if last:
            yield told(table.slice(0, last))
        held = table.slice(last).to_batches()
    if held:
        yield told(pa.Table.from_batches(held).combine_chunks())


def near(counted: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of the words that have near words; ``best`` is the most frequent, ties by code points."""
    ship(counted.sparkSession)
    rows = dealt(counted).repartition("shard").sortWithinPartitions("shard")
    parts = rows.mapInArrow(_join, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best")))
    told = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return told.select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms (word, form)``: every round doubles the steps taken, until none is left."""
    told = materialize(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        further = told.select(F.col("word").alias("_at"), F.col("root").alias("_further"))
        met = told.join(further, F.col("root") == F.col("_at"), "left")
        new = materialize(met.select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")), "variants-roots")
        if new.where("moved").isEmpty():
            return told
        discard(told)
        told = new.select("word", "root")
        told._millrace_path = new._millrace_path


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", harm: bool = True) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of the texts."""
    counted = materialize(words(docs, id_col, text_col, harm), "variants-words")
    found = near(counted).join(counted, "word")
    fits = F.col("best_n") >= FORM_TIMES * F.col("n")
    found = materialize(found.select("word", "n_near", F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "variants-near")
    last = roots(found.where(F.col("form").isNotNull()))
    out = counted.join(found.join(last, "word", "left"), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
