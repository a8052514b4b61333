"""Substring deduplication: an FM-index per shard and matching statistics of streamed documents.

Shards are dealt by content, so that equal windows always meet.  Every window of
``WINDOW`` words has a minimizer, the least hash of its ``GRAM``-word grams, and
belongs to the minimizer's shard.

1. Minimizers that occur in one document only are dropped by a partial
   aggregation; the others mark candidate windows.
2. A candidate's run of windows with one minimizer is a segment.  It carries its
   words themselves, so nothing is ever decided by a hash of them: equal segments
   (by a cryptographic digest of their bytes, 128 bits) are one row with the smallest identifier, so any
   number of copies costs one row.  A minimizer with more than ``HOT`` different
   segments (the border of a passage that very many documents share) is dealt by
   window instead.
3. Each shard's segments are indexed over a dictionary of the shard's words, and
   the segments stream through the index: backward search over the wavelet matrix
   gives the matching statistic of every window up to the threshold, and the least
   identifier in its interval is the first document in which the window starts.
4. Documents remove every word that a window covers whose first document is
   smaller than they are.  Windows are judged on the input.

Hashes of words only choose minimizers: equal windows always have equal ones, and
windows that meet by a collision are told apart by their words.

Edge cases: null texts have no words; texts under ``WINDOW`` words lose nothing;
rows with a null identifier lose nothing and are nobody's earlier document; rows
that share an identifier don't remove from one another; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._shared import discard, materialize, release, ship
from .bpe import slices
from .fm_index import FMIndex
from .words import gram_hashes, word_hashes

WINDOW = 13
#: Words in the grams that minimizers are taken from.
GRAM = 6
#: Different segments of one minimizer beyond which it is dealt by window.
HOT = 2000
#: Hot minimizers that are broadcast (8 bytes each); there is one per ``HOT`` segments at most, and more are joined.
HOT_BROADCAST = 200_000
#: Words that one shard indexes, about.
SHARD = 400_000
#: Symbols of the index's table of short patterns.
TABLE = 8


def window_minimizers(words: np.ndarray, row: np.ndarray, rows: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window that lies in one row, and the window's minimizer."""
    grams = gram_hashes(words, GRAM)
    wide = window - GRAM + 1
    size = len(words) - window + 1
    if size <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least, have = grams, 1  # the least of `have` grams from each place on, by doubling
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    places = np.flatnonzero(row[:size] == row[window - 1 :])
    return places, least[places].view(np.int64)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_removed, kept_text_sha256`` as ``kept_sha256`` of every row."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    removed = _removed(rows, window)

    def whole(batches):
        for batch in slices(batches, "text"):
            words = [t.split() if t else [] for t in _octets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(map(len, words), pa.int64(), size=len(words)), pa.array([_sha(w) for w in words], pa.string())], ["id", "text_key", "n_words", "whole"])

    full = rows.mapInArrow(whole, "id long, text_key long, n_words long, whole string")
    out = full.join(removed.hint("shuffle_hash"), ["id", "text_key"], "left")
    release(spark)
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"))


def _octets(texts: pa.Array) -> list[bytes | None]:
    """The texts' UTF-8; without an argument ``bytes.split`` parts at the contract's six characters and no others."""
    return texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


class _Segments:
    """The batch's segments with an asked-for minimizer: their rows, first words, numbers of windows, minimizers and words."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        texts = batch.column("text")
        words, row, begin, end = word_hashes(texts)
        places, least = window_minimizers(words, row, batch.num_rows, window)
        own = row[places]
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (own[1:] != own[:-1])))[: len(places)]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate((starts, [len(places)])))
        hit = np.zeros(len(starts), bool)
        first = np.searchsorted(own[starts], np.arange(batch.num_rows + 1))
        asked = batch.column("minis")
        for i in range(batch.num_rows):
            a, b = first[i], first[i + 1]
            hit[a:b] = np.isin(least[starts[a:b]], asked[i].values.to_numpy())
        starts, self.sizes = starts[hit], sizes[hit]
        self.row, self.begin, self.least = own[starts], places[starts], least[starts]
        base = np.searchsorted(row, np.arange(batch.num_rows))
        self.start = (self.begin - base[self.row]).astype(np.int32)
        # all words of the batch, one space between two, and where each begins
        self.flat = b" ".join(b" ".join(t for t in _octets(texts) if t).split()) if len(starts) else b""
        self.at = np.concatenate(([0], np.cumsum(end - begin + 1)))
        self.window = window

    def words(self) -> list[bytes]:
        """Each segment's words, joined by one space."""
        a, b = self.at[self.begin], self.at[self.begin + self.sizes + self.window - 1] - 1
        return [self.flat[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def _key(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _windows(words: bytes, window: int) -> list[bytes]:
    own = words.split(b" ")
    return [b" ".join(own[i : i + window]) for i in range(len(own) - window + 1)]


def _removed(rows: DataFrame, window: int) -> DataFrame:
    """``id, text_key, n_removed, kept`` of the rows that lose words."""
    spark = rows.sparkSession

    def minimize(batches):
        for batch in slices(batches, "text", 2 << 20):
            words, row, _, _ = word_hashes(batch.column("text"))
            places, least = window_minimizers(words, row, batch.num_rows, window)
            if not len(places):
                continue
            own = row[places]
            new = np.concatenate(([True], (least[1:] != least[:-1]) | (own[1:] != own[:-1])))
            ids = batch.column("id").take(pa.array(own[new]))
            yield pa.RecordBatch.from_arrays([pa.array(least[new]), ids], ["mini", "id"])

    minis = rows.where("id is not null and text is not null").select("id", "text").mapInArrow(minimize, "mini long, id long")
    shared = materialize(minis.groupBy("mini").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("mini"), "minis")
    release(spark)
    wanted = materialize(minis.join(shared.hint("shuffle_hash"), "mini").groupBy("id").agg(F.collect_set("mini").alias("minis")), "wanted")
    release(spark)
    discard(shared)
    found = materialize(rows.join(wanted.hint("shuffle_hash"), "id"), "candidates")  # the only shuffle of all texts
    release(spark)

    def told(batches):
        for batch in slices(batches, "text", 2 << 20):
            own = _Segments(batch, window)
            words = own.words()
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own.row)), pa.array(own.least), pa.array(map(_key, words), pa.binary()), pa.array(own.sizes, pa.int64()), pa.array(words, pa.binary())], ["id", "mini", "key", "n", "words"])

    segments = found.select("id", "text", "minis").mapInArrow(told, "id long, mini long, key binary, n long, words binary")
    segments = materialize(segments.groupBy("key").agg(F.first("mini").alias("mini"), F.min("id").alias("first"), F.first("n").alias("n"), F.first("words").alias("words")), "segments")
    release(spark)
    hot = materialize(segments.groupBy("mini").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("mini"), "hot")

    def cut(batches):
        for batch in batches:
            each = [_windows(w, window) for w in batch.column("words").to_pylist()]
            flat = [w for own in each for w in own]
            yield pa.RecordBatch.from_arrays([batch.column("first").take(pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))), pa.array(map(_key, flat), pa.binary()), pa.array(flat, pa.binary())], ["first", "key", "words"])

    # a window of a hot minimizer is a segment of its own, whose minimizer is a hash of its key
    split = segments.join(hot, "mini", "left_semi").select("first", "words").mapInArrow(cut, "first long, key binary, words binary")
    split = split.groupBy("key").agg(F.min("first").alias("first"), F.first("words").alias("words"))
    pieces = segments.join(hot, "mini", "left_anti").select("mini", "key", "words", "first").unionByName(split.select(F.xxhash64("key").alias("mini"), "key", "words", "first"))
    total = segments.agg(F.coalesce(F.sum(F.col("n") + window - 1), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // SHARD))

    def match(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        parts = pc.split_pattern(table.column("words"), pattern=b" ").combine_chunks()
        sizes = np.diff(parts.offsets.to_numpy())
        ends = np.cumsum(sizes + 1)
        starts = ends - sizes - 1
        flat = np.zeros(int(ends[-1]), np.int64)
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False
        flat[inside] = parts.flatten().dictionary_encode().indices.to_numpy() + 1
        index = FMIndex(flat, np.repeat(table.column("first").to_numpy(), sizes + 1), window, TABLE)
        asked = sizes - window + 1
        places = np.repeat(starts - (np.cumsum(asked) - asked), asked) + np.arange(int(asked.sum()))
        least = index.least_owner(*index.search(places, window))
        cuts = np.concatenate(([0], np.cumsum(asked))).astype(np.int32)
        return pa.table([table.column("key").combine_chunks(), pa.ListArray.from_arrays(pa.array(cuts), pa.array(least))], ["key", "firsts"])

    matched = pieces.withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(shards))).groupBy("shard").applyInArrow(match, "key binary, firsts array<long>")
    matched = materialize(matched, "matched")
    release(spark)
    discard(segments)

    # where each segment stands; those of a hot minimizer are told window by window
    asked = found.select("id", "text_key", "text", "minis")
    many = hot.count()
    shared_hot = spark.sparkContext.broadcast(np.sort([r["mini"] for r in hot.collect()]).astype(np.int64) if many <= HOT_BROADCAST else None)
    if many <= HOT_BROADCAST:
        asked = asked.withColumn("hot", F.lit(None).cast("array<long>"))
    else:
        by_id = wanted.select("id", F.explode("minis").alias("mini")).join(hot, "mini").groupBy("id").agg(F.collect_set("mini").alias("hot"))
        asked = asked.join(by_id.hint("shuffle_hash"), "id", "left")

    def place(batches):
        everywhere = shared_hot.value
        for batch in slices(batches, "text", 2 << 20):
            own = _Segments(batch, window)
            if everywhere is not None:
                busy = np.isin(own.least, everywhere)
            else:
                by_row = [set(x or ()) for x in batch.column("hot").to_pylist()]
                busy = np.array([m in by_row[r] for r, m in zip(own.row.tolist(), own.least.tolist(), strict=True)], bool)
            row, start, keys = [], [], []
            for r, s, b, words in zip(own.row.tolist(), own.start.tolist(), busy.tolist(), own.words(), strict=True):
                each = _windows(words, window) if b else [words]
                row += [r] * len(each)
                start += range(s, s + len(each))
                keys += map(_key, each)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("text_key").take(take), pa.array(start, pa.int32()), pa.array(keys, pa.binary())], ["id", "text_key", "start", "key"])

    stands = asked.mapInArrow(place, "id long, text_key long, start int, key binary")
    stands = stands.join(matched.hint("shuffle_hash"), "key")
    # which windows of the segment start in an earlier document
    gone = stands.select("id", "text_key", F.filter(F.transform("firsts", lambda x, i: F.when(x < F.col("id"), F.col("start") + i)), lambda x: x.isNotNull()).alias("at")).where(F.size("at") > 0)
    gone = materialize(gone.groupBy("id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")), "gone")
    release(spark)
    discard(matched, wanted)

    def strip(batches):
        for batch in slices(batches, "text"):
            many, kept = [], []
            for text, at in zip(_octets(batch.column("text")), batch.column("at"), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int32)
                at = at.values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                many.append(int(covered.sum()))
                kept.append(_sha([w for w, c in zip(words, covered.tolist(), strict=True) if not c]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(many, pa.int64()), pa.array(kept, pa.string())], ["id", "text_key", "n_removed", "kept"])

    out = found.select("id", "text_key", "text").join(gone.hint("shuffle_hash"), ["id", "text_key"]).mapInArrow(strip, "id long, text_key long, n_removed long, kept string")
    out = materialize(out.dropDuplicates(["id", "text_key"]), "removed")
    discard(found, gone)
    return out
