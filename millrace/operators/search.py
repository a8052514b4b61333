"""Similarity search of many queries against a corpus, set at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import similarity as S, text as T
from millrace.operators import mapside, tokens

#: Digits of a score that count in an order, so that a tie doesn't hang on the order of a sum.
DIGITS = 12


def tokenized(df: DataFrame, prefix: str) -> DataFrame:
    """``<prefix>key, words`` of ``df (key, text)``."""
    return df.select(F.col("key").alias(f"{prefix}key"), T.token_set(F.col("text")).alias("words"))


def _dice(block: mapside.Block, words: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and queries with a common word, and twice these by all words of both."""
    own = np.diff(words.offsets.to_numpy())
    for row, query, common in block.common(words):
        yield row, query, 2.0 * common / (own[row] + block.sizes[query])


def _possible(block: mapside.Block, words: pa.ListArray, least: np.ndarray) -> np.ndarray:
    """Rows whose number of words alone lets them reach ``least``, a Dice for each query, for some query."""
    some = block.sizes > 0
    sizes, ratio = block.sizes[some], (least / (2.0 - least))[some]
    with np.errstate(divide="ignore"):
        low, high = (sizes * ratio).min(initial=np.inf), (sizes / ratio).max(initial=0.0)
    own = np.diff(words.offsets.to_numpy())
    # a rounding must not lose a row that just reaches it
    return np.flatnonzero((own >= low * (1 - 1e-9)) & (own <= high * (1 + 1e-9)))


def dice_threshold(queries: DataFrame, corpus: DataFrame, least: float = S.DUAL) -> DataFrame:
    """``q_key, c_key, lex`` of the pairs with Dice of ``least`` or more (more than 0)."""

    def score(block, rows):
        some = _possible(block, rows.column("words"), np.full(block.many, least))
        for row, query, lex in _dice(block, rows.column("words").take(pa.array(some))):
            near = lex >= least
            yield some[row[near]], query[near], lex[near]

    return mapside.scored(tokenized(mapside.spread(corpus), "c_"), tokenized(queries, "q_"), score, "lex double")


def dice_pairs(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``q_key, c_key, lex`` of every pair with a common word."""
    return dice_threshold(queries, corpus, 0.0)


def dice_topk(queries: DataFrame, corpus: DataFrame, k: int = S.TOP_INSTRUCTIONS) -> DataFrame:
    """``q_key, rank, c_key, lex``: the k best of the texts that aren't blank by Dice, 0 too, ties in corpus order."""

    def score(block, rows, floor):
        # a query without k rows yet has no least score
        some = _possible(block, rows.column("words"), np.where(np.isinf(floor), 0.0, -floor))
        for row, query, lex in _dice(block, rows.column("words").take(pa.array(some))):
            yield some[row], query, [-lex], [lex]

    texts = mapside.spread(corpus).where(F.trim("text") != "")
    few = mapside.best(tokenized(texts, "c_"), tokenized(queries, "q_"), score, k, "lex double", zeros=True)
    return top(few, "q_key", "lex", "c_key", k).select("q_key", "rank", "c_key", "lex")


def _vectors(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(F.col("key").alias(f"{prefix}key"), F.transform("v", lambda x: x.cast("double")).alias("v"))


def cosine_pairs(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``q_key, c_key, sem`` of every query against every vector (columns ``key, v``): exact, no index."""

    def score(block, rows):
        sem = block.cosines(rows.column("v"))
        row, query = np.nonzero(~np.isnan(sem))
        yield row, query, sem[row, query]

    return mapside.scored(_vectors(mapside.spread(vectors), "c_"), _vectors(queries, "q_"), score, "sem double")


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = S.TOP_INSTRUCTIONS, itself: bool = False) -> DataFrame:
    """``q_key, rank, c_key, sem``: the k nearest vectors, ties in corpus order; a query's own key only if asked for."""

    def score(block, rows, floor):
        sem = block.cosines(rows.column("v"))
        order = -np.round(sem, DIGITS)
        # without a cosine nothing compares
        stays = order <= floor
        if not itself:
            stays &= np.not_equal.outer(rows.column("c_key").to_numpy(zero_copy_only=False), block.keys.to_numpy(zero_copy_only=False))
        row, query = np.nonzero(stays)
        yield row, query, [order[row, query]], [sem[row, query]]

    few = mapside.best(_vectors(mapside.spread(vectors), "c_"), _vectors(queries, "q_"), score, k, "sem double")
    return top(few, "q_key", "sem", "c_key", k).select("q_key", "rank", "c_key", "sem")


def top(scored: DataFrame, by: str, score: str, order: str, k: int) -> DataFrame:
    """The k best rows per key, ties by ``order``; only the report's length is limited."""
    best = Window.partitionBy(by).orderBy(F.desc(F.round(score, DIGITS)), F.asc(order))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: Words that are counted by a product of matrices, at most, cells of the queries' matrix, and pairs that are counted one by one at a time.
FREQUENT, CELLS, COLUMNS = 1_024, 16_000_000, 1_024


def _meant(block: mapside.Block, vectors: pa.ListArray, labels: pa.Array, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, queries and cosine of the pairs of two vectors that ``floor`` or a flag, which needs ``DUAL``, may let pass."""
    least = np.minimum(S.DUAL, -floor) - 1e-9
    told = mapside._by_size(vectors)
    if len(told) == len(block.vectors) == 1 and told.keys() == block.vectors.keys():
        (row, own, norm), (at, other, length) = *told.values(), *block.vectors.values()
        if own.size and np.isfinite(norm).all() and np.isfinite(length).all() and norm.all() and length.all():
            dot = own @ other.T
            fresh = np.flatnonzero(np.isinf(floor[at]))
            if len(fresh) and len(row) > k:
                # a query without k rows yet needs those of this slice only that come up to its k-th
                some, shares = labels.take(pa.array(row)), dot[:, fresh] / norm[:, None]
                for i in np.flatnonzero(block.named[at[fresh]]):
                    shares[pc.match_substring(some, block.names[at[fresh[i]]]).to_numpy(zero_copy_only=False), i] = -np.inf
                least[at[fresh]] = np.minimum(S.DUAL, np.partition(shares, -k, axis=0)[-k] / length[fresh]) - 1e-9
            cell = np.flatnonzero((dot >= np.multiply.outer(norm, least[at] * length)).reshape(-1))
            i, j = cell // len(at), cell % len(at)
            return row[i], at[j], np.round(dot.reshape(-1)[cell] / (norm[i] * length[j]), DIGITS)
    sem = np.round(block.cosines(vectors), DIGITS)
    row, query = np.nonzero(sem >= least)
    return row, query, sem[row, query]


def _numbers(block: mapside.Block, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of rows that a query has, as numbers, where those of each row begin, and how many words a row has."""
    flat = words.flatten()
    at = pc.index_in(flat.dictionary, value_set=block.words).take(flat.indices)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    return at.drop_null().to_numpy(), np.concatenate(([0], np.cumsum(known)))[words.offsets.to_numpy()], np.diff(words.offsets.to_numpy())


def _shared(block: mapside.Block, numbers: tuple, row: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Dice of some pairs, their common words counted one by one."""
    lex = np.zeros(len(row))
    if not len(row):
        return lex
    number, begin, size = numbers
    of = np.zeros(len(block.words), bool)
    order = np.argsort(row, kind="stable")
    firsts = np.flatnonzero(np.diff(row[order], prepend=-1))
    for first, last in zip(firsts, [*firsts[1:], len(order)]):
        at = row[order[first]]
        own = number[begin[at] : begin[at + 1]]
        of[own] = True
        for a in range(first, last, COLUMNS):
            part = order[a : min(last, a + COLUMNS)]
            asked = query[part]
            many = block.sizes[asked].astype(np.int64)
            place = np.repeat(block.begin[asked] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            common = np.bincount(np.repeat(np.arange(len(part)), many), of[block.own[place]], len(part))
            lex[part] = np.divide(2.0 * common, size[at] + many, out=np.zeros(len(part)), where=(common > 0))
        of[own] = False
    return lex


def _bits(own: np.ndarray, row: np.ndarray, rows: int, width: int) -> np.ndarray:
    """The frequent words of rows as a matrix."""
    out, some = np.zeros((rows, width), np.float32), own < width
    out[row[some], own[some]] = 1.0
    return out


def _near(block: mapside.Block, numbers: tuple, some: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, queries and Dice of the pairs of some rows and queries whose Dice reaches the k-th of the query.

    Common words are counted for all pairs: frequent ones by a product of matrices, others by their postings.
    """
    if not len(some) or not len(asked):
        return
    width = min(FREQUENT, CELLS // block.many)
    if block.bits is None:
        block.place = np.empty(len(block.words), np.int64)
        block.place[np.argsort(-np.bincount(block.own, minlength=len(block.words)), kind="stable")] = np.arange(len(block.words))
        block.bits = _bits(block.place[block.own], np.repeat(np.arange(block.many), block.sizes), block.many, width)
    number, begin, size = numbers
    row, place = np.repeat(np.arange(len(size)), np.diff(begin)), block.place[number]
    rare = number[place >= width]
    each = block.first[rare + 1] - block.first[rare]
    posting = np.repeat(block.first[rare] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    others = np.bincount(np.repeat(row[place >= width] * block.many, each) + block.owner[posting], minlength=len(size) * block.many).reshape(-1, block.many)
    common = _bits(place, row, len(size), width)[some] @ block.bits[asked].T
    common += others[np.ix_(some, asked)]
    # a query without k rows yet has no least score
    least = np.maximum(0.0, -block.second[asked])
    every = np.add.outer(size[some], block.sizes[asked]).astype(np.float32)
    cell = np.flatnonzero((2 * common >= every * (least * (1 - 1e-5)).astype(np.float32)).reshape(-1))
    at, of = some[cell // len(asked)], asked[cell % len(asked)]
    both, own, other = common.reshape(-1)[cell].astype(np.float64), size[at], block.sizes[of]
    yield at, of, np.divide(2.0 * both, own + other, out=np.zeros(len(cell)), where=both > 0)


def precheck(submissions: DataFrame, corpus: DataFrame, k: int = S.TOP_INSTRUCTIONS) -> DataFrame:
    """The search as it is run: words and meaning against the whole corpus, merged, decided and ranked.

    ``submissions (key, text, name, v)`` and ``corpus (key, text, label, v)``: ``name`` leaves out the corpus
    rows whose label holds it (a blank one none), a null ``v`` is a text without a vector, whose meaning is
    unknown.  Returns ``q_key, rank, c_key`` with scores, flag and reason of the k first rows by flag, meaning,
    words and corpus order.  Blank texts are no part of the
    corpus, and blank submissions find nothing.
    """

    def score(block, rows, floor):
        numbers = _numbers(block, tokens.sets(rows.column("text")))
        row, query, sem = _meant(block, rows.column("v"), rows.column("label"), floor, k)
        lex = [_shared(block, numbers, row, query)]
        row, query, sem = [row], [query], [sem]
        # a pair without a meaning score stands behind all others, so it counts only for queries that have too few of these
        open_, bare = floor >= 1.0, ~rows.column("v").is_valid().to_numpy(zero_copy_only=False)
        for some, asked in ((np.arange(rows.num_rows), open_ & ~block.asked), (np.flatnonzero(bare), open_ & block.asked)):
            for at, of, share in _near(block, numbers, some, np.flatnonzero(asked)):
                row.append(at), query.append(of), lex.append(share), sem.append(np.full(len(at), np.nan))
        row, query, lex, sem = (np.concatenate(x) for x in (row, query, lex, sem))
        lex = np.round(lex, DIGITS)
        flagged = (sem >= S.MEANING) | (sem >= S.DUAL) & (lex >= S.DUAL)
        # the flag and then the meaning as one number: a flagged row's is below any other's
        order = -np.nan_to_num(sem, nan=-1.0) - 4.0 * flagged
        # texts without a vector all have one first order, so that words decide which of them pass
        stays = (order < floor[query]) | (order == floor[query]) & (-lex <= block.second[query])
        if any(block.names):
            named = np.flatnonzero(stays & block.named[query])
            labels = rows.column("label").take(pa.array(row[named])).to_pylist()
            stays[named] = [block.names[q] not in label for q, label in zip(query[named].tolist(), labels)]
        yield row[stays], query[stays], [order[stays], -lex[stays]], [lex[stays], sem[stays]]

    texts = mapside.spread(corpus).where(F.trim("text") != "")
    double = F.transform("v", lambda x: x.cast("double")).alias("v")
    # the corpus goes to the tasks as texts, which are told into words from their bytes, many at a time
    c = texts.select(F.col("key").alias("c_key"), F.lower("text").alias("text"), F.lower(F.coalesce("label", F.lit(""))).alias("label"), double)
    q = submissions.where(F.trim("text") != "").select(F.col("key").alias("q_key"), T.token_set(F.col("text")).alias("words"), F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("name"), double)
    return ranked(decided(mapside.best(c, q, score, k, "lex double, sem double")), "q_key", "c_key", k)


def _whole_percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def messages(submissions: DataFrame, hits: DataFrame, corpus_count: Column, load_notes: Column | None = None) -> DataFrame:
    """``q_key, blocked, max_similarity, meaning_ran, corpus_count, message, notes`` of every submission.

    ``hits`` are ranked and have the corpus row's ``task`` and ``trainer``; ``load_notes`` is what loading the
    corpus had to say.  A blank submission is told so; without a corpus the first note of an error is shown.
    """
    first = lambda c, when: F.min_by(c, F.when(when, F.col("rank")))
    flagged, every = F.col("flagged"), F.lit(True)
    wanted = ("task", "trainer", "lex", "sem", "block_reason")
    told = hits.groupBy("q_key").agg(
        F.bool_or("flagged").alias("blocked"), F.min_by("score", "rank").alias("max_similarity"), F.bool_or(F.col("sem").isNotNull()).alias("meaning_ran"),
        *(first(c, every).alias(f"top_{c}") for c in wanted), *(first(c, flagged).alias(f"hit_{c}") for c in wanted),
    )
    out = submissions.select(F.col("key").alias("q_key"), F.trim(F.coalesce("text", F.lit(""))).alias("text")).join(told, "q_key", "left")
    out = out.withColumn("corpus_count", corpus_count).withColumn("_load", load_notes if load_notes is not None else F.array().cast("array<string>"))
    shares = lambda p: F.concat(F.lit("words "), _whole_percent(F.col(f"{p}_lex")), F.lit(", meaning "), _whole_percent(F.coalesce(f"{p}_sem", F.lit(0.0))))
    rule = f"both {S.DUAL:.0%} or more, or meaning {S.MEANING:.0%} or more"
    reason = F.when(F.col("hit_block_reason") == "meaning", f"meaning {S.MEANING:.0%} or more").otherwise(f"words and meaning {S.DUAL:.0%} or more")
    trainer = F.coalesce(F.nullif(F.col("hit_trainer"), F.lit("")), F.lit("unknown"))
    block = F.concat(F.lit("Choose another task: the nearest existing text is "), F.col("hit_task"), F.lit(" (by "), trainer, F.lit("): "), shares("hit"), F.lit(" ("), reason, F.lit(")."))
    some, ran, blocked = F.col("top_task").isNotNull(), F.coalesce("meaning_ran", F.lit(False)), F.coalesce("blocked", F.lit(False))
    message = (
        F.when(F.col("text") == "", "There is no text to check.")
        .when(blocked, block)
        .when(some & ran, F.concat(F.lit("Nothing too near: the nearest text has "), shares("top"), F.lit(f" ({rule} is flagged).")))
        .when(some, F.concat(F.lit("Compared by words alone, as meaning was not compared: the nearest text has words "), _whole_percent(F.col("top_lex")), F.lit(".")))
        .when(F.col("corpus_count") == 0, F.concat_ws(" ", F.lit("There are no texts to compare with."), T.first_error(F.col("_load"))))
        .otherwise("Nothing was found.")
    )
    how = F.when(ran, F.concat(F.lit("Meaning was compared with "), F.col("corpus_count").cast("string"), F.lit(" texts."))).otherwise("Meaning was not compared.")
    notes = F.when((F.col("text") == "") | (F.col("corpus_count") == 0), F.col("_load")).otherwise(F.concat("_load", F.array(how, F.col("message"))))
    out = out.withColumn("message", message).withColumn("notes", notes)
    return out.select("q_key", blocked.alias("blocked"), F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"), ran.alias("meaning_ran"), "corpus_count", "message", "notes")


def decided(scored: DataFrame, lex: str = "lex", sem: str = "sem") -> DataFrame:
    """Add ``flagged, block_reason, method, score, flag_label`` to rows with both scores."""
    x, y = F.coalesce(F.col(lex), F.lit(0.0)), F.col(sem)
    out = scored.withColumn("block_reason", S.block_reason(x, y)).withColumn("flagged", F.col("block_reason") != "")
    return out.withColumn("method", S.method(x, y)).withColumn("score", S.combined(x, y)).withColumn("flag_label", S.flag_label(F.col("flagged"), F.col("block_reason")))


def ranked(hits: DataFrame, by: str, order: str, k: int = S.TOP_INSTRUCTIONS) -> DataFrame:
    """Rank by flag, then meaning (none counts as -1), then words; ties in corpus order; k rows."""
    best = Window.partitionBy(by).orderBy(F.desc("flagged"), F.desc(F.coalesce(F.col("sem"), F.lit(-1.0))), F.desc("lex"), F.asc(order))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def blocked(hits: DataFrame, by: str) -> DataFrame:
    """Per key: whether any hit is flagged, and the first-ranked score (which need not be the largest)."""
    return hits.groupBy(by).agg(F.coalesce(F.bool_or("flagged"), F.lit(False)).alias("blocked"), F.min_by("score", "rank").alias("max_similarity"), F.min(F.when(F.col("flagged"), F.col("rank"))).alias("first_flagged"))


def first_text(*choices: Column) -> Column:
    """The first choice that isn't blank, else the empty text."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in choices), F.lit(""))


def enriched(matches: DataFrame, tracker: DataFrame, corpus: DataFrame) -> DataFrame:
    """Fill ``matched_instruction`` of ``matches (key, …)`` from the tracker's, then the corpus's text."""
    out = matches.join(tracker.select("key", F.col("text").alias("_tracker")), "key", "left").join(corpus.select("key", F.col("text").alias("_corpus")), "key", "left")
    return out.withColumn("matched_instruction", first_text(F.col("matched_instruction"), F.col("_tracker"), F.col("_corpus"))).drop("_tracker", "_corpus")
