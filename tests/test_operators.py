"""Golden values of the reference's operators, and the traps that its semantics hold."""

import io
import json
import zipfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.functions import similarity as S, text as T
from millrace.operators import gates, gramindex, mapside, nearest, report, rules, search, setjoin, tfidf, verdicts
from millrace.plans import fixtures
from millrace.sources import bundles, cache, options, sheets, vectors
from millrace.streaming import submissions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, norm, dice", [("Hello,  World!", "hello world", "hello world", 1.0), ("a b c", "b c d", "a b c", 4 / 6), ("a a a b", "a b", "a a a b", 1.0), ("élan x_y", "lan x y", "lan x y", 1.0), ("中文", "中文", "", 0.0), ("x", "", "x", 0.0)])
def test_normalise_and_dice(spark, a, b, norm, dice):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.normalize(F.col("a")).alias("n"), T.token_set(F.col("a")).alias("x"), T.token_set(F.col("b")).alias("y"))
    row = row.withColumn("d", S.dice(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).first()
    assert (row["n"], row["d"]) == (norm, dice)


def test_decisions(spark):
    rows = {r["id"]: (r["flagged"], r["block_reason"], r["method"]) for r in search.decided(fixtures.frame(spark, "scores")).collect()}
    assert rows[1] == (True, "dual", "dual-60") and rows[2] == (True, "dual", "dual-60") and rows[3] == (True, "meaning", "meaning-70")
    assert rows[4] == (False, "", "semantic-high") and rows[5] == (False, "", "lexical-only") and rows[6] == (False, "", "below-threshold")
    assert rows[7] == (False, "", "lexical-only"), "without a meaning score nothing is flagged, even at full word overlap"


def test_ranking_is_stable_and_max_similarity_is_the_first_rows(spark):
    hits = search.ranked(fixtures.frame(spark, "hits"), "q_key", "ord")
    assert [r["ord"] for r in hits.where("q_key = 1").orderBy("rank").collect()] == [1, 0, 3, 2]
    assert search.blocked(hits, "q_key").where("q_key = 1").first()["max_similarity"] == 0.71


def test_dice_topk_fills_up_with_zero_scores(spark):
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "gamma", "beta", "", "delta"])], "key long, text string")
    queries = spark.createDataFrame([(7, "beta"), (8, "zzz"), (9, None)], "key long, text string")
    rows = {}
    for r in search.dice_topk(queries, corpus, 3).orderBy("q_key", "rank").collect():
        rows.setdefault(r["q_key"], []).append((r["c_key"], round(r["lex"], 3)))
    assert rows == {7: [(2, 1.0), (0, 0.667), (1, 0.0)], 8: [(0, 0.0), (1, 0.0), (2, 0.0)], 9: [(0, 0.0), (1, 0.0), (2, 0.0)]}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab cé1", max_size=12), min_size=2, max_size=4))
def test_dice_is_symmetric_and_bounded(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    pairs = {(r["q_key"], r["c_key"]): r["lex"] for r in search.dice_pairs(rows, rows).collect()}
    for (a, b), x in pairs.items():
        assert 0 < x <= 1 and pairs[b, a] == x and (a != b or x == 1)


def test_cosine_guards(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0]), (3, []), (4, [2.0, 0.0]), (5, None)], "key long, v array<double>")
    got = {r["c_key"]: r["sem"] for r in search.cosine_pairs(rows.where("key = 0"), rows).collect()}
    assert {k: got[k] for k in (0, 1, 2, 3, 4)} == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}



@pytest.mark.parametrize("postings, pairs", [(mapside.POSTINGS, 7), (40, mapside.PAIRS)])
def test_blocks_of_queries_give_the_same(spark, monkeypatch, postings, pairs):
    rows = spark.createDataFrame([(i, [float(i), 1.0, 2.0], f"w{i % 5} w{i % 3} x") for i in range(20)], "key long, v array<double>, text string")
    found = lambda: [sorted(map(tuple, f(rows, rows).collect())) for f in (search.cosine_pairs, search.dice_pairs, search.dice_topk, tfidf.topk)]
    plain = found()
    monkeypatch.setattr(mapside, "POSTINGS", postings), monkeypatch.setattr(mapside, "PAIRS", pairs)
    assert found() == plain


@pytest.mark.parametrize("batch", [3, 10_000])
def test_only_the_best_rows_leave_a_task(spark, monkeypatch, batch):
    """However many batches a task has, and however many queries: k rows a query, which hold the task's own k best."""
    rows = spark.range(4000, numPartitions=8).select(F.col("id").alias("key"), F.concat_ws(" ", *(F.concat(F.lit("w"), (F.xxhash64("id", F.lit(i)) % 11).cast("string")) for i in range(5))).alias("text"), F.array((F.col("id") % 13).cast("double"), F.lit(1.0)).alias("v"))
    few = rows.where("key < 200").coalesce(1)
    left = []
    kept = mapside._met

    def seen(*told):
        left.append(kept(*told))
        return left[-1]

    monkeypatch.setattr(mapside, "_met", seen)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        search.dice_topk(few, rows, 4), search.cosine_topk(few, rows, 4), tfidf.topk(few, rows, 4)
        many = [[tuple(r) for r in f.withColumn("task", F.spark_partition_id()).groupBy("task", "q_key").count().collect()] for f in left]
        told = [sorted(map(tuple, f.collect()), key=repr) for f in left]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(n <= 4 for f in many for _, _, n in f) and all(len(f) == 1600 for f in many)
    every = [(q, c, s) for q, c, s in map(tuple, search.dice_pairs(few, rows).collect())]
    best = {}
    for q, c, s in sorted(every, key=lambda r: (r[0], -r[2], r[1])):
        best.setdefault((q, c // 500), []).append((q, c, s))
    assert told[0] == sorted((r for b in best.values() for r in b[:4]), key=repr)


def test_words_are_a_floor_where_meaning_is_unknown(monkeypatch):
    """Rows without a vector have one first order; those beyond the k-th by words are dropped at once."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(mapside, "PAIRS", 80)
    best, sorted_rows, of = mapside.Best(3, 1), [], np.random.default_rng(1)
    settle = best.settle
    monkeypatch.setattr(best, "settle", lambda: sorted_rows.append(best.waits) or settle())
    lex = of.integers(0, 1000, (50, 100))
    for i, part in enumerate(lex):
        best.add(np.zeros(100, np.int64), [np.ones(100), -part.astype(float)], pa.array(range(i * 100, i * 100 + 100)), [part])
    best.settle()
    told = sorted(((-x, i) for i, x in enumerate(lex.reshape(-1))))[:3]
    assert [(-v, k) for v, k in zip(best.held[3][0], best.held[2].to_pylist())] == told
    assert sum(sorted_rows) < 1000


def test_percents_round_as_python_does(spark):
    import random

    of = random.Random(6)
    shares = [of.random() for _ in range(20_000)] + [i / 2000 for i in range(-2000, 2001)] + [i / 2048 for i in range(2049)] + [of.randint(0, 10**6) / 10**6 for _ in range(20_000)] + [0.0, 1.0, -0.0, 1e-300, float("nan"), None]
    got = spark.createDataFrame([(s,) for s in shares], "s double").coalesce(1).select("s", report.half_even(F.col("s")).alias("p")).collect()
    assert all(r.p == (None if r.s is None or r.s != r.s else round(r.s * 100, 1)) for r in got)
    sizes = [(i, i * 103) for i in range(1, 30_000)]
    for r in spark.createDataFrame(sizes, "i int, n long").select("n", T.size_label(F.col("n")).alias("told")).collect():
        kb = r.n / 1024
        assert r.told == (f"{max(kb, 0.1):.1f} KB" if kb < 1024 else f"{kb / 1024:.1f} MB")


def test_reports_run_no_python(spark):
    match = spark.createDataFrame([("q", 1, "t", "a", 0.5, None, 0.5, "dual", True, "r", "YES", "x")], "q_key string, rank int, task string, trainer string, lex double, sem double, score double, method string, flagged boolean, block_reason string, flag_label string, matched_instruction string")
    assert "Python" not in report.listed(match)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pivots, cell, chunk", [(256, 4096, 65_536), (2, 3, 5), (7, 1, 1)])
def test_pivots_find_what_the_scan_finds(spark, monkeypatch, pivots, cell, chunk):
    import random

    of = random.Random(pivots)
    monkeypatch.setattr(nearest, "PIVOTS", pivots), monkeypatch.setattr(nearest, "CELL", cell), monkeypatch.setattr(nearest, "CHUNK", chunk)
    centres = [[of.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    near = lambda c, s: [x + of.gauss(0, s) for x in c]
    vectors = [near(of.choice(centres), 0.05) for _ in range(120)] + [centres[0]] * 9 + [[0.0] * 6, [], [1.0, 2.0], [2.0, 4.0], [-1.0, 1.0], None, [float("nan")] + [1.0] * 5, [None, 1.0]]
    order = of.sample(range(1000), len(vectors))
    rows = spark.createDataFrame(list(zip(order, vectors)), "key long, v array<double>").repartition(4)
    told = lambda df: sorted((r.q_key, r["rank"], r.c_key, round(r.sem, 9)) for r in df.collect())
    found = nearest.AllNearest(rows, 4)
    assert told(found.top()) == told(search.cosine_topk(rows, rows, 4))
    if pivots == 256:
        # five groups far apart: most pairs are never compared
        counted = found.compared().first()
        assert counted.met < counted.pairs / 2


def test_pivots_of_nothing(spark):
    assert nearest.all_topk(spark.createDataFrame([], "key long, v array<double>")).collect() == []


def test_no_vector_is_copied_for_every_ring(spark, monkeypatch, tmp_path):
    """However many rings a vector must meet: what is written follows the number of vectors."""
    import random

    of = random.Random(8)
    rows = spark.createDataFrame([(i, [of.gauss(0, 1) for _ in range(48)]) for i in range(400)], "key long, v array<double>").repartition(2)
    monkeypatch.setattr(nearest, "PIVOTS", 64), monkeypatch.setattr(mapside, "POSTINGS", 8_000)
    kept, write = [], nearest.written
    monkeypatch.setattr(nearest, "written", lambda df, *told: kept.append(write(df, *told)) or kept[-1])
    monkeypatch.setattr(mapside, "written", lambda df, *told: kept.append(write(df, *told)) or kept[-1])
    found = nearest.AllNearest(rows, 4)
    told = lambda df: sorted((r.q_key, r["rank"], r.c_key, round(r.sem, 9)) for r in df.collect())
    assert told(found.top()) == told(search.cosine_topk(rows, rows, 4))
    assert found.compared().first().met > 400 * 400 / 2
    assert all(f.count() <= 400 for f in kept if "v" in f.columns)


def test_versions(spark, tmp_path):
    """Only changed rows are found, and only their vectors are made again."""
    from millrace.sources import versions

    rows = [(i, f"text {i}" if i % 7 else None) for i in range(300)]
    old = spark.createDataFrame(rows, "key long, text string")
    new = spark.createDataFrame([(k, (t or "") + ("x" if k == 14 else "")) for k, t in rows if k not in (3, 4)] + [(900, "new")], "key long, text string")
    a, b = versions.keep(old, str(tmp_path / "a")), versions.keep(new, str(tmp_path / "b"))
    assert sorted(map(tuple, versions.changes(a, b).collect())) == [(3, "removed"), (4, "removed"), (14, "changed"), (900, "added")]
    assert a.signature() != b.signature() and a.signature() == versions.keep(old.repartition(3, "text"), str(tmp_path / "c")).signature()
    assert versions.changes(a, versions.Version(spark, str(tmp_path / "c"))).count() == 0
    asked = spark.sparkContext.accumulator(0)

    def provider(texts):
        asked.add(len(texts))
        return [[float(len(t or ""))] for t in texts]

    vectors = old.selectExpr("key", "array(double(length(coalesce(text, '')))) AS v")
    got = {r.key: r.v for r in versions.refreshed(vectors, new, versions.changes(a, b), provider).collect()}
    assert got == {k: [float(len(t or ""))] for k, t in map(tuple, new.collect())}
    assert asked.value == 2


def _random_texts(spark, seed, many, words=30):
    import random

    of = random.Random(seed)
    # few words that most texts have, many that few have
    texts = [" ".join(f"w{min(int(of.paretovariate(0.4)), words)}" for _ in range(of.randint(0, 14))) for _ in range(many)]
    texts += [" ".join(of.sample(t.split(), len(t.split()))) + of.choice(["", " x", "!"]) for t in texts[: many // 3]]
    return spark.createDataFrame(list(enumerate([*texts, None, "", " ?"])), "key long, text string")


@pytest.mark.parametrize("least", [0.05, 0.4, 0.6, 2 / 3, 0.8, 1.0])
def test_prefix_join_finds_what_the_search_finds(spark, least):
    left, right = _random_texts(spark, 1, 120), _random_texts(spark, 2, 200)
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(setjoin.search(left, right, least)) == told(search.dice_threshold(left, right, least))
    first = {r.key: r.set_key for r in setjoin.classes(right).collect()}
    many = {k: sum(1 for x in first.values() if x == k) for k in first.values()}
    every = [(a, b, many[a], many[b], lex) for a, b, lex in told(search.dice_threshold(right, right, least)) if a < b and first[a] == a and first[b] == b]
    assert told(setjoin.self_pairs(right, least)) == every
    assert least > 0.8 or len(every) > 20


@pytest.mark.parametrize("size, first", [(32, 4), (1, 1), (3, 2)])
def test_index_finds_what_the_scan_finds(spark, monkeypatch, tmp_path, size, first):
    """Blocks of any size give the scan's rows; where a query has k near rows, few blocks are read."""
    monkeypatch.setattr(gramindex, "RANGE", size), monkeypatch.setattr(gramindex, "FIRST", first)
    corpus = spark.createDataFrame([(i, f"topic{i % 40} word{i % 7} other{i % 3} rare{i}" if i % 50 else (" ", None, "the of")[i % 3]) for i in range(600)], "key long, text string")
    queries = spark.createDataFrame([(1, "topic3 word3 other0"), (2, "rare17 topic17"), (3, "unknown"), (4, None), (5, "word1"), (6, "topic39 topic39 rare39")], "key long, text string")
    found = gramindex.Search(queries, gramindex.build(corpus, str(tmp_path / "index"), 300), 3)
    rows = lambda df: [(r.q_key, r["rank"], r.c_key, round(r.score, 9)) for r in df.orderBy("q_key", "rank").collect()]
    assert rows(found.top()) == rows(tfidf.topk(queries, corpus, 3, 300))
    told = {r.q_key: (r.blocks, r.opened) for r in found.opened().collect()}
    assert told[3] == told[4] == (0, 0) and all(o <= b for b, o in told.values())
    if size == 1:
        assert told[1][1] < told[1][0] / 2


def test_prefix_join_in_waves(spark, monkeypatch):
    """Where words meet often, few meetings are joined at a time, and the pairs are the same."""
    texts = spark.createDataFrame([(i, f"a b c d e f{i % 3} g{i % 7} h{i % 11}") for i in range(120)], "key long, text string")
    told = lambda df: sorted(map(tuple, df.collect()))
    whole, kept, write = told(setjoin.self_pairs(texts)), [], setjoin.written
    monkeypatch.setattr(setjoin, "MEETINGS", 1)
    monkeypatch.setattr(setjoin, "written", lambda df, tag: kept.append(tag) or write(df, tag))
    assert told(setjoin.self_pairs(texts)) == whole and len(whole) > 1000
    assert kept.count("wave") > 1


def test_index_search_writes_the_best_rows_only(spark, tmp_path):
    """However many ranges there are: a task lets k rows a query and their count out."""
    corpus = spark.range(3000).selectExpr("id AS key", "concat('topic', id % 40, ' word', id % 7, ' other', id % 3) AS text").repartition(4)
    found = gramindex.Search(corpus.where("key < 50"), gramindex.build(corpus, str(tmp_path / "index")), 3)
    assert found.told.count() <= 50 * (3 + 1) * found.index.table("ranges").rdd.getNumPartitions()
    assert found.top().count() == 150


def test_prefix_join_broadcasts_nothing(spark):
    texts = _random_texts(spark, 3, 50)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        for found in (setjoin.self_pairs(texts), setjoin.search(texts, texts)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan and "Cartesian" not in plan and "Python" not in plan and "Arrow" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_prefix_join_of_nothing(spark):
    none = spark.createDataFrame([], "key long, text string")
    assert setjoin.self_pairs(none).collect() == [] and setjoin.search(none, none).collect() == []


def test_texts_without_a_common_word_fill_up(spark):
    corpus = spark.createDataFrame([(5, "red fish"), (3, "blue"), (9, "red"), (1, "green"), (2, " "), (7, "")], "key long, text string").repartition(3)
    few = spark.createDataFrame([(0, "red"), (1, "none of these"), (2, "")], "key long, text string")
    got = sorted(map(tuple, search.dice_topk(few, corpus, 3).collect()))
    assert got == [(0, 1, 9, 1.0), (0, 2, 5, 2 / 3), (0, 3, 1, 0.0), (1, 1, 1, 0.0), (1, 2, 3, 0.0), (1, 3, 5, 0.0), (2, 1, 1, 0.0), (2, 2, 3, 0.0), (2, 3, 5, 0.0)]


def test_no_text_is_shuffled(spark):
    """Over a corpus of many parts nothing is exchanged but the best rows of each task."""
    rows = spark.range(1000, numPartitions=64).select(F.col("id").alias("key"), F.lit("some text").alias("text"), F.array(F.lit(1.0)).alias("v"), F.lit("").alias("label"), F.lit("").alias("name"))
    few = rows.where("key < 3")
    for found in (search.dice_topk(few, rows), search.dice_threshold(few, rows), search.cosine_topk(few, rows), search.precheck(few, rows), tfidf.topk(few, rows)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("MapInArrow") :]
        assert "Exchange" not in below and plan.count("Exchange") <= 1


def test_exclusions(spark):
    keys = spark.createDataFrame([("Task · Ann",), ("Other · Bob",)], "k string")
    assert keys.where(S.excludes(F.col("k"), F.lit(" "))).count() == 0
    assert keys.where(S.excludes_tfidf(F.col("k"), F.lit(""))).count() == 2
    assert keys.where(S.excludes(F.col("k"), F.lit("ann"))).count() == 1


def test_tfidf_grams(spark):
    assert len(set(tfidf.STOP_WORDS)) == 318
    assert one(spark, tfidf.grams(F.lit("The Café of a big blue-Sky x"))) == ["cafe", "big", "blue", "sky", "cafe big", "big blue", "blue sky"]
    assert one(spark, tfidf.grams(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("summary, candidates", [(1_000_000, 200_000), (60, 200_000), (60, 3), (5, 200_000)])
def test_vocabulary_from_summaries(spark, monkeypatch, summary, candidates):
    """Whether summaries have room, grams are counted again, or all are: the counts are exact."""
    import random
    from collections import Counter

    of = random.Random(4)
    monkeypatch.setattr(tfidf, "SUMMARY", summary), monkeypatch.setattr(tfidf, "CANDIDATES", candidates), monkeypatch.setattr(tfidf, "TEXTS", 7)
    texts = [" ".join(f"word{min(int(of.paretovariate(0.9)), 500)}" for _ in range(of.randint(0, 30))) for _ in range(400)] + [None, ""]
    corpus = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3)
    cf, df = Counter(), Counter()
    for text in texts:
        words = (text or "").split()
        own = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        cf.update(own), df.update(set(own))
    best = sorted(cf, key=lambda g: (-cf[g], g))[:20]
    assert [tuple(r) for r in tfidf.vocabulary(corpus, 20).collect()] == [(g, cf[g], df[g]) for g in best]
    left = tfidf._summaries(corpus.select(tfidf.grams(F.col("text")).alias("all"))).where("gram is not null").count()
    assert left <= 3 * summary


def test_vocabulary_counts_pairs_of_frequent_words_only(spark, monkeypatch):
    """Texts are told into words once, and a pair of which a word is too rare is counted in no summary."""
    kept, write = [], tfidf.written
    monkeypatch.setattr(tfidf, "written", lambda df, tag, *by: kept.append((tag, write(df, tag, *by))) or kept[-1][1])
    texts = [(i, f"big fish the big sea rare{i} odd{i} fish") for i in range(300)]
    corpus = spark.createDataFrame(texts, "key long, text string").repartition(3)
    got = [tuple(r) for r in tfidf.vocabulary(corpus, 3).collect()]
    assert got == [("big", 600, 300), ("fish", 600, 300), ("big fish", 300, 300)]
    assert [tag for tag, _ in kept].count("words") == 1
    pairs = [table for tag, table in kept if tag == "summaries"][-1]
    assert pairs.where("gram like '% %' and (gram like '%rare%' or gram like '%odd%')").count() == 0


def test_words_by_numbers_make_the_same_grams(spark):
    """Accents go word by word after the words are told, and nothing else changes."""
    import random

    import pyarrow as pa

    of = random.Random(9)
    letters = tfidf.accents()[0] + "abcéÉİßşx_1²Ⅷ中文 \t-.'’\u0301\U0001d518" + " " * 200
    texts = ["".join(of.choice(letters) for _ in range(of.randint(0, 60))) for _ in range(300)] + ["The Café of a big blue-Sky x", "àbove the ab the cd", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string").coalesce(1)
    rows = rows.select(tfidf.grams(F.col("text")).alias("grams"), tfidf._words(F.col("text")).alias("words")).toArrow()
    wanted = [sorted(g) for g in rows.column("grams").to_pylist()]
    every = sorted({g for gs in wanted for g in gs})
    row, at = tfidf.Known(pa.array(every, pa.string())).found(mapside.column(rows, "words"))
    got = [[] for _ in wanted]
    for r, g in zip(row.tolist(), at.tolist()):
        got[r].append(every[g])
    assert [sorted(g) for g in got] == wanted and len(every) > 300


def test_tfidf_query_without_known_words_scores_zero(spark):
    corpus = spark.createDataFrame([(0, "red fish"), (1, "blue fish")], "key long, text string")
    rows = tfidf.topk(spark.createDataFrame([(5, "zebra")], "key long, text string"), corpus).collect()
    assert [(r["c_key"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(0, 0.0), (1, 0.0)]


def test_corpus_keys(spark):
    rows = sheets.keyed(fixtures.frame(spark, "sheet"), "name", "trainer", "instruction").orderBy("ord").collect()
    assert [(r["key"], r["instruction"]) for r in rows] == [("T1 · Ann", "z"), ("T2 · Bob", "y"), ("row-5 · Cy", "w"), ("T4 · nan", "v"), ("row-8 · nan", "u")]


def test_column_resolution():
    assert sheets.pick_column(["A", "Task Instruction", "b"], ["task instruction"]) == "Task Instruction"
    assert sheets.pick_column(["my instruction text"], ["instruction"]) == "my instruction text"
    assert sheets.instruction_column([f"c{i}" for i in range(16)]) == "c15"
    assert sheets.instruction_column(["a"]) is None
    assert sheets.sheet_id("https://h/spreadsheets/d/ABC/edit#gid=0") == "ABC"
    assert sheets.export_url("https://h/spreadsheets/d/ABC/edit", "a b").endswith("ABC/gviz/tq?tqx=out:csv&sheet=a%20b")
    with pytest.raises(ValueError):
        sheets.sheet_id("https://h/x")
    assert [sheets.reject_body(b) for b in (" ", "<!doctype html>", "a,b\n<html", "a,b\n1,2")] == ["empty", "html", "html", None]


def test_sheet_and_json_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text('name,trainer,instruction\nT1,Ann,"two\nlines, ""q"""\n')
    rows = sheets.numbered(sheets.read_csv(spark, str(tmp_path / "s.csv")))
    assert sheets.keyed(rows, "name", "trainer", "instruction").first()["instruction"] == 'two\nlines, "q"'
    texts = spark.createDataFrame([(json.dumps({"a": {"instruction": "i", "spec": ""}, "b": "text", "c": {"spec": "s"}}),)], "value string")
    assert sorted(map(tuple, sheets.json_corpus(texts).collect())) == [("a", "i", None), ("c", None, "s")]
    (tmp_path / "e.csv").write_text("name,trainer,instruction\n")
    with pytest.raises(ValueError):
        sheets.read_csv(spark, str(tmp_path / "e.csv"))
    found, notes = sheets.first_corpus(lambda: 1 / 0, lambda: sheets.json_corpus(texts).limit(0), lambda: sheets.json_corpus(texts))
    assert found.count() == 2 and len(notes) == 2


def test_rules_by_bundle(spark):
    found = {}
    for r in rules.static_issues(fixtures.frame(spark, "files")).orderBy("bundle_id", "seq").collect():
        found.setdefault(r["bundle_id"], []).append(r["rule_id"])
    assert "clean" not in found and found["missing_tests"] == ["ST1", "ST1"] and found["no_spec"] == ["ST2"]
    assert found["bad_toml"] == ["S01", "S02", "S04", "S05", "S06", "S06", "S07", "S08", "S09", "S13", "S14", "S14"]
    assert found["bad_docker"] == ["S15", "S15", "S16", "S17", "S18", "S20", "S21"]
    assert found["golang"] == ["S19"] and "alpine" not in found and "slim_python" not in found
    assert found["bad_tests"] == ["S22", "S23", "S24", "S25", "S26", "S27"] or found["bad_tests"] == ["S22", "S23", "S24", "S25", "S27"]
    assert found["no_agent"] == ["S03", "S12"] and "no_timeout" not in found and "empty_toml" not in found


def test_odd_timeouts_give_no_issue(spark):
    files = fixtures.frame(spark, "files").where("bundle_id = 'clean'")
    files = files.withColumn("content", F.when(F.col("path") == "task.toml", "allow_internet = false\n[agent]\ntimeout_sec = 1.2.3\n").otherwise(F.col("content")))
    assert rules.static_issues(files).count() == 0


def test_regex_dialect(spark):
    assert one(spark, F.lit("a\x85name = 1").rlike(r"(?dmU)^name\s*=")) is False, "only a line feed begins a line"
    assert one(spark, F.lit("ſolve.sh x").rlike(rules.LEAKAGE)) is True, "case folding knows the long s"


def test_rubrics(spark):
    found = {}
    for r in rules.rubric_issues(fixtures.frame(spark, "rubrics")).orderBy("bundle_id", "seq").collect():
        found.setdefault(r["bundle_id"], []).append(r["rule_id"])
    assert found["blank"] == ["R0"] and "good" not in found and found["four"] == ["R4", "R5", "R6"] and found["lower"] == ["R1", "R5", "R6"]
    assert found["no_score"] == ["R2", "R5", "R6"] and found["invalid"] == ["R3", "R5", "R6"] and found["zero"] == ["R5", "R6"]
    zero = rules.rubric_issues(fixtures.frame(spark, "rubrics")).where("bundle_id = 'zero' and rule_id = 'R6'").first()
    assert zero["message"] == "Rubric has only 1 negatives (need >=3)"


def test_verdict_fold_ignores_errors(spark):
    rows = spark.createDataFrame([(b, f"c{i}", v) for b, vs in {"pass": ["PASS"] * 9, "needs": ["PASS", "NEEDS_WORK"], "reject": ["REJECT"], "error": ["ERROR"] * 9, "skip": ["SKIPPED"] * 9, "odd": ["UNKNOWN"]}.items() for i, v in enumerate(vs)], "bundle_id string, check_key string, verdict string")
    got = {r["bundle_id"]: r["llm_pass"] for r in gates.llm_pass(rows).collect()}
    assert got == {"pass": True, "needs": False, "reject": False, "error": True, "skip": None, "odd": True}


def test_results_are_ordered_and_skips_have_no_score(spark):
    rows = verdicts.results(verdicts.applicable(fixtures.frame(spark, "files")), verdicts.parsed(fixtures.frame(spark, "verdicts"))).where("bundle_id = 'clean'").orderBy("ord").collect()
    assert [r["check_key"] for r in rows] == [c[0] for c in verdicts.CHECKS] and {r["verdict"] for r in rows} == {"SKIPPED"} and rows[0]["alignment_score"] is None


def test_provider_errors_become_verdicts(spark):
    prompted = spark.createDataFrame([("b", "c", "p")], "bundle_id string, check_key string, prompt string")

    def broken(prompts):
        raise RuntimeError("no")

    assert verdicts.parsed(verdicts.judged(prompted, broken)).first()["verdict"] == "ERROR"
    assert verdicts.parsed(verdicts.judged(prompted, lambda ps: ['{"verdict": "PASS"}' for _ in ps])).first()["verdict"] == "PASS"


def test_percents_differ_between_reports(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.6245, None), (0.6225, 0.0015)], "lex double, sem double")
    got = [tuple(r)[2:] for r in report.percents(rows).collect()]
    share = lambda x: round(x * 100, 1)
    assert got == [(0.0, 0.0, None, None), (share(0.6245), None, share(0.6245), None), (share(0.6225), share(0.0015), share(0.6225), share(0.0015))]
    halves = spark.createDataFrame([(0.125 / 2,), (0.1875 / 2,)], "lex double").withColumn("sem", F.col("lex"))
    assert [r["report_lexical"] for r in report.percents(halves).collect()] == [6.2, 9.4], "half to even on the exact value"


def test_reports_escape(spark):
    issues = spark.createDataFrame([("b", 0, "HIGH", "<i>'x'", "")], "bundle_id string, seq int, severity string, message string, fix_hint string")
    assert "&lt;i&gt;&#x27;x&#x27;" in report.issues_html(issues).first()["html"]
    assert [one(spark, report.badge(F.lit(v).cast("boolean")))[-11:-7] for v in (True, False, None)] == ["PASS", "FAIL", "PPED"]


def test_zip_bundles(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "my task.zip", "w") as z:
        for name in ("top/task.toml", "top/tests/test.sh", "__MACOSX/x"):
            z.writestr(name, "text")
    (tmp_path / "broken.txt").write_bytes(io.BytesIO(b"x").getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    read = bundles.read_zips(spark, str(tmp_path))
    assert [(r["bundle_id"], r["content"][:10]) for r in read.where("path is null").collect()] == [("bad", "BadZipFile")]
    rows = bundles.flattened(read.where("path is not null"))
    assert sorted((r["bundle_id"], r["path"]) for r in rows.collect()) == [("my task", "__MACOSX/x"), ("my task", "task.toml"), ("my task", "tests/test.sh")]


def test_vectors(spark):
    texts = spark.createDataFrame([(i, "x" * i) for i in range(130)], "key long, text string").coalesce(1)
    got = {r["key"]: r["v"] for r in vectors.embedded(texts, lambda ts: [[float(len(t)), float(len(ts))] for t in ts]).collect()}
    assert got[5] == [5.0, 60.0] and got[129] == [129.0, 10.0]
    assert vectors.known(texts.limit(2), spark.createDataFrame([(0, [1.0])], "key long, v array<double>")).where("v is null").count() == 1


def test_cached_tables(spark, tmp_path):
    built, key = [], cache.key_of(sheet="s", column="c")
    assert key == cache.key_of(column="c", sheet="s") != cache.key_of(column="d", sheet="s")

    def build():
        built.append(len(built))
        return spark.createDataFrame([(len(built),)], "n int")

    at = lambda now: cache.cached(spark, f"file://{tmp_path}", key, build, 100, now).first()["n"]
    assert [at(1000.0), at(1050.0), at(1099.0), at(1101.0), at(1150.0), at(2000.0)] == [1, 1, 1, 2, 2, 3] and len(built) == 3
    assert cache.cached(spark, "nosuchscheme://x", key, build, 100, 2001.0).first()["n"] == 4
    with pytest.raises(ZeroDivisionError):
        cache.cached(spark, f"file://{tmp_path}", "other", lambda: 1 / 0)


def test_messages_without_texts(spark):
    """A blank submission, an empty corpus with the error of its source, and words alone."""
    corpus = spark.createDataFrame([(1, "red fish", "a", None)], "key long, text string, label string, v array<double>")
    asked = spark.createDataFrame([(7, " ", "", None), (8, "red bird", "", None)], "key long, text string, name string, v array<double>")
    notes = F.array(F.lit("Loaded 0"), F.lit("The sheet returned nothing"))

    def told(rows, many):
        hits = search.precheck(asked, rows).withColumn("task", F.lit("a")).withColumn("trainer", F.lit(""))
        return {r["q_key"]: r for r in search.messages(asked, hits, F.lit(many).cast("long"), notes).collect()}

    some, none = told(corpus, 1), told(corpus.limit(0), 0)
    assert some[7]["message"] == "There is no text to check." and not some[8]["blocked"] and "words 50%" in some[8]["message"] and some[8]["notes"][2] == "Meaning was not compared."
    assert none[8]["message"] == "There are no texts to compare with. The sheet returned nothing" and none[8]["max_similarity"] == 0


def test_gates_over_all_issues(spark):
    """A rubric's severe issue fails the static gate too; a flagged match fails similarity and the whole."""
    files = fixtures.frame(spark, "files").where("bundle_id = 'clean'")
    static = rules.static_issues(files)
    rubric = rules.rubric_issues(spark.createDataFrame([("clean", "agent a, +5")], "bundle_id string, text string"))
    hits = spark.createDataFrame([("clean", True)], "q_key string, flagged boolean")
    answers = spark.createDataFrame([], "bundle_id string, check_key string, verdict string")
    row = gates.gated(files, static, rubric, hits, answers).first()
    assert (row["structure_pass"], row["static_pass"], row["rubric_pass"], row["similarity_pass"], row["llm_pass"], row["overall_pass"]) == (True, False, False, False, None, False)
    good = rules.rubric_issues(spark.createDataFrame([("clean", fixtures.RUBRICS[1][1])], "bundle_id string, text string"))
    assert gates.gated(files, static, good, hits.limit(0), answers).first()["overall_pass"] is True


def test_options(spark):
    spark.conf.set("spark.millrace.model", " m ")
    assert options.option(spark, "model", "d") == "m" and options.option(spark, "other", "d") == "d"
    assert [options.workers(w, 9) for w in (None, "x", 0, 99)] == [6, 6, 1, 9]


def test_small_texts(spark):
    assert one(spark, T.size_label(F.lit(1))) == "0.1 KB" and one(spark, T.size_label(F.lit(3 << 20))) == "3.0 MB"
    assert one(spark, T.truncated(F.lit(None).cast("string"), 3)) == "[FILE NOT FOUND]"
    assert one(spark, T.after_last(F.lit("a[agent]b[agent]c"), "[agent]")) == "c" and one(spark, T.after_last(F.lit("a"), "[agent]")) == ""


def test_stream_of_submissions(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "red fish"), (2, "blue bird")], "key long, text string")
    spark.createDataFrame([(9, "a red fish")], "key long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, text string").parquet(str(tmp_path / "in"))
    submissions.watch(stream, corpus, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    best = spark.read.parquet(str(tmp_path / "out")).where("rank = 1").first()
    assert (best["q_key"], best["c_key"], round(best["lex"], 2)) == (9, 1, 0.8)


def test_empty_tables(spark):
    texts = spark.createDataFrame([], "key long, text string")
    assert search.dice_topk(texts, texts).count() == 0 and tfidf.topk(texts, texts).count() == 0
    assert rules.static_issues(spark.createDataFrame([], "bundle_id string, path string, content string")).count() == 0


def test_words_of_bytes_are_those_of_expressions(spark):
    """Reports' searches tell words from bytes, and the words that several passes read are written without stop words."""
    import random

    from millrace.operators import tokens

    of = random.Random(3)
    letters = tfidf.accents()[0] + "abcABCéÉİKÅßşx_1²Ⅷ中文 \t\n-.'’́\U0001d518\U0001f600" + " " * 200
    texts = ["".join(of.choice(letters) for _ in range(of.randint(0, 60))) for _ in range(400)] + ["The Café of a big blue-Sky x", "àbove the ab the cd", "", "a", "the", "end", "end", None, " ", "’ ’"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3)
    told = tfidf._told(corpus)
    assert dict(told.dtypes)["all"] == "string"
    got = {r["key"]: r["all"].split(" ") if r["all"] else [] for r in told.collect()}
    grams = {r["key"]: [g for g in r["grams"] if " " not in g] for r in corpus.select("key", tfidf.grams(F.col("text")).alias("grams")).collect()}
    assert got == grams
    rows = corpus.coalesce(1).select(F.lower(F.coalesce("text", F.lit(""))).alias("low"), T.token_set(F.col("text")).alias("words")).toArrow()
    low = mapside.column(rows, "low")
    wanted = [sorted(w) for w in rows.column("words").to_pylist()]
    assert [sorted(w) for w in tokens.sets(low).to_pylist()] == wanted
    assert [sorted(w) for w in tokens.sets(low.slice(100, 200)).to_pylist()] == wanted[100:300]
    assert tokens.sets(low.slice(0, 0)).to_pylist() == []


def test_precheck_sends_texts_to_its_tasks(spark):
    """No list of words is made of a corpus text before its task: texts go there as they are."""
    corpus = spark.createDataFrame([(1, "a red fish", "t", None)], "key long, text string, label string, v array<double>")
    found = search.precheck(corpus.select("key", "text", F.lit("").alias("name"), "v"), corpus)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "regexp_replace" not in plan and "split(" not in plan


def test_dense_tables_are_compared_in_blocks(spark, monkeypatch):
    """Where most texts share words no words are joined; blocks of any size give the pairs of the scan, for keys of any kind."""
    texts = _random_texts(spark, 4, 200, 60).withColumn("key", F.format_string("k%d", "key"))
    told = lambda df: sorted(map(tuple, df.collect()))
    every, kept, write = told(search.dice_threshold(texts, texts, 0.5)), [], setjoin.written
    first = {r.key: r.set_key for r in setjoin.classes(texts).collect()}
    monkeypatch.setattr(setjoin, "written", lambda df, tag: kept.append(tag) or write(df, tag))
    monkeypatch.setattr(setjoin, "PAIRS", 0)
    assert told(setjoin.search(texts, texts, 0.5)) == every and "prefixes" not in kept
    monkeypatch.setattr(setjoin, "MEETINGS", 1)
    found = told(setjoin.self_pairs(texts, 0.5).select("a_key", "b_key", "lex"))
    assert found == [(a, b, lex) for a, b, lex in every if a < b and first[a] == a and first[b] == b]
    assert len(found) > 100 and "prefixes" not in kept and kept.count("wave") > 5


def test_precheck_scores_only_what_may_stand_first(spark):
    """Words are told of few pairs of two vectors, and the rows are those of all pairs, with names and missing vectors."""
    import random

    import numpy as np
    import pyarrow as pa

    of = random.Random(7)
    vector = lambda: [of.gauss(0, 1) for _ in range(4)] if of.random() < 0.5 else None
    text = lambda: " ".join(f"w{min(int(of.paretovariate(0.5)), 90)}" for _ in range(of.randint(1, 12)))
    rows = [(i, text(), f"Task {i} · s{i % 3}", vector()) for i in range(300)]
    asked = [(i, text(), of.choice(["", " ", f"task {i} ·", " S1", "task"]), vector()) for i in range(40)]
    corpus = spark.createDataFrame(rows, "key long, text string, label string, v array<double>")
    found = search.precheck(spark.createDataFrame(asked, "key long, text string, name string, v array<double>"), corpus, 5)
    wanted = []
    for q, t, name, v in asked:
        every = []
        for c, u, label, w in rows:
            if name.strip() and name.strip().lower() in label.lower():
                continue
            a, b = set(t.split()), set(u.split())
            lex = round(2 * len(a & b) / (len(a) + len(b)), 12)
            sem = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12) if v and w else None
            flagged = sem is not None and (sem >= 0.7 or sem >= 0.6 and lex >= 0.6)
            every.append((not flagged, -(-1 if sem is None else sem), -lex, c))
        wanted += [(q, i + 1, c) for i, (_, _, _, c) in enumerate(sorted(every)[:5])]
    assert sorted((r.q_key, r["rank"], r.c_key) for r in found.collect()) == wanted
    vectors = pa.array([[1.0, x / 100] for x in range(400)])
    block = mapside.Block(pa.table({"q_key": [1], "name": [""], "words": [["a"]], "v": pa.array([[0.0, -1.0]])}))
    row, query, sem = search._meant(block, vectors, pa.array([""] * 400), np.array([np.inf]), 5)
    assert row.tolist() == [0, 1, 2, 3, 4] and not query.any() and sem[0] == 0
