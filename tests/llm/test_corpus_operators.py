"""Operators that compare rows, against brute force over all of them."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import _shared, components, embedding_dedup, entry, exact_dedup, ngram_join, pii, stages, substring_dedup, words
from millrace.llm.fm_index import FMIndex
from tests.llm.test_text_operators import DOCS, check_packing, clashing, sha, table
from tests.oracle import assert_same

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made(seed, n=60, words=40, size=(0, 60)):
    """Texts with copies, edits and shared passages."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["The", "ÉT", "é", "x" * 300]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if texts and kind < 0.2:
            texts.append(rnd.choice(texts))
        elif texts and kind < 0.5:
            own = list(rnd.choice(texts).split(" "))
            for _ in range(rnd.randint(1, 2)):
                own.insert(rnd.randrange(len(own) + 1), rnd.choice(vocabulary))
            texts.append(rnd.choice([" ", "  ", "\n"]).join(own))
        else:
            texts.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(*size))))
    passage = " ".join(f"p{i}" for i in range(15))
    texts += [f"a{i} {passage} b{i}" for i in range(8)] + [None, "", " \t", "one", "two words", "one"]
    rnd.shuffle(texts)
    return texts


def union(pairs, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in nodes}


# -- components ------------------------------------------------------------------------
@pytest.mark.parametrize("limit, hot", [(components.LOCAL_EDGES, _shared.HOT_ROWS), (0, _shared.HOT_ROWS), (0, 3)])
def test_components(spark, monkeypatch, limit, hot):
    monkeypatch.setattr(components, "LOCAL_EDGES", limit), monkeypatch.setattr(_shared, "HOT_ROWS", hot)
    rnd = random.Random(1)
    edges = [(1000 + i, 990) for i in range(60)] + [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(500, 520)] + [(None, 3), (7, 7), (900, 901), (901, 900)]
    real = [(a, b) for a, b in edges if a is not None and b is not None]
    expected = {x: c for x, c in union(real, {x for e in real for x in e}).items() if c != x}
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == expected and len(got) == len(expected)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- exact dedup -----------------------------------------------------------------------
def test_exact_dedup_query(spark):
    assert_same(spark, SMALL, entry.QUERIES, entry.ORACLE_SQL, "op8_exact_dedup")


def test_exact_dedup_edges(spark):
    rows = [(1, "a", "en", "s", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "a", "de", "s", 1), (4, "a", "de", "s", 1), (None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (5, "a ", "en", "s", 2)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_digest", F.lit("x")).withColumn("_keeper", F.lit(1)).withColumn("kept", F.lit(False))
    got = exact_dedup.dedup(docs).collect()
    assert len(got) == 8
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(1, 4, 4), (4, 4, 4), (None, 4, 4), (2, 3, 2), (3, 3, 2), (None, None, 1), (5, 5, 1)}
    assert Counter(r["doc_id"] for r in got if r["kept"]) == {4: 1, 3: 1, None: 1, 5: 1}
    stay = exact_dedup.drop_copies(docs)
    assert stay.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"]) for r in stay.collect()) == [(0, "b"), (3, ""), (4, "a"), (5, "a ")]
    assert exact_dedup.dedup(table(spark, [])).count() == 0 and exact_dedup.drop_copies(table(spark, [])).count() == 0


def test_exact_dedup_checks_full_bytes(spark, monkeypatch):
    """With a digest that tells only lengths apart, the texts themselves decide."""
    monkeypatch.setattr(exact_dedup, "digest", lambda c: F.lpad(F.hex(F.length(c)), 64, "0"))
    texts = ["ab", "cd", "ab", "xyz", "cd", "ab"]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(table(spark, texts)).collect()}
    assert got == {0: (5, 3, False), 2: (5, 3, False), 5: (5, 3, True), 1: (4, 2, False), 4: (4, 2, True), 3: (3, 1, True)}


@pytest.mark.parametrize("lengths_only", [False, True])
def test_state_outlives_a_batch(spark, tmp_path, monkeypatch, lengths_only):
    """Batches one after another against brute force over all that came before, also where digests collide."""
    if lengths_only:
        monkeypatch.setattr(exact_dedup, "digest", lambda c: F.lpad(F.hex(F.length(c)), 64, "0"))
    rnd, seen = random.Random(3), {}
    for k in range(3):
        ids = rnd.sample([i for i in range(300) if i not in seen], 60)
        rows = [(i, rnd.choice(["ab", "cd", "xyz", None, "", "long one", "other!!!", f"own {i}"])) for i in ids]
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / f"batch{k}"))
        docs = spark.read.parquet(str(tmp_path / f"batch{k}"))
        seen |= {i: t or "" for i, t in rows}
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(docs, state=f"file://{tmp_path}/state").collect()}
        same = {i: [j for j, t in seen.items() if t == seen[i]] for i in ids}
        assert got == {i: (max(same[i]), len(same[i]), i == max(same[i])) for i in ids}


def test_a_hot_text_is_not_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HOT_ROWS", 5)
    texts = ["hot"] * 50 + ["warm"] * 3 + ["cold", None, ""]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(table(spark, texts)).collect()}
    last = {t or "": max(i for i, u in enumerate(texts) if (u or "") == (t or "")) for t in texts}
    assert got == {i: (last[t or ""], sum((u or "") == (t or "") for u in texts), i == last[t or ""]) for i, t in enumerate(texts)}


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.dedup(table(spark, ["a", "a"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- substrings ------------------------------------------------------------------------
def brute_removed(texts, window):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, own in words.items():
        covered = [False] * len(own)
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < i:
                covered[k : k + window] = [True] * window
        out[i] = (len(own), sum(covered), sha(" ".join(w for w, c in zip(own, covered, strict=True) if not c)))
    return out


@pytest.mark.parametrize("hot, most", [(substring_dedup.HOT, 10), (2, 10_000), (2, 0)])
def test_substrings(spark, monkeypatch, hot, most):
    monkeypatch.setattr(substring_dedup, "HOT", hot), monkeypatch.setattr(substring_dedup, "SHARD", 500), monkeypatch.setattr(substring_dedup, "HOT_BROADCAST", most)
    texts = made(4, words=12) + ["r " * 40, "r " * 30, "a\x1cb\x85c\xa0d\u2028e\x0bf\x0cg\x1fh"]
    got = substring_dedup.remove_repeats(clashing(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_removed(dict(enumerate(texts)), 13) and len(got) == len(texts)


def test_substrings_are_told_apart_by_their_words(spark):
    """Two words of equal low 32 bits, at the end of windows that are equal otherwise."""
    lead = " ".join(f"w{i}" for i in range(12))
    texts = {1: f"{lead} id108638", 2: f"{lead} id199068", 3: f"{lead}  id108638 x"}
    got = substring_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_removed(texts, 13)


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 2])
def test_substrings_whatever_the_hash(spark, monkeypatch, hot):
    """With hashes of two bits nearly all grams, minimizers and words collide; the words still decide."""
    whole = substring_dedup.word_hashes
    monkeypatch.setattr(substring_dedup, "word_hashes", lambda texts, fold_case=False: (whole(texts)[0] & np.uint64(3), *whole(texts)[1:]))
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    texts = made(21, n=40, words=12)
    cloudpickle.register_pickle_by_value(substring_dedup)  # the workers get the patched module
    try:
        got = substring_dedup.remove_repeats(table(spark, texts)).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(substring_dedup)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_removed(dict(enumerate(texts)), 13)


def test_substrings_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in entry.op4_substring_dedup(spark, SMALL).collect()}
    assert got == brute_removed(texts, 13)


def test_substrings_edges(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(5, long), (5, long), (None, long), (3, None), (9, long + " more"), (9, "short")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [(0, 20, 0), (3, 0, 0), (5, 20, 0), (5, 20, 0), (9, 1, 0), (9, 21, 20)]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=5, max_size=14), min_size=1, max_size=6))
def test_backward_search(texts):
    flat = np.array([s for t in texts for s in [*t, 0]], np.int64)
    owner = np.array([10 - i for i, t in enumerate(texts) for _ in range(len(t) + 1)], np.int64)
    index = FMIndex(flat, owner, 5, 2)
    ends = np.cumsum([len(t) + 1 for t in texts])
    places = np.array([p for e, t in zip(ends, texts, strict=True) for p in range(e - len(t) - 1, e - 5)], np.int64)
    start, stop = index.search(places, 5)
    least = index.least_owner(start, stop)
    for p, a, b, who in zip(places, start, stop, least, strict=True):
        hits = [q for q in places if (flat[q : q + 5] == flat[p : p + 5]).all()]
        assert who == min(owner[q] for q in hits) and (b - a == len(hits) or b - a == 1 == len(hits))


# -- n-grams ---------------------------------------------------------------------------
def brute_links(texts):
    sets = {}
    for i, t in texts.items():
        own = WORD.findall((t or "").translate(LOWER))
        sets[i] = set(zip(own, own[1:], own[2:])) if len(own) > 2 else {tuple(own)} if own else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    linked = union(links, sets)
    return {i: (len(s), linked[i]) for i, s in sets.items()}


@pytest.mark.parametrize("block, small, hot", [(ngram_join.BLOCK, ngram_join.SMALL, _shared.HOT_ROWS), (60, 60, 1), (ngram_join.BLOCK, 40, 3)])
def test_ngrams(spark, monkeypatch, block, small, hot):
    monkeypatch.setattr(ngram_join, "BLOCK", block), monkeypatch.setattr(ngram_join, "SMALL", small), monkeypatch.setattr(_shared, "HOT_ROWS", hot)
    texts = made(7, n=90, words=300)
    texts += [t.upper() for t in texts[:10] if t]
    got = ngram_join.join(clashing(spark, texts)).collect()
    expected = brute_links(dict(enumerate(texts)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected and len(got) == len(texts)
    assert len({c for _, c in expected.values()}) < len(texts) - 15


@pytest.mark.parametrize("octets", [ngram_join.PIVOT_BYTES, 0])
def test_one_cluster_of_many_parts(spark, monkeypatch, octets):
    """Near copies of one text far beyond a block, with chains at its border that no pivot reaches."""
    monkeypatch.setattr(ngram_join, "PIVOT_BYTES", octets)
    monkeypatch.setattr(ngram_join, "BLOCK", 400), monkeypatch.setattr(ngram_join, "SMALL", 100)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join([f"x{rnd.randrange(9)}" if rnd.random() < 0.01 else w for w in base]) for _ in range(150)]
    chain = list(base)
    for k in range(25):
        chain[(3 * k) % 80] = f"y{k}"
        texts.append(" ".join(chain))
    rnd.shuffle(texts)
    got = ngram_join.join(table(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_links(dict(enumerate(texts)))


def test_large_clusters_are_dealt_out_in_waves(spark, monkeypatch):
    """What is dealt out at a time doesn't grow with the square of a cluster, and signatures are dealt out once."""
    monkeypatch.setattr(ngram_join, "BLOCK", 40), monkeypatch.setattr(ngram_join, "SMALL", 100), monkeypatch.setattr(ngram_join, "WAVE", 1)
    base, texts = [f"w{i}" for i in range(80)], []
    for k in range(60):  # a chain, of which pivots reach little
        base[(3 * k) % 80] = f"y{k}"
        texts.append(" ".join(base))
    waves, write, together, plans = [], ngram_join.materialize, ngram_join._together, []
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag: waves.append(tag) or write(df, tag))

    def seen(told):
        plans.append(together(told)._jdf.queryExecution().executedPlan().toString())
        return together(told)

    monkeypatch.setattr(ngram_join, "_together", seen)
    got = ngram_join.join(table(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_links(dict(enumerate(texts)))
    assert waves.count("wave") > 1 and plans[0].count("Exchange hashpartitioning(sig") == 1


def test_sets_of_large_clusters_are_exchanged_by_task_only(spark, monkeypatch):
    """What tells a set's tasks goes to the sets: these are not dealt out by their identifiers before."""
    monkeypatch.setattr(ngram_join, "BLOCK", 40), monkeypatch.setattr(ngram_join, "SMALL", 100)
    base, texts = [f"w{i}" for i in range(80)], []
    for k in range(16):
        base[(3 * k) % 80] = f"y{k}"
        texts.append(" ".join(base))
    plans, large, write = [], ngram_join._large, ngram_join.materialize

    def seen(df, tag):
        if tag in ("pivots", "wave"):
            plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, tag)

    def dealt(sets, percent, link):
        links = large(sets, percent, link)
        plans.append(("wave", links._jdf.queryExecution().executedPlan().toString()))
        return links

    monkeypatch.setattr(ngram_join, "materialize", seen), monkeypatch.setattr(ngram_join, "_large", dealt)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        got = ngram_join.join(table(spark, texts)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_links(dict(enumerate(texts)))
    assert {tag for tag, _ in plans} == {"pivots", "wave"}
    assert not any("SortMergeJoin" in plan or "ShuffledHashJoin" in plan for _, plan in plans)


def test_long_texts_of_a_common_shingle_meet_in_no_cluster():
    """Small partitions, as of one shingle that many texts have, bring no sets together; linked sets still meet."""
    import numpy as np

    of = np.random.default_rng(2)
    common = of.integers(0, 1 << 63, (1500, 2)).astype(np.uint64)
    sets = [np.concatenate((common[of.random(1500) < 0.8], of.integers(0, 1 << 63, (3000, 2)).astype(np.uint64))) for _ in range(40)]
    told = [set(ngram_join.signatures(s, 90).tolist()) for s in sets]
    assert sum(bool(told[i] & told[j]) for i in range(40) for j in range(i)) == 0
    for s, own in zip(sets, told):
        near = np.concatenate((s[100:], of.integers(0, 1 << 63, (100, 2)).astype(np.uint64)))
        assert own & set(ngram_join.signatures(near, 90).tolist())


def test_ngrams_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in entry.op6_ngram_join(spark, SMALL).collect()} == brute_links(texts)
    assert ngram_join.join(table(spark, [])).count() == 0


def test_ngrams_of_texts_whose_polynomial_hashes_agree(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), f"x {word} y {word}", f"x {word} y {word}"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(table(spark, texts)).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (2, 2), 3: (2, 2)}


def test_ngrams_with_a_poor_first_lane(monkeypatch):
    """Where the first lane tells few shingles apart, the second decides."""
    import random

    of = random.Random(12)
    base = [[of.choice("abcdefghijkl") for _ in range(60)] for _ in range(12)]
    texts = [" ".join(w) for w in base for _ in range(1)]
    for w in base:
        for _ in range(3):
            other = list(w)
            other[of.randrange(60)] = of.choice("abc")
            texts.append(" ".join(other))
    texts = {i: t for i, t in enumerate(texts)}
    plain = ngram_join.shingle_sets(pa.array(list(texts.values())), 3)
    poor = words.gram_digests

    def few(*told):
        out = poor(*told)
        out[:, 0] &= np.uint64(7)
        return out

    monkeypatch.setattr(ngram_join, "gram_digests", few)
    sets = ngram_join.shingle_sets(pa.array(list(texts.values())), 3)
    assert [len(s) for s in sets] == [len(s) for s in plain] == [brute_links(texts)[i][0] for i in texts]
    expected = {i: c for i, (_, c) in brute_links(texts).items()}
    assert union(ngram_join.spanning_links(sets, 90), texts) == union([(i, c) for i, c in expected.items()], texts)
    assert all(ngram_join._common(a, b) == ngram_join._common(c, d) for a, c in zip(sets[:9], plain) for b, d in zip(sets, plain))
    told = [set(ngram_join.signatures(s, 90).tolist()) for s in sets]
    assert all(told[i] & told[c] for i, c in expected.items())


def test_ngrams_of_very_many_copies(spark, monkeypatch):
    """Copies are left out before signatures are dealt out."""
    monkeypatch.setattr(ngram_join, "HOT_COPIES", 20)
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, text) for i in range(500, 3000)] + [(7, text + " more"), (8, "something else entirely here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = []
    without = ngram_join._without_copies
    monkeypatch.setattr(ngram_join, "_without_copies", lambda *told: kept.append(without(*told).count()) or without(*told))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
    assert got == {i: 7 for i in range(500, 3000)} | {7: 7, 8: 8}
    assert kept == [3]


def test_ngrams_null_identifiers(spark):
    rows = [(4, "a b c d"), (None, "a b c d"), (None, "x y z"), (2, "A b C d"), (2, "A b C d")]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in got))) == sorted(map(str, [(4, 2), (None, 2), (None, None), (2, 2), (2, 2)]))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 70))
def test_signatures_and_tries_lose_no_link(seed, size):
    rnd = random.Random(seed)
    base = rnd.sample(range(10_000), size)
    sets = []
    for _ in range(25):
        own = list(base)
        for _ in range(rnd.randint(0, 1 + size // 8)):
            if rnd.random() < 0.5 and len(own) > 1:
                own.pop(rnd.randrange(len(own)))
            else:
                own.append(rnd.randrange(10_000))
        sets.append(ngram_join.distinct(np.stack([ngram_join.mix(np.array(own, np.uint64) + np.uint64(k)) for k in (0, 7)], 1)))
    links = [(i, j) for i in range(25) for j in range(i) if 100 * len(np.intersect1d(sets[i][:, 0], sets[j][:, 0])) >= 90 * len(np.union1d(sets[i][:, 0], sets[j][:, 0]))]
    told = [set(ngram_join.signatures(s, 90).tolist()) for s in sets]
    assert all(told[i] & told[j] or np.array_equal(sets[i], sets[j]) for i, j in links)
    assert union(links, range(25)) == union(ngram_join.spanning_links(sets, 90), range(25))


# -- vectors ---------------------------------------------------------------------------
def brute_near(rows):
    ids = [r[0] for r in rows]
    ok = [i for i, (_, v, label) in enumerate(rows) if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    links.append((ids[i], ids[j]))
    many = Counter(x for e in links for x in e)
    linked = union(links, ids)
    return {x: (many[x], linked[x]) for x in ids}


@pytest.mark.parametrize("cell, block", [(embedding_dedup.CELL, embedding_dedup.BLOCK), (5, 7), (500, 9)])
def test_vectors(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_dedup, "CELL", cell), monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rnd = np.random.default_rng(3)
    rows, number = [], 0
    for label in (1, 2):
        for _ in range(25):
            base = rnd.normal(size=64)
            for _ in range(rnd.integers(1, 6)):
                rows.append((number, [float(x) for x in base + rnd.normal(size=64) * rnd.choice([0, 0.02, 0.05, 0.3])], label))
                number += 1
    rows += [(number, None, 1), (number + 1, [0.0] * 64, 1), (number + 2, [float("nan")] * 64, 1), (number + 3, rows[0][1], None), (number + 4, [2.0 * x for x in rows[0][1]], 1), (number + 5, [1.0, None], 1), (number + 6, [], 1), (number + 7, [1.0, 2.0], 1), (number + 8, [2.0, 4.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit(1)).withColumn("n_links", F.lit(2))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near(frame).collect()}
    expected = brute_near(rows)
    found = sum(n for n, _, _ in got.values())
    wanted = sum(n for n, _ in expected.values())
    assert len(got) == len(rows) and wanted > 100 and all(got[i][0] <= expected[i][0] for i in got)
    assert found >= 0.9 * wanted and (cell < 500 or found == wanted and all(got[i][:2] == expected[i] for i in got))
    assert all(kept == (i == component) for i, (_, component, kept) in got.items())


def test_vectors_query_and_edges(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in entry.op7_embedding_dedup(spark, SMALL).collect()} == brute_near(rows)
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near(spark.createDataFrame([], schema)).count() == 0
    got = embedding_dedup.near(spark.createDataFrame([(None, [1.0], 1), (4, [1.0], 1), (4, [1.0], 1)], schema)).collect()
    assert sorted(map(str, ((r["vec_id"], r["n_links"], r["kept"]) for r in got))) == sorted(map(str, [(None, 0, False), (4, 1, True), (4, 1, True)]))


def test_layout_follows_the_table():
    assert embedding_dedup.layout(100, 0.98) == (0, 1)
    lines, tables = embedding_dedup.layout(10**9, 0.98)
    assert 8 <= lines <= 14 and tables < 100 and embedding_dedup.least_collisions() >= 5


# -- pipeline --------------------------------------------------------------------------
def brute_pipeline(spark, sf_dir):
    """What the first four stages keep, from the operators' plain definitions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    kept = {r["doc_id"]: r["text"] for r in docs if any(c.isalpha() for c in r["text"] or "")}
    last = {}
    for i in sorted(kept):
        last[kept[i]] = i
    kept = {i: t for t, i in last.items()}
    stay = brute_near_copies(kept)
    kept = {i: t for i, t in kept.items() if i in stay}
    return {i: pii.redacted(t, pii.find(t)) for i, t in kept.items()}


def test_pipeline(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(corpus_pipeline.run(spark, SMALL).collect(), brute_pipeline(spark, SMALL), 1024, tokenizer)


def brute_near_copies(texts):
    """What the near-copy stage keeps: the least of each component of links at 80 percent of five-word shingles."""
    sets = {}
    for i, t in texts.items():
        own = WORD.findall(t.translate(LOWER))
        sets[i] = set(zip(*(own[k:] for k in range(5)))) if len(own) > 4 else {tuple(own)} if own else set()
    linked = union([(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    return {i for i in texts if linked[i] == i}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 200))
def test_rare_signatures_lose_no_link(seed, size):
    rnd = random.Random(seed)
    base = rnd.sample(range(10_000), size)
    sets = []
    for _ in range(25):
        rate = rnd.choice([0.02, 0.05, 0.1])
        own = [x for x in base if rnd.random() > rate] + rnd.sample(range(10_000), rnd.randint(0, 1 + size // 12))
        sets.append(ngram_join.distinct(np.stack([ngram_join.mix(np.array(own, np.uint64) + np.uint64(k)) for k in (0, 7)], 1)))
    told = [ngram_join._signatures(s, 80) for s in sets]
    often = Counter(x for sigs, _ in told for x in sigs.tolist())
    kept = []
    for sigs, surplus in told:
        kept.append(set())
        for odd in (0, 1):
            own = sorted((x for x in sigs.tolist() if x & 1 == odd), key=lambda x: (often[x], x))
            kept[-1].update(own[: len(own) - surplus[odd]])
    links = [(i, j) for i in range(25) for j in range(i) if 100 * len(np.intersect1d(sets[i][:, 0], sets[j][:, 0])) >= 80 * len(np.union1d(sets[i][:, 0], sets[j][:, 0]))]
    assert links or size < 20
    assert all(kept[i] & kept[j] for i, j in links if len(sets[i]))


def test_near_copies_of_five_words(spark):
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    texts = [base, base + [f"a{k}" for k in range(40)], base + [f"b{k}" for k in range(70)], base + [f"c{k}" for k in range(90)], [f"x{k}" if k % 50 == 25 else w for k, w in enumerate(base)]]
    texts += [[f"z{k}" if k % 20 == 10 else w for k, w in enumerate(base)], ["few", "words"], ["Few", "words"], ["few", "words", "more"]]
    texts = [" ".join(t) for t in texts] + [t or "" for t in made(13, n=60, words=300)]
    expected = brute_near_copies(dict(enumerate(texts)))
    assert not {1, 2, 4, 7} & expected and {0, 3, 5, 6, 8} <= expected
    got = stages.drop_near_copies(spark, table(spark, texts), SMALL).collect()
    assert {r["doc_id"] for r in got} == expected and len(got) == len(expected)


def test_stages_keep_columns_and_stand_edges(spark):
    rows = [(1, "the cat and the dog are in the house", None, None, None), (2, None, None, "s", 0), (None, "mail me at x@y.org, the address of the house", "en", "s", 3), (4, "the cat and the dog are in the house", "en", "s", 3), (5, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows + [(10 + i, f"der hund und die katze sind in dem haus {i}", "de", "s", 1) for i in range(4)], DOCS)
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SMALL)
        assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
    got = {(r["doc_id"], r["text"]) for r in now.collect()}
    assert (None, "mail me at [EMAIL], the address of the house") in got and 1 not in {i for i, _ in got} and 5 not in {i for i, _ in got}
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0




# -- very long texts -------------------------------------------------------------------
def test_very_long_texts(spark):
    """A text of a megabyte, one without any white space, and a copy of a part of the first."""
    rnd = random.Random(9)
    words = [f"w{rnd.randrange(50_000)}" for _ in range(150_000)]
    texts = [" ".join(words), "x" * 400_000, " ".join(words[1000:1100]), "a@b.co " * 20_000]
    docs = table(spark, texts)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute_removed(dict(enumerate(texts)), 13) and got[2][1] == 100
    sets = {r["doc_id"]: r["n_shingles"] for r in ngram_join.join(docs).collect()}
    assert sets[0] == len(set(zip(words, words[1:], words[2:]))) and sets[1] == 1 and sets[3] == 1
    assert all(r["kept"] for r in exact_dedup.dedup(docs).collect())
    assert {r["doc_id"]: r["n_email"] for r in pii.digests(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 20_000}
    check_packing(entry.packing.pack_documents(docs, entry.vocabulary()).collect(), {i: texts[i] for i in range(4)}, 1024, tokenizer)
    assert {r["doc_id"]: (r["n_assign"], r["n_hex"]) for r in entry.secrets.digests(docs).collect()} == {i: (0, 0) for i in range(4)}
