"""Spelling variants against a comparison of all words, with shards of any size, and edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from millrace.llm import entry, spelling_variants as V
from tests.oracle import assert_same

SCHEMA = "doc_id bigint, text string"


def counted(docs):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    n = counted(docs)
    near = {w: [o for o in n if abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in n}
    best = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n)


def told(spark, docs):
    got = V.group(spark.createDataFrame(docs, SCHEMA))
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in got.collect())


def edited(of, word, letters):
    i, kind = of.randrange(len(word)), of.randrange(3)
    return word[:i] + ["", of.choice(letters), of.choice(letters) + word[i]][kind] + word[i + 1 :]


def corpus(seed, bases, letters, variants=12):
    of = random.Random(seed)
    out = []
    for b in range(bases):
        base = "".join(of.choice(letters) for _ in range(of.choice([7, 7, 8, 9, 12, 15])))
        words = [base] * of.choice([3, 40, 400]) + [w for _ in range(variants) for w in [edited(of, edited(of, base, letters) if of.random() < 0.4 else base, letters)] * of.choice([1, 2, 3, 30])]
        of.shuffle(words)
        out += [(len(out) + i, " ".join(words[i::3])) for i in range(3)]
    return out


@pytest.mark.parametrize("letters", ["ab", "aeéÿÀBn", "abcdefghijklmnop"])
def test_same_as_comparing_all_words(spark, letters):
    docs = corpus(2, 40, letters)
    expected = brute(docs)
    assert told(spark, docs) == expected
    assert sum(r[2] for r in expected) > 300


@pytest.mark.parametrize("most", [1, 3, 20])
def test_shards_dealt_out_again(spark, monkeypatch, most):
    docs = corpus(4, 25, "abc")
    monkeypatch.setattr(V, "WORDS", most)
    assert told(spark, docs) == brute(docs)
    largest = V.dealt(V.words(spark.createDataFrame(docs, SCHEMA))).groupBy("shard").count().agg({"count": "max"}).first()[0]
    # all but one letter is shared in the last shards
    assert largest <= max(most, 3 + 9)


def test_small_blocks_of_matches(monkeypatch):
    of = random.Random(9)
    words = sorted({"".join(of.choice("abc") for _ in range(of.choice([7, 8]))) for _ in range(400)})
    expected = {(a, b) for a in words for b in words if len(a) == 7 and a[:3] == b[:3] and one_edit(a, b) and (len(b) == 8 or a < b)}

    def pairs():
        import numpy as np

        shards = [w[:3] for w in words]
        at = {s: i for i, s in enumerate(sorted(set(shards)))}
        return {(words[i], words[j]) for a, b in V._pairs(words, np.array([at[s] for s in shards]), 7, "b") for i, j in zip(a.tolist(), b.tolist())}

    assert pairs() == expected
    monkeypatch.setattr(V, "MATCHES", 50)
    assert pairs() == expected


def test_chains_of_forms(spark):
    times = [("abcdefgz", 2), ("abcdefg", 30), ("abcdefgh", 400), ("abcdefghi", 5000), ("abcdefghij", 60_000)]
    docs = [(1, " ".join(w for w, n in times for _ in range(n)))]
    got = {r[0]: r for r in told(spark, docs)}
    assert got == {r[0]: r for r in brute(docs)}
    forms = {w: r[3] for w, r in got.items()}
    assert forms["abcdefg"] == "abcdefgh" and forms["abcdefghi"] == "abcdefghij"
    assert {r[5] for r in got.values()} <= {"abcdefghij", *(w for w in got if forms[w] is None)}


def test_equal_counts_take_the_first_word(spark):
    docs = [(i, "abcdefh abcdefi abcdefg") for i in range(40)] + [(100, "abcdefz"), (101, "abcdefz")]
    assert told(spark, docs) == brute(docs)


def test_nothing_and_awkward_texts(spark):
    assert told(spark, []) == []
    docs = [(1, None), (None, "Wordword WORDWORD wordword"), (2, ""), (3, "a" * 100_000 + " " + "a" * 100_001), (4, "a" * 100_000 + " " + "a" * 100_001), (4, "École×÷ÿt école×÷ÿt"), (4, "x" * 70 + "\U0001f600" + "Ābcdefgh")] * 2
    assert told(spark, docs) == brute(docs)


def test_other_columns(spark):
    frame = spark.createDataFrame([(1, "abcdefgh abcdefgh", 1, 2, 3)], SCHEMA + ", word int, N int, form int")
    assert [tuple(r) for r in V.group(frame).collect()] == [("abcdefgh", 2, 0, None, None, "abcdefgh")]


def test_same_rows_as_sql(spark):
    assert_same(spark, "/root/testdata/sf0.01", entry.QUERIES, entry.ORACLE_SQL, "op12_spelling_variants")
