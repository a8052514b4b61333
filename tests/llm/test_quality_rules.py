"""Quality counts against a plain reading, the robust estimate against NumPy, and edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import entry, quality_rules as Q

SCHEMA = "doc_id bigint, text string, lang string, source string"


def plain(text):
    """Words, their characters, symbols, copied lines, words in repeated windows."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def vector(n, chars, symbols, lines, repeats):
    told = math.log(max(n, 1)), math.log(max(chars, 1) / max(n, 1)), math.log1p(1000 * symbols / max(chars, 1)), math.log1p(1000 * lines / max(n, 1)), math.sqrt(repeats / max(n, 1))
    return [math.floor(1000 * x + 0.5) for x in told]


def robust(x):
    """Centre and covariance of one group, step by step in NumPy."""
    floors = np.array([0.5, 0.1, 0.5, 0.7, 0.15]) * 1000

    def moments(y, factor):
        return y.mean(0), factor * np.cov(y.T, bias=True) + np.diag(floors**2)

    def distance(m, c, y=x):
        return np.einsum("ni,ij,nj->n", y - m, np.linalg.inv(c), y - m)

    low, median, high = np.percentile(x, [25, 50, 75], axis=0)
    spread = np.sqrt(((high - low) / 1.349) ** 2 + floors**2)
    starts = [(median, np.diag(spread**2)), moments(np.floor(np.clip(x, median - 2 * spread, median + 2 * spread) + 0.5), 1.0)]
    ends = []
    for m, c in starts:
        for _ in range(5):
            bins = np.floor(np.log2(np.maximum(distance(m, c), 1e-6)) * 32)
            last = np.sort(bins)[math.ceil(0.75 * len(x)) - 1]
            m, c = moments(x[bins <= last], 1.4126)
        ends.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(ends, key=lambda e: e[0])
    return moments(x[distance(m, c) <= 12.8325], 1.0549), distance


def texts(seed, many):
    of = random.Random(seed)
    words = ["".join(of.choice("abcdefghijklmnop") for _ in range(of.randint(2, 9))) for _ in range(400)]
    for i in range(many):
        n = int(of.lognormvariate(5, 0.7)) + 1
        text = " ".join(of.choice(words) + ("\n" if of.random() < 0.05 else "") for _ in range(n))
        if i % 11 == 0:
            text = re.sub(r"(\w)\b", r"\1###", text)
        if i % 17 == 0:
            text += "\n" + "\n".join([text.split("\n")[0]] * 2)
        if i % 29 == 0:
            text = " ".join(of.choice(words[:4]) for _ in range(n))
        yield text


def test_counts_of_awkward_texts(spark):
    of = random.Random(3)
    cases = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\n\nx\n \nx\n", "é ü #*", "\U0001f600 b\x0bc\x0cd", "<a|b>&%$"] + ["".join(of.choice("ab \n\t|#") for _ in range(of.randint(0, 60))) for _ in range(300)]
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(cases)], SCHEMA)
    got = {r.doc_id: tuple(r[c] for c in Q.COUNTS) for r in Q.counts(frame).collect()}
    assert got == {i: plain(t) for i, t in enumerate(cases)}


def frame_of(spark, seed=1):
    cells = [("en", "a", 900), ("en", "b", 300), ("de", "a", 400), ("de", "rare", 95), ("de", "rarer", 85), (None, None, 150), ("fr", "x", 20)]
    rows, at = [], 0
    for k, (lang, source, many) in enumerate(cells):
        for text in texts(seed + k, many):
            rows.append((at, text, lang, source))
            at += 1
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def judged(spark):
    rows, frame = frame_of(spark)
    return rows, frame, {r.doc_id: r for r in Q.judge(frame).collect()}


def test_same_as_numpy(judged):
    rows, _, got = judged
    base, group, x = {}, {}, {}
    for doc, text, lang, source in rows:
        n, *others = counts = plain(text)
        base[doc] = n < 50 or 100 * counts[4] > 50 * n
        x[doc] = vector(*counts)
        group[doc] = "de" if source in ("rare", "rarer") else None if lang == "fr" else (lang, source)
    for g in set(group.values()):
        mine = [d for d in x if group[d] == g and not base[d]]
        if len(mine) < 100:
            assert g is None and all(got[d].kept and got[d].distance is None for d in mine)
            continue
        (m, c), distance = robust(np.array([x[d] for d in mine], float))
        for d, far in zip(mine, distance(m, c, np.array([x[d] for d in mine], float))):
            assert got[d].distance == pytest.approx(far, rel=1e-6, abs=1e-6)
            assert got[d].kept == (far <= 65)
    assert all(got[d].base_failed == base[d] and (not base[d] or not got[d].kept) for d in base)


def test_junk_goes_and_text_stays(judged):
    rows, _, got = judged
    junk = {d for d, text, lang, _ in rows if text.count("#") > 20 and lang != "fr"}
    passed = {d for d in got if not got[d].base_failed}
    assert len(junk & passed) > 100
    assert not any(got[d].kept for d in junk)
    assert all(got[d].kept for d in passed - junk)


def test_estimates_without_a_broadcast_are_the_same(spark, judged, monkeypatch):
    _, frame, got = judged
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 0)
    assert {r.doc_id: r for r in Q.judge(frame).collect()} == got


def test_the_order_of_rows_changes_nothing(spark, judged):
    _, frame, got = judged
    again = Q.judge(frame.orderBy(F.desc("doc_id")).repartition(3, "source"))
    assert {r.doc_id: r for r in again.collect()} == got


def test_equal_documents_have_a_distance(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, text, "en", "s") for i in range(500)] + [(500, text + " |" * 400, "en", "s"), (501, None, None, "s"), (500, "", "en", None)]
    got = sorted(map(tuple, Q.judge(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "base_failed", "kept").collect()))
    assert got[:500] == [(i, False, True) for i in range(500)]
    assert got[500:] == [(500, False, False), (500, True, False), (501, True, False)] or got[500:] == [(500, True, False), (500, True, False), (501, True, False)]


def test_nothing_and_clashing_columns(spark):
    assert Q.judge(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = spark.createDataFrame([(1, "a b", "en", "s", 7, 8, 9)], SCHEMA + ", words int, G int, x0 int")
    assert [tuple(r)[:8] for r in Q.judge(clash).collect()] == [(1, 2, 2, 0, 0, 0, True, False)]


def test_a_very_long_text(spark):
    words = [f"w{i % 99_991}" for i in range(300_000)]
    frame = spark.createDataFrame([(1, " ".join(words), "en", "s")], SCHEMA)
    assert tuple(Q.counts(frame).first())[3:] == plain(" ".join(words))


def test_no_python_on_the_way(spark):
    frame = spark.createDataFrame([(1, "a b c", "en", "s")], SCHEMA)
    plan = Q.judge(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_has_every_document(spark):
    sf = "/root/testdata/sf0.001"
    got = entry.QUERIES["op11_quality_rules"](spark, sf)
    docs = {r.doc_id: r.text for r in entry.documents(spark, sf).collect()}
    assert {r.doc_id: tuple(r)[1:6] for r in got.collect()} == {d: plain(t) for d, t in docs.items()}
