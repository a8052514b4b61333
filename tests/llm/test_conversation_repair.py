"""Conversation repair against a search over all edits, and its edge cases."""

import hashlib
import heapq
import itertools
import re
import zlib
from collections import defaultdict

import pytest

from millrace.llm import conversation_repair as C, entry
from tests.oracle import assert_same

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(rows):
    """Least (cost, audit) by Dijkstra's search over (rows done, roles so far), with the repaired turns."""
    lawful = re.compile(r"(s?(ua)*u?)?\Z")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, tail, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for r, _ in out)):
            return cost, audit, out
        if (i, tail) in done:
            continue
        done.add((i, tail))
        nexts = [(2, "I", i, (role, "")) for role in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            nexts.append((3, "D", i + 1, None))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                nexts += [(more, "K", i + 1, (role, text))] * bool(role) + [(2 + more, "R", i + 1, (r, text)) for r in ("user", "assistant")]
        for extra, letter, j, turn in nexts:
            new = out + ((turn,) if turn else ())
            initials = "".join(r[0] for r, _ in new)
            if lawful.match(initials):
                # what may follow depends on whether there is anything and on the last role
                heapq.heappush(heap, (cost + extra, audit + letter, j, initials[-1:], new))


def brute(rows):
    by, ids = defaultdict(list), {}
    known = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        ids[conv] = True
        h = zlib.crc32(f"{known(conv)}:{known(turn)}".encode()) % 20
        role, text = known(role), known(text)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        by[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = []
    for conv in ids:
        mine = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faulty = set(), []
        for turn, role, text in mine:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        many = lambda f: sum(x[2] == f for x in faulty)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        cost, audit, told = cheapest(faulty)
        out.append((conv, gaps, many("blank"), many("duplicate"), many("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()))
    return sorted(out, key=repr)


def told(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in C.repair(frame).collect()), key=repr)


def random_rows(seed, conversations, longest):
    import random

    of = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(of.randint(1, longest)):
            role = of.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "Users", "aside"])
            rows.append((conv, of.choice([turn, turn, turn, turn + 2, None]), role, of.choice(["Yes.", "no", " ", "", None, "Why?\n", "x! ", "Ein Satz, lang", "é.", f"t{turn}."])))
    return rows


def test_same_as_a_search_over_all_edits(spark):
    rows = random_rows(5, 300, 9)
    assert told(spark, rows) == brute(rows)


@pytest.mark.parametrize("segment,batch", [(1, 4), (3, 10), (7, 1)])
def test_segments_change_nothing(spark, monkeypatch, segment, batch):
    """Segments are joined in the task itself, so they are run here over plain batches."""
    rows = [r for r in random_rows(8, 40, 30)]
    turns = C.numbered(C.damaged(spark.createDataFrame(rows, SCHEMA))).select("conv_id", "place", "initial", "fault").coalesce(1).sortWithinPartitions("conv_id", "place").toArrow()
    whole = [t.to_pylist() for t in C._solve(iter(turns.to_batches()))]
    monkeypatch.setattr(C, "SEGMENT", segment)
    monkeypatch.setattr(C, "BATCH", batch)
    parts = [t.to_pylist() for t in C._solve(iter(turns.to_batches(max_chunksize=3)))]
    assert sum(parts, []) == sum(whole, [])


def test_a_long_conversation(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]
    ((conv, gaps, blank, duplicate, truncated, illegal, cost, audit, digest),) = told(spark, rows)
    turns, state = [], 0
    assert gaps > 0 and blank > 50 and duplicate > 50 and truncated > 50 and illegal > 50
    assert audit.count("D") >= blank + duplicate and len(audit.replace("I", "")) > 2900
    assert cost == 3 * audit.count("D") + 2 * (audit.count("R") + audit.count("I")) + sum(1 for _ in range(truncated)) - _deleted_truncated(spark, rows, audit)


def _deleted_truncated(spark, rows, audit):
    faults = [r.fault for r in C.numbered(C.damaged(spark.createDataFrame(rows, SCHEMA))).orderBy("place").collect()]
    return sum(letter == "D" and fault == "truncated" for letter, fault in zip(audit.replace("I", ""), faults, strict=True))


def test_turns_after_the_repair(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "tool", "")], SCHEMA)
    audits = C.repairs(C.numbered(rows))
    assert [tuple(r) for r in audits.collect()] == [(1, 5, "RKD")]
    assert [tuple(r) for r in C.repaired(rows, audits).orderBy("place").collect()] == [(1, 1, "user", "Hi."), (1, 2, "assistant", "Yes.")]


def test_nothing_and_other_columns(spark):
    assert told(spark, []) == []
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert told(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    clash = spark.createDataFrame([(3, 1, "user", "Hi.", 5, 6)], SCHEMA + ", place int, Cost int")
    assert C.repair(clash).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert C.repair(clash).count() == 1


def test_null_conversation(spark):
    rows = [(None, None, "user", "Hi."), (None, 1, "assistant", "Yes."), (2, 0, "system", "Be kind."), (None, 2, None, "?")]
    assert told(spark, rows) == brute(rows)


def test_very_long_text(spark):
    rows = [(1, 0, "user", "x" * 2_000_000 + "."), (1, 2, "assistant", " " * 1_000_000)]
    assert told(spark, rows) == brute(rows)


def test_same_rows_as_sql(spark):
    assert_same(spark, "/root/testdata/sf0.01", entry.QUERIES, entry.ORACLE_SQL, "op13_conversation_repair")
