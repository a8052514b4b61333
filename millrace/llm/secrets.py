"""Secret scan with DataFrame expressions only.

*Base kinds*, leftmost and non-overlapping per kind, in code points: ``assign``
(a key word, a sign of assignment and a value of 6 or more characters),
``access`` (AKIA and more, 20 or more characters) and ``hex`` (24 or more).

*Randomness battery*, kind ``random``: every run of 20 or more characters that
could be an encoding and lies in no base span is tested.  Its encoding is
inferred from its characters; a run that fits none, such as a path or a URL that
ends in a key, is tested in its parts of 20 or more characters between slashes,
and a part that fits none in its letters and digits.  Over the alphabet three
statistics are taken: chi-squared against a uniform alphabet, the number of runs
above and below the alphabet's middle, and the serial correlation of neighbours.
A run is *compatible with random* when the three together do not reject
uniformity.

*False-discovery control.*  A run's p-value for being ordinary text is the inverse
of its likelihood ratio, uniform alphabet against a text's changes between small
letters, capitals, digits and signs (``CHANGES``, or the same with small letters
and capitals in each other's place, whichever fits better) and its letters
(``LETTERS``): a text reaches a ratio of r with a chance of 1 / r at most,
whatever its length.  The Benjamini-Hochberg rule then holds the share of false
discoveries in every band of lengths under ``FDR``, over all rows, from a
histogram of p-values of bounded size.

A run that begins before an assignment's key word ends at that word.  Null and
empty texts have no spans; repeated rows give repeated results; a text may be
one run of any length or hold any number of spans, at nearly linear cost; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import digest, materialize, text_or_empty

#: The base kinds and their patterns, in the order in which they are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a shorter run holds no longer one
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # likewise
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")
#: A run that is one base span.
BASE_RUN = "^(AKIA[A-Z0-9]{16,}|[0-9a-f]{24,})=*$"

#: Runs that are tested, and the encodings: name, pattern of the whole run, alphabet in order.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = [
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", _DIGITS + _LOWER),
    ("BASE36", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base62", r"^(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[0-9A-Za-z+/]+$", _DIGITS + _UPPER + _LOWER + "+/"),
    ("lower", r"^[a-z]+$", _LOWER),
    ("upper", r"^[A-Z]+$", _UPPER),
    ("base64url", r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[0-9A-Za-z_-]+$", _DIGITS + _UPPER + _LOWER + "_-"),
]
#: Parts of a run that fits no encoding, and parts of those.
PARTS = (r"[^/]{20,}", r"[A-Za-z0-9]{20,}")
#: Percent of the letters a to z in ordinary text.
LETTERS = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074]
#: Share of a letter that is drawn from all alike, so that one rare letter proves little.
LETTER_NOISE = 0.15
#: How text and names go on, by the character before: to a small letter, a capital, a digit, a sign.
CHANGES = [[0.88, 0.06, 0.03, 0.03], [0.55, 0.36, 0.05, 0.04], [0.16, 0.14, 0.62, 0.08], [0.50, 0.30, 0.15, 0.05]]
#: Spans that are put in a row at once: keeps the cost of many spans in one text near linear.
CHUNK = 256
#: Combined statistic (three squared z-scores) above which a run is not compatible with random: the 0.999 point for three.
UNIFORM_MOST = 16.3
#: Share of false discoveries per band of lengths; p-values are counted in steps of a quarter of a decade.
FDR = 0.01
STEPS, MOST_STEP = 4, 400


_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as array<struct<start, end, value>>: from what is found and what lies between.

    Offsets are running sums, taken within chunks and over the chunks' widths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda v, g: F.struct(g.alias("gap"), v.alias("value")))  # the last gap has no value
    zero = F.lit(0).cast("long")

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        here = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(here)).alias("out"))

    def run(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out")), step, lambda s: s["out"])

    def placed(chunks: Column) -> Column:
        widths = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda s, p: s + F.length(p["gap"]) + F.coalesce(F.length(p["value"]), F.lit(0))))
        before = lambda ws: F.transform(ws, lambda _, i: F.aggregate(F.slice(ws, F.lit(1), i), zero, lambda s, w: s + w))
        return F.flatten(F.zip_with(chunks, _let(widths, before), run))

    many = lambda ps: F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / CHUNK).cast("int"))
    cut = lambda ps: F.transform(many(ps), lambda c: F.slice(ps, c * CHUNK + 1, F.lit(CHUNK)))
    spans = F.filter(_let(_let(pairs, cut), placed), lambda s: s["end"].isNotNull())
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def _pieces(span: Column, parts: tuple[str, ...]) -> Column:
    """The candidate itself if it fits an encoding, else those of its parts that may."""
    if not parts:
        return F.array(span)
    fits = F.regexp_replace(span["value"], "=+$", "").rlike("|".join(pattern for _, pattern, _ in ENCODINGS))
    moved = lambda p: F.struct((span["start"] + p["start"]).alias("start"), (span["start"] + p["end"]).alias("end"), p["value"].alias("value"))
    cut = F.transform(_located(span["value"], parts[0]), moved)
    return F.when(fits, F.array(span)).otherwise(F.flatten(F.transform(cut, lambda p: _pieces(p, parts[1:]))))


def _log_text(kind: Column, prior: Column, letter: Column, swapped: bool) -> Column:
    """Log probability that a text goes on with a character of a kind and a share among its kind; any kind may begin it."""
    rows = CHANGES if not swapped else [[CHANGES[i][j] for j in (1, 0, 2, 3)] for i in (1, 0, 2, 3)]
    flat = F.array(*(F.lit(math.log(p)) for row in rows for p in row))
    return letter + F.when(prior < 0, math.log(0.25)).otherwise(F.element_at(flat, (prior * 4 + kind + 1).cast("int")))


def _characters(body: Column, alphabet: Column) -> Column:
    """Per character its place in the alphabet, its kind (small letter, capital, digit, sign) and log share among its kind."""
    total = sum(LETTERS)
    letters = F.array(*(F.lit(math.log((1 - LETTER_NOISE) * p / total + LETTER_NOISE / 26)) for p in LETTERS))

    def one(c: Column) -> Column:
        code = F.ascii(c)
        kind = F.when(code >= 97, 0).when((code >= 65) & (code <= 90), 1).when((code >= 48) & (code <= 57), 2).otherwise(3)
        share = F.when(code.between(97, 122), F.element_at(letters, code - 96)).when(code.between(65, 90), F.element_at(letters, code - 64)).when(code.between(48, 57), math.log(0.1)).otherwise(math.log(0.25))
        return F.struct(F.call_function("locate", c, alphabet).cast("double").alias("place"), kind.alias("kind"), share.alias("share"))

    return F.transform(F.filter(F.split(body, ""), lambda c: c != ""), one)


def _tested(span: Column) -> Column:
    """The battery on one candidate: struct<start, end, band, step, compatible>, null without an alphabet."""
    body = F.regexp_replace(span["value"], "=+$", "")
    alphabet = F.coalesce(*(F.when(body.rlike(pattern), F.lit(letters)) for _, pattern, letters in ENCODINGS), F.lit(""))
    tested = _let(F.struct(body.alias("body"), alphabet.alias("alphabet")), lambda x: F.when(x["alphabet"] != "", _let(_characters(x["body"], x["alphabet"]), lambda cs: _battery(span, cs, F.length(x["alphabet"]).cast("double")))))
    return tested


def statistics(characters: Column, k: Column) -> Column:
    """struct<n, z_chi, z_runs, z_serial, ratio>: the three statistics as z-scores, and the log likelihood ratio of random to text."""
    # sum of squared counts: a run of equal places in sorted order that grows from r to r + 1 adds 2r + 1
    zero = F.struct(F.lit(0.0).alias("prior"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def square(s: Column, x: Column) -> Column:
        again = x == s["prior"]
        return F.struct(x.alias("prior"), F.when(again, s["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"), (s["sum"] + F.when(again, 2.0 * s["run"] + 1.0).otherwise(F.lit(1.0))).alias("sum"))

    squares = F.aggregate(F.array_sort(F.transform(characters, lambda c: c["place"])), zero, square, lambda s: s["sum"])

    def walk(s: Column, c: Column) -> Column:
        x, inside = c["place"], s["prior"] >= 0
        return F.struct(
            x.alias("prior"),
            c["kind"].alias("kind"),
            (s["above"] + F.when(x > k / 2, 1.0).otherwise(0.0)).alias("above"),
            (s["runs"] + F.when(inside & ((x > k / 2) == (s["prior"] > k / 2)), 0.0).otherwise(1.0)).alias("runs"),
            (s["s"] + x).alias("s"),
            (s["ss"] + x * x).alias("ss"),
            (s["lag"] + F.when(inside, s["prior"] * x).otherwise(0.0)).alias("lag"),
            F.when(inside, s["first"]).otherwise(x).alias("first"),
            (s["text"] + _log_text(c["kind"], s["kind"], c["share"], False)).alias("text"),
            (s["caps"] + _log_text(c["kind"], s["kind"], c["share"], True)).alias("caps"),
        )

    start = F.struct(F.lit(-1.0).alias("prior"), F.lit(-1).alias("kind"), *(F.lit(0.0).alias(c) for c in ("above", "runs", "s", "ss", "lag", "first", "text", "caps")))
    facts = F.struct(F.size(characters).cast("double").alias("n"), squares.alias("squares"), F.aggregate(characters, start, walk).alias("w"))

    def told(f: Column) -> Column:
        n, w = f["n"], f["w"]
        chi = k / n * f["squares"] - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        up, down = w["above"], n - w["above"]
        twice = 2 * up * down
        spread = F.sqrt(F.greatest(twice * (twice - n) / (n * n * (n - 1)), F.lit(1e-9)))
        z_runs = F.when(twice > n, (w["runs"] - twice / n - 1) / spread).otherwise(F.lit(9.0))
        # circular serial correlation: its mean is -1 / (n - 1)
        around = w["lag"] + w["first"] * w["prior"]
        variance = n * w["ss"] - w["s"] * w["s"]
        z_serial = F.when(variance > 0, (n * around - w["s"] * w["s"]) / variance * F.sqrt(n) + 1 / F.sqrt(n)).otherwise(F.lit(9.0))
        ratio = -n * F.log(k) - F.greatest(w["text"], w["caps"])
        return F.struct(n.alias("n"), z_chi.alias("z_chi"), z_runs.alias("z_runs"), z_serial.alias("z_serial"), ratio.alias("ratio"))

    return _let(facts, told)


def _battery(span: Column, characters: Column, k: Column) -> Column:
    def verdict(t: Column) -> Column:
        uniform = F.pow(F.greatest(t["z_chi"], F.lit(0.0)), 2) + t["z_runs"] * t["z_runs"] + t["z_serial"] * t["z_serial"]
        step = F.least(F.greatest(F.floor(t["ratio"] / math.log(10) * STEPS), F.lit(0)), F.lit(MOST_STEP)).cast("int")
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.floor(F.log2(t["n"]) * 2).cast("int").alias("band"), step.alias("step"), (uniform <= UNIFORM_MOST).alias("compatible"))

    return _let(statistics(characters, k), verdict)


def _candidates(text: Column, assigned: Column) -> Column:
    """Runs outside the assignments, whose spans are ``assigned``, that aren't base spans themselves."""
    gap = F.zip_with(F.split(text, ASSIGN, -1), F.concat(F.array(F.lit(0).cast("long")), F.transform(assigned, lambda s: s["end"])), lambda g, at: F.struct(at.alias("at"), g.alias("gap")))
    gaps = F.when(F.size(assigned) > 0, gap).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("at"), text.alias("gap"))))
    moved = lambda g: F.transform(_located(g["gap"], CANDIDATE), lambda s: F.struct((s["start"] + g["at"]).alias("start"), (s["end"] + g["at"]).alias("end"), s["value"].alias("value")))
    pieces = F.flatten(F.transform(F.flatten(F.transform(gaps, moved)), lambda s: _pieces(s, PARTS)))
    return F.filter(pieces, lambda s: ~s["value"].rlike(BASE_RUN))


def _thresholds(candidates: DataFrame) -> dict[int, int]:
    """Per band of lengths the lowest step that Benjamini and Hochberg's rule accepts; at most a row per band and step is kept."""
    steps = candidates.select(F.explode("tests").alias("t")).groupBy("t.band", "t.step").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("band").orderBy(F.desc("step"))
    ranked = steps.withColumn("rank", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("band")))
    # a step's p-values are at most 10^(-step / STEPS)
    accepted = ranked.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= F.lit(FDR) * F.col("rank") / F.col("m"))
    return {r["band"]: r["step"] for r in accepted.groupBy("band").agg(F.min("step").alias("step")).collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans array<struct<start, rank, kind, end>>)`` of every text, by start, then kind as listed."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    text = F.col("text")
    assigned = F.col("assigned")
    values = F.when(F.size(assigned) > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    assign = F.filter(F.zip_with(assigned, values, lambda s, v: F.struct(s["start"], s["end"], F.length(v).alias("n"))), lambda s: s["n"] >= ASSIGN_VALUE)
    named = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    base = F.concat(named(assign, "assign"), named(_located(text, ACCESS), "access"), named(_located(text, HEX), "hex"))
    tests = F.filter(F.transform(_candidates(text, assigned), _tested), lambda t: t.isNotNull())
    told = rows.withColumn("assigned", _located(text, ASSIGN)).select("id", base.alias("base"), tests.alias("tests"))
    found = materialize(told, "secrets")
    limits = _thresholds(found)
    # the bands are a constant number, so their limits fit in the expression
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)) if limits else None
    added = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    if limit is not None:
        accepted = F.filter("tests", lambda t: t["compatible"] & (t["step"] >= F.coalesce(F.element_at(limit, t["band"]), F.lit(MOST_STEP + 1))))
        added = named(accepted, "random")
    return found.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", added)).alias("spans"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scan(docs, id_col, text_col).select(id_col, *counts, digest(told(base)).alias("base_sha256"), told(F.col("spans")).alias("spans"))
