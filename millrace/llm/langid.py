"""Language identification with labelled spans.

*Script ranges* narrow the candidates: a word's first letter tells its script,
and only languages that use this script in the training rows compete for it.
*Per-word scores* are log probabilities of the word's characters under one
interpolated character trigram model per language.  *Viterbi* over the words,
with one penalty for each change of language, labels spans of mixed text; the
language with most letters on the best path is the document's.

The model is fitted on a bounded sample of labelled rows: of each label about
``SAMPLE_DOCS``, those with the smallest hashes of their identifier, so that a
rare language is learned from all that it has.  Its size is bounded by
``FEATURES`` times ``LANGUAGES``; more labels are an error, none is left out.
Prediction is a map over all rows.

Edge cases: letters are Unicode's category L, so numerals such as ½ or Ⅷ are
none; a null text, or one without a letter, is ``und`` with score 0; rows
without a label or text are never learned from; without any labelled row all
is ``und``; ties go to the language that sorts first; repeated rows are
predicted alike; an empty table gives an empty result; extra columns are kept
by :func:`keep_identified` and not read otherwise.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import ship
from .bpe import _class_of, slices

#: Rows of each label that the classifier is fitted on, about (a bounded sample), and labels at most.
SAMPLE_DOCS, LANGUAGES = 2_000, 200
#: Counters per language; n-grams are hashed into them.
FEATURES = 1 << 17
#: Log-probability cost of a change of language between two words.
SWITCH = 9.0
#: Strength of the lower order in the interpolation.
BACK_OFF = 4.0
#: A script belongs to a language when it has at least this share of the language's words.
SCRIPT_SHARE = 0.02
#: Words whose scores a worker keeps.
CACHE_WORDS = 150_000
UND = "und"
STEPS = 1_000_000_000

#: Where scripts begin, by code point; a letter's script is the last one that begins at or before it.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
]
_BEGINS = np.array([b for b, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_WORD = re.compile(f"[{_class_of('L')}]+")
#: The same for texts without numerals that are neither letters nor decimal digits, and several times as fast.
_PLAIN_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    own = _PLAIN_WORD.findall(text)
    return own if not own or "".join(own).isalpha() else _WORD.findall(text)


def _grams(words: list[str]):
    """The characters of lower-cased words with their hashed uni-, bi- and trigram, the word of each, and each word's script."""
    joined = "\n" + "\n".join(w.lower().replace("\n", "") for w in words) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)
    shift = np.uint64(21)
    prior = np.concatenate((codes[:1], codes[:-1]))
    prior2 = np.concatenate((codes[:1], codes[:1], codes[:-2]))
    prior2 = np.where(prior == 10, np.uint64(10), prior2)  # nothing is seen across a border
    one, two = mix(codes + np.uint64(1)), mix((prior << shift) + codes + np.uint64(1 << 45))
    three = mix((((prior2 << shift) + prior) << shift) + codes)
    context2 = mix((prior2 << shift) + prior + np.uint64(1 << 45))
    context1 = mix(prior + np.uint64(1))
    border = codes == 10
    word = np.cumsum(border) - 1
    first = np.flatnonzero(border)[:-1] + 1
    scripts = _SCRIPT[np.searchsorted(_BEGINS, codes[np.minimum(first, len(codes) - 1)], "right") - 1]
    keep = np.arange(len(codes)) > 0  # a word's end is seen as its border
    owner = np.where(border, word - 1, word)
    return one[keep], two[keep], three[keep], context1[keep], context2[keep], owner[keep], scripts


class Model:
    """Counts by feature and language, and which scripts each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs, self.counts = langs, counts
        share = scripts / np.maximum(1, scripts.sum(0))
        self.uses = share >= SCRIPT_SHARE

    def scores(self, words: list[str]) -> np.ndarray:
        """Per word and language, the log probability; languages without the word's script are held back."""
        one, two, three, context1, context2, owner, scripts = _grams(words)
        n = self.counts
        p = (n[one] + 0.5) / (n.sum(0) / 3 + 4096)
        p = (n[two] + BACK_OFF * p) / (n[context1] + BACK_OFF)
        p = (n[three] + BACK_OFF * p) / (n[context2] + BACK_OFF)
        out = np.zeros((len(words), len(self.langs)))
        logs = np.log(np.minimum(p, 1.0))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, logs[:, k], len(words))
        allowed = self.uses[scripts]
        none = ~allowed.any(1)
        return np.where(allowed | none[:, None], out, out.min(1, keepdims=True) - 4 * SWITCH)


def fit(docs: DataFrame, chosen: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE_DOCS) -> Model:
    """Fit on the rows where ``chosen`` holds and text and label are there; about ``sample`` identifiers of each label."""
    ship(docs.sparkSession)
    rows = docs.where(chosen & F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    label = F.col(label_col).cast("string")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(label.alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    # a label's share of the hashes' range, in steps of a billionth
    shares = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(STEPS, -(-sample * STEPS // n))))) if sizes else F.create_map().cast("map<string,bigint>")
    rows = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(STEPS)) < F.element_at(shares, label)).select(label.alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        for batch in slices(batches, "text"):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).extend(_words(text))
            for lang, words in by_lang.items():
                if not words:
                    continue
                one, two, three, _, _, _, scripts = _grams(words)
                seen = np.bincount(np.concatenate((one, two, three)), minlength=FEATURES)
                at = np.flatnonzero(seen)
                by_script = np.bincount(scripts, minlength=len(_NAMES))
                feature = np.concatenate((at, -1 - np.arange(len(_NAMES))))
                n = np.concatenate((seen[at], by_script))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(feature, pa.int64()), pa.array(n, pa.int64())], ["lang", "feature", "n"])

    # at most (FEATURES + scripts) rows a language reach the driver
    table = rows.mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts, scripts = np.zeros((FEATURES, len(langs)), np.float32), np.zeros((len(_NAMES), len(langs)))
    where = {x: i for i, x in enumerate(langs)}
    column = np.array([where[x] for x in table.column("lang").to_pylist()], np.int64)
    feature, n = table.column("feature").to_numpy(), table.column("n").to_numpy()
    real = feature >= 0
    counts[feature[real], column[real]] = n[real]
    scripts[-1 - feature[~real], column[~real]] = n[~real]
    return Model(langs, counts, scripts)


def best_paths(lengths: np.ndarray, words: np.ndarray, scores: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word.  ``words`` holds the documents' word numbers one after another.

    All documents take their t-th step together: with the longest first, those that still have a
    t-th word are a prefix, and a step is a handful of array operations.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), "left")
    value = np.zeros((len(sizes), scores.shape[1]))
    switched, best = [], []
    for t in range(steps):
        a = active[t]
        now = value[:a]
        top = now.argmax(1)
        jump = now[np.arange(a), top][:, None] - penalty
        switch = now < jump if t else np.zeros(now.shape, bool)
        value[:a] = np.where(switch, jump, now) + scores[words[starts[:a] + t]]
        switched.append(switch)
        best.append(top)
    state = value.argmax(1) if value.shape[1] else np.zeros(len(sizes), np.int64)
    path = np.empty(len(words), np.int8 if scores.shape[1] < 128 else np.int32)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        now = state[:a]
        path[starts[:a] + t] = now
        state[:a] = np.where(switched[t][np.arange(a), now], best[t], now)
    return path


class Labeller:
    """Scores of words seen by this worker, and the labelling of batches of texts."""

    def __init__(self, model: Model):
        self.model, self.known, self.scores = model, {}, np.zeros((0, len(model.langs)))

    def paths(self, texts: list[str | None]):
        """Per text its words (matches are found again only for spans), and per word of all texts its length and language."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.scores = {}, np.zeros((0, len(self.model.langs)))
        words = [_words(t) if t else [] for t in texts]
        new = list(set().union(*words).difference(self.known)) if words else []
        if new:
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
            self.scores = np.concatenate((self.scores, self.model.scores(new)))
        of = self.known.__getitem__
        numbers = np.array([i for w in words for i in map(of, w)], np.int64)
        letters = np.array([n for w in words for n in map(len, w)], np.int64)
        lengths = np.array(list(map(len, words)), np.int64)
        return lengths, letters, best_paths(lengths, numbers, self.scores)


def _predict(labeller: Labeller, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs = labeller.model.langs
    if not langs:
        return [UND] * len(texts), [0.0] * len(texts)
    lengths, letters, path = labeller.paths(texts)
    doc = np.repeat(np.arange(len(texts)), lengths)
    share = np.bincount(doc * len(langs) + path, letters, len(texts) * len(langs)).reshape(len(texts), len(langs))
    total = share.sum(1)
    top = share.argmax(1)
    score = share[np.arange(len(texts)), top] / np.maximum(1, total)
    return [langs[k] if n else UND for k, n in zip(top.tolist(), total.tolist(), strict=True)], np.where(total > 0, score, 0.0).tolist()


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)``; the score is the predicted language's share of the letters."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: FEATURES x languages

    def run(batches):
        labeller = Labeller(shared.value)
        for batch in slices(batches, text_col):
            lang, score = _predict(labeller, batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    chosen = docs.select(id_col, text_col)
    return chosen.mapInArrow(run, f"`{id_col}` {dict(chosen.dtypes)[id_col]}, lang_pred string, score double")


def label_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans array<struct<lang, start, end>>)``: runs of words of one language, in code points."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        labeller = Labeller(shared.value)
        langs = labeller.model.langs
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            path, at, out = labeller.paths(texts)[2] if langs else [], 0, []
            for text in texts:
                spans: list[dict] = []
                for m in _WORD.finditer(text or "") if langs else ():
                    lang = langs[path[at]]
                    at += 1
                    if spans and spans[-1]["lang"] == lang:
                        spans[-1]["end"] = m.end()
                    else:
                        spans.append({"lang": lang, "start": m.start(), "end": m.end()})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.list_(kind))], [id_col, "spans"])

    chosen = docs.select(id_col, text_col)
    return chosen.mapInArrow(run, f"`{id_col}` {dict(chosen.dtypes)[id_col]}, spans array<struct<lang: string, start: long, end: long>>")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that have no language; a missing label becomes the predicted one."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(shared.value)
        for batch in slices(batches, text_col):
            lang, _ = _predict(labeller, batch.column(text_col).to_pylist())
            at = batch.schema.get_field_index(label_col)
            field = batch.schema.field(at)
            batch = batch.set_column(at, field, pa.array([p if own is None else own for p, own in zip(lang, batch.column(at).to_pylist(), strict=True)], field.type))
            yield batch.filter(pa.array([x != UND for x in lang], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
