"""Scores, decisions and labels of similarity search."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Both scores from the first on, or meaning alone from the second on, block.
DUAL, MEANING = 0.60, 0.70
TOP_INSTRUCTIONS, TOP_TFIDF = 10, 5


def dice(common: Column, size_a: Column, size_b: Column) -> Column:
    """Twice the common words by all words; 0 where either side has none."""
    return F.when((size_a == 0) | (size_b == 0), F.lit(0.0)).otherwise(2.0 * common / (size_a + size_b))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(v: Column, w: Column, norm_v: Column, norm_w: Column) -> Column:
    """Cosine of two arrays of doubles, summed in order; 0 for empty, zero or unequally long ones."""
    dot = F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    usable = (F.size(v) > 0) & (F.size(v) == F.size(w)) & (norm_v > 0) & (norm_w > 0)
    return F.when(usable, dot / (norm_v * norm_w)).otherwise(F.lit(0.0))


def block_reason(lex: Column, sem: Column) -> Column:
    return F.when(sem.isNull(), "").when((lex >= DUAL) & (sem >= DUAL), "dual").when(sem >= MEANING, "meaning").otherwise("")


def flagged(lex: Column, sem: Column) -> Column:
    return block_reason(lex, sem) != ""


def method(lex: Column, sem: Column) -> Column:
    reason = block_reason(lex, sem)
    return F.when(reason == "dual", "dual-60").when(reason == "meaning", "meaning-70").when(sem >= DUAL, "semantic-high").when(lex >= DUAL, "lexical-only").otherwise("below-threshold")


def combined(lex: Column, sem: Column) -> Column:
    return F.greatest(lex, F.coalesce(sem, F.lit(0.0)))


def flag_label(blocked: Column, reason: Column, short: bool = False) -> Column:
    """Why a match is flagged, in the wording of reports or the shorter one of lists."""
    why = {"meaning": "YES · meaning ≥70%", "dual": "YES · both ≥60%"} if short else {"meaning": "YES (meaning ≥70%)", "dual": "YES (both ≥60%)"}
    return F.when(~blocked, "No").when(reason == "meaning", why["meaning"]).when(reason == "dual", why["dual"]).otherwise("YES")


def excludes(key: Column, name: Column) -> Column:
    """Whether a key is left out for a submission's own name; a blank name leaves out none."""
    return (F.trim(F.coalesce(name, F.lit(""))) != "") & F.contains(F.lower(key), F.lower(F.trim(name)))


def excludes_tfidf(key: Column, name: Column) -> Column:
    """The same without a guard: a blank name is part of every key, so it leaves out all."""
    return F.contains(F.lower(key), F.lower(F.coalesce(name, F.lit(""))))


def excludes_identical(key: Column, name: Column, text: Column, own_text: Column) -> Column:
    """Key equals, ends with or holds the name, or the stripped texts are the same; no name keeps all."""
    k, n = F.lower(key), F.lower(F.trim(name))
    return (F.trim(F.coalesce(name, F.lit(""))) != "") & ((k == n) | F.contains(k, n) | (F.trim(text) == F.trim(own_text)))
