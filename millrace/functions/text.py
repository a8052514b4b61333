"""Text expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Families of models that take another kind of token limit.
LIMIT_FAMILIES = ("gpt-5", "o1", "o3", "o4")
NOT_FOUND = "[FILE NOT FOUND]"


def normalize(text: Column) -> Column:
    """Lower case; everything but a-z and 0-9 separates words; one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def token_set(text: Column) -> Column:
    """Distinct words of the normalised text; a text without any has the empty set."""
    return F.array_remove(F.array_distinct(F.split(normalize(F.coalesce(text, F.lit(""))), " ")), "")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    """A text's lines, at every line end that Python knows."""
    return F.split(unix_lines(text), "[\n\x0b\x0c\x1c\x1d\x1e\x85  ]")


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def percent(share: Column) -> Column:
    """A share as a percentage with one decimal."""
    return F.format_string("%.1f%%", share * 100)


def truncated(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, or a mark where there is no file."""
    return F.coalesce(F.left(text, F.lit(limit)), F.lit(NOT_FOUND))


def after_last(text: Column, mark: str) -> Column:
    """What follows the last ``mark``; empty without one."""
    return F.when(F.contains(text, F.lit(mark)), F.substring_index(text, mark, -1)).otherwise(F.lit(""))


def toml_category(text: Column) -> Column:
    return F.regexp_extract(text, r'(?U)category\s*=\s*"([^"]+)"', 1)


def model_slug(model: Column) -> Column:
    return F.lower(F.substring_index(model, "/", -1))


def takes_other_limit(model: Column) -> Column:
    return model_slug(model).rlike("^(" + "|".join(LIMIT_FAMILIES) + ")")


def safe_file_name(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("-"))


def stem_or(name: Column, other: Column) -> Column:
    """A file name without its extension; else another name; else ``task``."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"(?<=.)\.[^.]*$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.nullif(other, F.lit("")), F.lit("task"))


def tenths(value: Column) -> Column:
    """A double with one decimal, rounded on its exact binary value, ties to even; for magnitudes under 10^9.

    Half of a tenth is compared exactly: the value is split in two parts whose twentyfold is exact, and the sign of
    a sum of two doubles is always right.
    """
    high = value * 134217729.0 - (value * 134217729.0 - value)
    below = F.floor(value * 10)
    over = (high * 20 - (2 * below + 1)) + (value - high) * 20
    up = F.when(over > 0, 1).when(over < 0, 0).otherwise(F.abs(below % 2))
    return F.when(~F.isnan(value), (below + up) / F.lit(10.0))


def size_label(octets: Column) -> Column:
    """A size in KB, or in MB from one of these on."""
    kb = octets / 1024.0
    return F.when(kb < 1024, F.format_string("%.1f KB", tenths(F.greatest(kb, F.lit(0.1))))).otherwise(F.format_string("%.1f MB", tenths(kb / 1024)))


def unique_matches(text: Column, pattern: str, most: int) -> Column:
    """Distinct matches in order of appearance, ``most`` at most (a report shows no more)."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), 1, most)


def first_error(notes: Column) -> Column:
    """The first note of a source that failed or returned nothing; null without one."""
    return F.get(F.filter(notes, lambda n: F.lower(n).rlike("failed|returned")), F.lit(0))
