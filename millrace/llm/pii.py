"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs,
plus signs, digits, scheme marks and cue words.  A local parser at each anchor
expands to the boundaries of what may stand there and validates it, so the text
between anchors is never looked at again.

Base kinds, leftmost and non-overlapping per kind, failing candidates consumed:
``email``, ``ip`` (four parts of at most 255), ``card`` (12 to 19 digits that
pass Luhn), ``phone`` (9 to 15 digits).  Added kinds: ``url_user`` (user data
in a URL's authority), ``iban`` (check digits hold), ``ssn`` and ``account``
(after their cue words) and ``address`` (house number, name and street word).

Offsets count code points, ends are exclusive.  Null and empty texts have no
spans; repeated rows give repeated results; extra columns are kept by
:func:`redact` and not read otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import ship
from .bpe import slices

#: The kinds in the order in which they are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url_user", "iban", "ssn", "account", "address")
KINDS = BASE_KINDS + ADDED_KINDS
_RANK = {k: i for i, k in enumerate(KINDS)}

#: Cue words.
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta")
SSN_CUES = ("ssn", "social security")
STREET_CUES = ("street", "avenue", "road", "boulevard", "lane", "drive")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/@?#<>\"']+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[\s:=#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_SSN = re.compile(r"(?: (?:no|number))?[\s:.=#]{1,3}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9])", re.ASCII)
_ACCOUNT = re.compile(r"(?:[ _-]?(?:no|nr|number|id))?\.?\s{0,2}[:=#]\s{0,2}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])", re.I | re.ASCII)
_HOUSE = re.compile(r"(?<![\w.,-])[0-9]{1,5}[A-Za-z]?$")
_IN_NAME = frozenset("abcdefghijklmnopqrstuvwxyz'-")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in (("iban", ("iban",)), ("account", ACCOUNT_CUES), ("ssn", SSN_CUES), ("street", STREET_CUES)):
        for cue in cues:
            for form in {cue, cue.title(), cue.upper(), cue.capitalize()}:
                a.add_word(form, (kind, len(cue)))
    a.make_automaton()
    return a


_anchors: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_holds(candidate: str) -> bool:
    moved = candidate[4:] + candidate[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _house(text: str, at: int) -> int | None:
    """Where the house number begins that stands before one to three capitalised names of any length and the place."""
    for _ in range(3):
        if at < 2 or text[at - 1] != " ":
            return None
        at -= 1
        last = at
        while at and text[at - 1] in _IN_NAME:
            at -= 1
        if at == last or not at or not "A" <= text[at - 1] <= "Z":
            return None
        at -= 1
        if at and text[at - 1] == " " and (found := _HOUSE.search(text, max(0, at - 7), at - 1)):
            return found.start()
    return None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start, then kind as listed."""
    if not text:
        return []
    if not _anchors:
        _anchors.append(_automaton())
    out: list[tuple[str, int, int]] = []
    after_email = after_ip = after_card = after_phone = 0
    for last, (anchor, width) in _anchors[0].iter(text):
        at, end = last - width + 1, last + 1
        if anchor == "digit":
            if at >= after_ip:
                run = _DOTTED.match(text, at)
                after_ip = run.end()
                if run.group().count(".") >= 3:
                    parts, begin = run.group().split("."), at
                    for k in range(0, len(parts) - len(parts) % 4, 4):
                        size = sum(map(len, parts[k : k + 4])) + 3
                        if all(map(_small, parts[k : k + 4])):
                            out.append(("ip", begin, begin + size))
                        begin += size + 1
            if at >= after_card:
                run = _CARD.match(text, at)
                after_card = run.end() if run else end
                if run:
                    digits = run.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, after_card))
        elif anchor == "at":
            start = at
            while start > after_email and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, end) if start < at else None
            if domain:
                after_email = domain.end()
                out.append(("email", start, after_email))
        elif anchor == "plus":
            run = _PHONE.match(text, at) if at >= after_phone else None
            if run:
                after_phone = run.end()
                if 9 <= sum(map(str.isdigit, run.group())) <= 15:
                    out.append(("phone", at, after_phone))
        elif anchor == "scheme":
            run = _AUTHORITY.match(text, end)
            if run:
                out.append(("url_user", end, run.end()))
        elif anchor == "street":
            house = _house(text, at)
            if house is not None and not text[end : end + 1].isalpha():
                out.append(("address", house, end))
        elif anchor == "iban":
            run = _IBAN.match(text, end)
            if run:
                bare = run[1].replace(" ", "")
                for size in range(min(34, len(bare)), 14, -1):
                    if iban_holds(bare[:size]):
                        stop, seen = run.start(1), 0
                        while seen < size:
                            seen += text[stop] != " "
                            stop += 1
                        out.append(("iban", run.start(1), stop))
                        break
        else:
            run = (_SSN if anchor == "ssn" else _ACCOUNT).match(text, end)
            if run:
                out.append((anchor, run.start(1), run.end(1)))
    out = list(dict.fromkeys(out))
    out.sort(key=lambda s: (s[1], _RANK[s[0]], s[2]))
    return out


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span, or overlapping spans together, replaced by the name of the longest one's kind."""
    if not spans:
        return text
    merged: list[list] = []
    for kind, start, end in spans:
        if merged and start < merged[-1][2]:
            if end - start > merged[-1][3]:
                merged[-1][0], merged[-1][3] = kind, end - start
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end, end - start])
    out, at = [], 0
    for kind, start, end, _ in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans array<struct<kind, start, end>>)`` of every text.  No shuffle."""
    ship(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in slices(batches, text_col):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(spans, pa.list_(kind))], [id_col, "spans"])

    chosen = docs.select(id_col, text_col)
    return chosen.mapInArrow(run, f"`{id_col}` {dict(chosen.dtypes)[id_col]}, spans array<struct<kind: string, start: long, end: long>>")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    ship(docs.sparkSession)
    names = [id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]

    def run(batches):
        told = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        for batch in slices(batches, text_col):
            found = [find(t) for t in batch.column(text_col).to_pylist()]
            base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
            columns = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS]
            columns += [pa.array([hashlib.sha256(told(spans).encode()).hexdigest() for spans in base], pa.string()), pa.array(map(told, found), pa.string(), size=len(found))]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], names)

    chosen = docs.select(id_col, text_col)
    return chosen.mapInArrow(run, f"`{id_col}` {dict(chosen.dtypes)[id_col]}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; all other columns as they are."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in slices(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([redacted(t, find(t)) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)
