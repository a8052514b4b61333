"""BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words go into a trie; one depth-first walk propagates, for every node,
the *last token* of the BPE encoding of the node's prefix.  Because a sequence
of tokens is the BPE encoding of a text exactly when each adjacent pair is
stable (no earlier merge would have crossed their border), the last token of a
prefix is the one suffix token that is stable next to the last token of the
prefix before it.  A prefix that many words share is therefore encoded once,
and a word's ids are read back along its last tokens.

Edge cases: a null or empty text has no ids and decodes to the empty text;
repeated rows give repeated results; extra columns are not read; the special
tokens of the vocabulary file are matched in texts as the file's library does.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from ._shared import ship

#: Distinct words, and runs without white space, whose ids a worker keeps; beyond it they start anew (results don't depend on it).
CACHE_WORDS, CACHE_RUNS = 400_000, 500_000
#: The code points of Unicode's White_Space property, as a character class.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"

_NONE = -1


def _class_of(initial: str) -> str:
    """The code points whose general category starts with ``initial``, as the inside of a character class."""
    out, start = [], None
    for cp in range(sys.maxunicode + 2):
        inside = cp <= sys.maxunicode and unicodedata.category(chr(cp))[0] == initial
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}" + (f"-\\U{cp - 1:08x}" if cp - 1 > start else ""))
            start = None
    return "".join(out)


def _word_pattern() -> re.Pattern:
    """The byte-level split: contractions, letters, numbers, other marks, white space."""
    letters, numbers, space = _class_of("L"), _class_of("N"), WHITE_SPACE
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            table[chr(extra)] = b
            extra += 1
    return table


class TrieEncoder:
    """A byte-level BPE vocabulary; ``ids_of`` encodes the distinct words of a batch together."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        as_bytes = lambda piece: bytes(letters[c] for c in piece)
        vocab = spec["model"]["vocab"]
        self.id_of = {as_bytes(piece): i for piece, i in vocab.items()}
        self.bytes_of = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for piece, i in self.id_of.items():
            self.bytes_of[i] = piece
        self.special = {}
        for t in spec["added_tokens"]:
            self.special[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        #: rank of the merge that makes a token; single bytes come before all merges
        self.rank = [_NONE] * len(self.bytes_of)
        self.parts = [(i, i) for i in range(len(self.bytes_of))]
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            left, right = as_bytes(left), as_bytes(right)
            token = self.id_of[left + right]
            pair = self.id_of[left], self.id_of[right]
            self.merged[pair] = token
            self.rank[token], self.parts[token] = rank, pair
        #: by their last three bytes, the lengths of the tokens that can end there, longest first
        self.sizes: dict[bytes, tuple[int, ...]] = {}
        by_tail: dict[bytes, set[int]] = {}
        for piece in self.id_of:
            if len(piece) > 2:
                by_tail.setdefault(piece[-3:], set()).add(len(piece))
        self._by_tail = by_tail
        self.pattern = _word_pattern()
        self.run_pattern = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._stable: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    # -- stability -----------------------------------------------------------------
    def whole(self, token: int) -> bool:
        """Whether the encoding of the token's bytes is the token itself."""
        known = self._whole.get(token)
        if known is None:
            left, right = self.parts[token]
            known = self.rank[token] < 0 or (self.whole(left) and self.whole(right) and self._border_holds(left, right, self.rank[token]))
            self._whole[token] = known
        return known

    def _border_holds(self, left: int, right: int, before: int) -> bool:
        """No merge of a rank under ``before`` joins the two tokens' edges while they are being built.

        Undo the later of the two tokens' own merges step by step: at each step the pair that
        faces the border existed until that merge was done, so a merge of this pair that ranks
        earlier would have been taken first.  On equal ranks the left one is done first.
        """
        rank, merged, parts = self.rank, self.merged, self.parts
        while True:
            token = merged.get((left, right))
            if token is not None and rank[token] < before:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                before = rank[left]  # at this rank, the inner merge on the left came first
                left = parts[left][1]
            else:
                before = rank[right] + 1  # a merge of the same rank starting further left wins
                right = parts[right][0]

    def _sizes_of(self, tail: bytes) -> tuple[int, ...]:
        own = set(self._by_tail.get(tail, ())) | {k for k in (1, 2) if tail[-k:] in self.id_of and len(tail) >= k}
        out = self.sizes[tail] = tuple(sorted(own, reverse=True))
        return out

    # -- the trie ------------------------------------------------------------------
    def _learn(self, words: set[str]) -> None:
        """Walk the trie of the words depth first and keep each word's ids.

        The trie is held as its words in sorted order, which is its depth-first order: the prefix
        that a word shares with the one before it is the path from the root that both share, and
        the last tokens along that path stand in ``last`` already.
        """
        get, border, known, whole, cache = self.id_of.get, self._border_holds, self._stable, self.whole, self.cache
        sizes, sizes_of = self.sizes.get, self._sizes_of
        if len(known) > 400_000:
            known.clear()
        last: list[int] = [_NONE]  # by depth: the last token of that prefix, and where it starts
        since: list[int] = [0]
        path = b""
        for word in sorted(w.encode() for w in words):
            size = len(word)
            shared, most = 0, min(len(path), size)
            if word[:most] == path[:most]:
                shared = most
            else:
                while word[shared] == path[shared]:
                    shared += 1
            del last[shared + 1 :], since[shared + 1 :]
            path = word
            for end in range(shared + 1, size + 1):
                tail = word[end - 3 : end] if end > 2 else word[:end]
                for length in sizes(tail) or sizes_of(tail):
                    start = end - length
                    if start < 0:
                        continue
                    token = get(word[start:end])
                    if token is not None:
                        if start:
                            pair = last[start], token
                            holds = known.get(pair)
                            if holds is None:
                                holds = known[pair] = whole(token) and border(*pair, sys.maxsize)
                        else:
                            holds = whole(token)
                        if holds:
                            last.append(token)
                            since.append(start)
                            break
                else:
                    raise ValueError("the vocabulary lacks a single byte")
            ids, at = [], size
            while at:
                ids.append(last[at])
                at = since[at]
            ids.reverse()
            cache[word.decode()] = array("I", ids).tobytes()

    # -- texts ---------------------------------------------------------------------
    def _pieces(self, text: str) -> list[str]:
        """The text's runs without white space, each with the space before it, and white space between them.

        How a run splits into words depends on the run alone, so its ids can be kept as a whole.
        """
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self.run_pattern.findall(text)
        pieces = []
        for i, part in enumerate(self.special_pattern.split(text)):
            pieces += [part] if i % 2 else self.run_pattern.findall(part)
        return pieces

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """Per text, its ids as native unsigned 32-bit integers."""
        if len(self.runs) > CACHE_RUNS:
            self.runs.clear()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [self._pieces(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.runs)
        words_of = {run: [run] if run in self.special else self.pattern.findall(run) for run in new}
        unknown = set(chain.from_iterable(words_of.values())).difference(self.cache)
        for special in unknown & self.special.keys():
            self.cache[special] = array("I", [self.special[special]]).tobytes()
        if unknown := unknown - self.special.keys():
            self._learn(unknown)
        of, runs = self.cache.__getitem__, self.runs
        for run, words in words_of.items():
            runs[run] = of(words[0]) if len(words) == 1 else b"".join(map(of, words))
        return [b"".join(map(runs.__getitem__, pieces)) for pieces in split]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], np.uint32).tolist()

    def decode(self, ids) -> str:
        """The text of the ids; bytes that form no character become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The vocabulary of ``path``, read once per worker."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of ``column``, so that memory doesn't follow the texts' length."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` of every text."""
    ship(docs.sparkSession)

    def run(batches):
        own = encoder(vocabulary)
        for batch in slices(batches, text_col):
            ids = [np.frombuffer(x, np.uint32).astype(np.int32) for x in own.encode_packed(batch.column(text_col).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    chosen = docs.select(id_col, text_col)
    return chosen.mapInArrow(run, f"`{id_col}` {dict(chosen.dtypes)[id_col]}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)`` of every id list; a null list gives the empty text."""
    ship(encoded.sparkSession)

    def run(batches):
        own = encoder(vocabulary)
        for batch in batches:
            texts = [own.decode(ids or ()) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    chosen = encoded.select(id_col, ids_col)
    return chosen.mapInArrow(run, f"`{id_col}` {dict(chosen.dtypes)[id_col]}, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass and keep the digests of both sides.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256``.  No shuffle: a row
    depends on its own text alone.
    """
    ship(docs.sparkSession)

    def run(batches):
        own = encoder(vocabulary)
        decimal = list(map(str, range(len(own.bytes_of))))
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in slices(batches, text_col):
            counts, of_ids, of_text = [], [], []
            for packed in own.encode_packed(batch.column(text_col).to_pylist()):
                ids = np.frombuffer(packed, np.uint32).tolist()
                counts.append(len(ids))
                of_ids.append(sha(",".join(map(decimal.__getitem__, ids)).encode()))
                of_text.append(sha(own.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(id_col, F.col(text_col))
    return chosen.mapInArrow(run, f"`{id_col}` {dict(chosen.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
