"""Exact token counts at every prefix, by prefix dynamic programming over a byte-level BPE.

For a pre-token the table runs over its byte positions: the encoding of a prefix ends with the one
token whose predecessor, the last token of the prefix before it, is compatible with it (their
concatenation encodes to just these two), so ``count[i] = count[i - len(token)] + 1``. A text is a
chain of units (white space and what follows up to the next white space) that never merge with
each other, so the counts of a text are those of its units added up. Counts are stored as one signed
byte per code point, the change of the count: sums of its beginning answer any question about
truncation or budgets without encoding anything again.
"""

from __future__ import annotations

import gc
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import by_batch

#: Units kept per Python worker; the tables of others are made again.
CACHE_UNITS = 600_000

_WS = "\t-\r \x85\xa0  -     　"
_UNIT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LEADING = re.compile(f"[{_WS}]*")
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if _LEADING.match(c).end())
#: Tables of pre-tokens that begin alike share this many bytes.
_SHARED = 5
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


def _byte_chars() -> dict[int, str]:
    """Printable stand-ins for the 256 bytes, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class PrefixCounter:
    """Tables of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in _byte_chars().items()}

        def raw(token: str) -> bytes:
            return bytes(byte[c] for c in token)

        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        tokens = {raw(t) for t in spec["model"]["vocab"] if t not in set(self.special)}
        self.longest = max(map(len, tokens))
        self.tails = {t[i:] for t in tokens for i in range(len(t))}
        self.tokens = tokens
        self.whole: dict[bytes, bool] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.heads: dict[bytes, tuple[list[int], list[bytes]]] = {}
        self.pieces: dict[str, bytes | list[int]] = {}
        self.units: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE: merge the leftmost pair of the lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _whole(self, token: bytes) -> bool:
        """True if the token's own bytes encode to it."""
        known = self.whole[token] = token in self.tokens and self.merge(token) == [token]
        return known

    def _fits(self, before: bytes, token: bytes) -> bool:
        """True if the two tokens side by side encode to just these two."""
        if len(self.pairs) >= CACHE_UNITS:
            self.pairs.clear()
        known = self.pairs[before, token] = self.merge(before + token) == [before, token]
        return known

    def table(self, data: bytes) -> list[int]:
        """Token counts of all byte prefixes of a pre-token, from the empty one on."""
        head = data[:_SHARED]
        known = self.heads.get(head) if len(data) > _SHARED else None
        counts, last = (known[0][:], known[1][:]) if known else ([0], [b""])
        tails, whole, pairs = self.tails, self.whole, self.pairs
        for i in range(len(counts), len(data) + 1):
            for start in range(i - 1, -1, -1):
                token = data[start:i]
                if token not in tails:
                    raise ValueError(f"no encoding of {data[:i]!r}")
                ok = whole.get(token)
                if ok is None:
                    ok = self._whole(token)
                if not ok:
                    continue
                if start == 0:
                    break
                before = last[start]
                ok = pairs.get((before, token))
                if ok is None:
                    ok = self._fits(before, token)
                if ok:  # at most one token fits
                    break
            counts.append(counts[start] + 1)
            last.append(token)
        if not known and len(data) > _SHARED:
            if len(self.heads) >= CACHE_UNITS // 8:
                self.heads.clear()
            self.heads[head] = counts[: _SHARED + 1], last[: _SHARED + 1]
        return counts

    def piece(self, text: str) -> bytes | list[int]:
        """Token counts of all code point prefixes of a pre-token, without the empty one."""
        known = self.pieces.get(text)
        if known is None:
            rows = self.table(text.encode("utf-8", "surrogatepass"))
            if len(rows) == len(text) + 1:
                known = rows[1:]
            else:
                known, at = [], 0
                for c in text:
                    o = ord(c)
                    at += 1 if o < 128 else 2 if o < 2048 else 3 if o < 65536 else 4
                    known.append(rows[at])
            if len(text) < 256:  # a count is at most the number of code points, but for wide ones
                known = bytes(known) if max(known) < 256 else known
            if len(self.pieces) >= CACHE_UNITS:
                self.pieces.clear()
            self.pieces[text] = known
        return known

    def unit(self, text: str) -> bytes:
        """Changes of the count per code point of a unit, as signed bytes."""
        known = self.units.get(text)
        if known is not None:
            return known
        counts: list[int] = []
        for piece in _PRETOKEN.findall(text):
            base = counts[-1] if counts else 0
            mine = self.piece(piece)
            counts += [base + n for n in mine]
            if piece in _LONG_CONTRACTIONS:  # cut after its first letter, quote and letter stand apart
                counts[-2] = base + 2
        if text[0] in _SPACES and len(text) > 1 and text[1] in _SPACES:
            # a prefix that ends inside leading white space is one run of it
            space = _LEADING.match(text).end()
            counts[:space] = self.piece(text[:space])
        out = bytes([(b - a) & 255 for a, b in zip([0, *counts], counts)])
        if len(self.units) >= CACHE_UNITS:
            self.units.clear()
        self.units[text] = out
        return out

    def deltas(self, text: str) -> bytes:
        """Changes of the exact token count, one signed byte per code point of the text."""
        unit, known = self.unit, self.units.get
        parts: list[bytes] = []
        last = ""
        for i, piece in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:  # one token; its own beginnings are ordinary text after the last unit
                inner = b"".join(map(unit, _UNIT.findall(last + piece[:-1])))
                whole = np.frombuffer(inner, np.int8).astype(np.int64)
                before = np.frombuffer(unit(last), np.int8).sum(dtype=np.int64) if last else 0
                counts = np.append(whole.cumsum()[len(last):], before + 1)
                parts.append(np.diff(counts, prepend=before).astype(np.int8).tobytes())
                last = ""
            elif piece:
                units = _UNIT.findall(piece)
                parts += [known(u) or unit(u) for u in units]
                last = units[-1]
        return b"".join(parts)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, one per Python process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
        gc.freeze()  # the tables hold no cycles: searching them again and again is lost time
        gc.set_threshold(200_000, 50, 50)
    return _COUNTERS[path]


def prefix_counts(documents: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, deltas.

    ``deltas`` holds a signed byte per code point of the whole text; the sum of its first p bytes is
    the exact token count of the first p code points. A null text counts as empty. Rows are
    independent, so repeated rows, null ids and further columns change nothing.
    """

    def make():
        def run(rows: dict) -> dict:
            c = counter(path)
            deltas = [c.deltas(t) if t else b"" for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"],
                "n_bytes": [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in rows["text"]],
                "n_tokens": [int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in deltas],
                "deltas": deltas,
            }

        return run

    return by_batch(
        documents.select(F.col("doc_id").cast("long"), "text"), make,
        "doc_id long, n_bytes long, n_tokens long, deltas binary",
    )


def tokens_of_prefix(deltas: bytes, chars: int) -> int:
    """Exact number of tokens of the first ``chars`` code points."""
    return int(np.frombuffer(deltas, np.int8)[:chars].sum(dtype=np.int64))


def longest_prefix(deltas: bytes, budget: int) -> int:
    """The largest number of code points whose encoding has at most ``budget`` tokens."""
    counts = np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0
