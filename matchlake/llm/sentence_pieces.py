"""Offset-preserving encoding and decoding with a SentencePiece BPE model.

A text is normalised by the longest prefixes in the model's compiled character map (a double-array
trie over UTF-8 bytes); every normalised byte remembers the source byte it came from. The merges run
over units that no piece of the vocabulary reaches beyond (white space marks with the letters or the
signs that follow), so a unit's pieces are worked out once and kept. The borders of the pieces, counted in normalised bytes,
go back through the alignment and give each piece its span of source bytes. A byte piece that is
not the last of its character has an empty span, as in the library.
"""

from __future__ import annotations

import heapq
import re
import struct
from itertools import repeat
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import by_batch

#: Bytes that the units kept by a Python worker may take, by estimate; beyond half of it those not
#: met since the last time are forgotten and made again.
CACHE_BYTES = 120_000_000
#: Code points normalised at a time where the character map is empty; cut in front of a space.
CHUNK_CHARS = 200_000
#: Longer units are not kept, and their merges run over a heap.
SHORT_UNIT = 64

MARK = "▁"
_CUT = re.compile("(?<=[^ ▁]) ")
_NEVER = float("inf")
# kinds of pieces in a model file
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def fields(data: bytes) -> dict[int, list]:
    """Fields of a protocol buffer message by number: integers, or bytes."""
    found: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else number()
            value = data[at : at + size]
            at += size
        found.setdefault(tag >> 3, []).append(value)
    return found


class CharacterMap:
    """The compiled map of a normaliser: byte strings and what replaces them."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.values = blob[4 + size :]
        self.steps: list[int] = self.units.tolist()
        chars = re.escape("".join(self._firsts()))
        self.first = re.compile(f"[{chars}]") if chars else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _firsts(self) -> list[str]:
        """Code points that some key begins with."""
        if not len(self.units):
            return []
        found, labels = [], np.arange(256)
        todo = [(b"", self._offset(self.steps[0]))]
        while todo:
            prefix, node = todo.pop()
            at = node ^ labels
            ok = at < len(self.units)
            ok[ok] = (self.units[at[ok]] & 0x800000FF) == labels[ok]
            for label in np.flatnonzero(ok[1:]) + 1:
                grown = prefix + bytes([label])
                try:
                    found.append(grown.decode())
                except UnicodeDecodeError:
                    if len(grown) < 4:
                        place = node ^ int(label)
                        todo.append((grown, place ^ self._offset(self.steps[place])))
        return found

    def longest(self, data: bytes) -> tuple[int, bytes]:
        """(length, replacement) of the longest key that ``data`` begins with; length 0 if none."""
        steps, size, best = self.steps, len(self.steps), (0, b"")
        node = self._offset(steps[0])
        for i, byte in enumerate(data):
            node ^= byte
            if node >= size or steps[node] & 0x800000FF != byte:
                break
            unit = steps[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = steps[node] & 0x7FFFFFFF
                best = i + 1, self.values[value : self.values.index(b"\0", value)]
        return best


class PieceModel:
    """One model file: BPE with byte fallback, without user-defined or unused pieces."""

    def __init__(self, data: bytes):
        model = fields(data)
        pieces = [fields(p) for p in model[1]]
        trainer = fields(model.get(2, [b""])[0])
        rules = fields(model.get(3, [b""])[0])
        kinds = [p.get(3, [_NORMAL])[0] for p in pieces]
        one = lambda message, field, default: message.get(field, [default])[0]
        if one(trainer, 3, 1) != 2 or not one(trainer, 35, 0) or set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("the model is not a BPE with byte fallback and without user-defined or unused pieces")
        if one(trainer, 24, 0) or not one(rules, 5, 1) or one(fields(model.get(5, [b""])[0]), 2, b""):
            raise ValueError("white space as suffix, plain white space and denormalisation are not supported")
        self.dummy, self.squeeze = bool(one(rules, 3, 1)), bool(one(rules, 4, 1))
        self.map = CharacterMap(one(rules, 2, b""))
        texts = [p[1][0].decode() for p in pieces]
        self.ids = {t: i for i, t in enumerate(texts) if kinds[i] == _NORMAL}
        score = [struct.unpack("<f", p[2][0])[0] if 2 in p else 0.0 for p in pieces]
        self.cost = {t: -score[i] for t, i in self.ids.items()}
        self.packed = {t: i | len(t.encode()) << 32 for t, i in self.ids.items()}
        self.byte_ids = [0] * 256
        for i, t in enumerate(texts):
            if kinds[i] == _BYTE:
                self.byte_ids[int(t[1:-1], 16)] = i
        self.begin, self.end = texts.index("<s>"), texts.index("</s>")
        # a unit ends where a mark follows something else, unless a piece crosses that border
        crossing = any(re.search(f"[^{MARK}]{MARK}", t) for t in self.ids)
        self.unit = re.compile("(?s).+" if crossing else self._units())
        self.in_parts = self.map.first is None and not self.squeeze and not crossing
        # pieces of a unit, as 64-bit integers: width in normalised bytes, then id
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known_bytes = 0
        # decoding: bytes of every id; what stands for an unknown one is a setting of the model
        unknown = one(trainer, 44, " ⁇ ".encode())
        self.surface = [
            b"" if k == _CONTROL else unknown if k == _UNKNOWN
            else bytes([int(t[1:-1], 16)]) if k == _BYTE else t.replace(MARK, " ").encode()
            for t, k in zip(texts, kinds)
        ]
        self.is_byte = [k == _BYTE for k in kinds]
        self.marked = [k == _NORMAL and t.startswith(MARK) for t, k in zip(texts, kinds)]
        self.shown = [k != _CONTROL for k in kinds]
        self.hidden = {i for i, k in enumerate(kinds) if k == _CONTROL}

    def _units(self) -> str:
        """Pattern of units: marks with signs, or with other characters, or alone.

        Signs are the ASCII characters beside letters that stand in no piece next to another character.
        """
        signs = {chr(c) for c in range(1, 128) if not chr(c).isalpha() and chr(c) != " "}
        beside: dict[str, set[str]] = {}
        for piece in self.ids:
            for a, b in zip(piece, piece[1:]):
                beside.setdefault(a, set()).add(b)
                beside.setdefault(b, set()).add(a)
        while mixed := {c for c in signs if beside.get(c, set()) - signs - {MARK}}:
            signs -= mixed
        if not signs:
            return f"{MARK}*[^{MARK}]+|{MARK}+"
        some = "".join(map(re.escape, sorted(signs)))
        return f"{MARK}*[^{MARK}{some}]+|{MARK}*[{some}]+|{MARK}+"

    # ---- normalisation -----------------------------------------------------

    def _mapped(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(bytes, source byte of each, number of source bytes) after the character map."""
        data = text.encode()
        raw = np.frombuffer(data, np.uint8)
        if self.map.first is None or not self.map.first.search(text):
            return raw, np.arange(len(raw)), len(raw)
        out: list[bytes] = []
        widths: list[int] = []
        sources: list[int] = []
        done = char = source = 0  # done: code points; source: bytes of them

        def plain(upto: int) -> None:
            nonlocal done, source
            run = text[done:upto].encode()
            out.append(run)
            widths.extend([1] * len(run))
            sources.extend(range(source, source + len(run)))
            done, source = upto, source + len(run)

        while found := self.map.first.search(text, char):
            char = found.start()
            window = text[char : char + 64].encode()
            length, value = self.map.longest(window)
            if not length:
                char += 1
                continue
            plain(char)
            out.append(value)
            widths.append(len(value))
            sources.append(source)
            char = done = done + len(window[:length].decode())
            source += length
        plain(len(text))
        return np.frombuffer(b"".join(out), np.uint8), np.repeat(np.array(sources, np.int64), widths), len(raw)

    def normalise(self, text: str, first: bool = True) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source byte."""
        if not text:
            return "", np.zeros(1, np.int64)
        data, source, end = self._mapped(text)
        space = data == 32
        if self.squeeze:
            keep = np.ones(len(data), bool)
            keep[1:] = ~(space[1:] & space[:-1])
            keep[:1] = ~space[:1]
            data, source, space = data[keep], source[keep], space[keep]
            if not len(data):
                return "", np.zeros(1, np.int64)
        source = np.append(np.repeat(source, np.where(space, 3, 1)), end)
        plain = data.tobytes().decode().replace(" ", MARK)
        if self.dummy and first:
            plain, source = MARK + plain, np.append(np.repeat(source[:1], 3), source)
        if self.squeeze:  # marks at the end go, whatever they stand for
            left = plain.rstrip(MARK)
            plain, source = left, source[: len(source) - 3 * (len(plain) - len(left))]
        return plain, source

    # ---- merges ------------------------------------------------------------

    def _merge_short(self, unit: str) -> list[str]:
        parts, look = list(unit), self.cost.get
        pairs = list(map(look, map(add, parts, parts[1:]), repeat(_NEVER)))
        while pairs:
            best = min(pairs)
            if best == _NEVER:
                break
            i = pairs.index(best)  # the leftmost of equal ones
            both = parts[i] + parts.pop(i + 1)
            parts[i] = both
            del pairs[i]
            if i:
                pairs[i - 1] = look(parts[i - 1] + both, _NEVER)
            if i < len(pairs):
                pairs[i] = look(both + parts[i + 1], _NEVER)
        return parts

    def _merge_long(self, unit: str) -> list[str]:
        parts: list[str] = list(unit)
        n, cost = len(parts), self.cost
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n:
                both = parts[left] + parts[right]
                if both in cost:
                    heapq.heappush(heap, (cost[both], left, right, len(both)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not parts[left] or not parts[right] or after[left] != right or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left] += parts[right]
            parts[right] = ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]

    def pieces(self, unit: str) -> bytes:
        """Widths in normalised bytes and ids of a unit's pieces."""
        made = self.older.get(unit)
        if made is None:
            out: list[int] = []
            for part in self._merge_short(unit) if len(unit) <= SHORT_UNIT else self._merge_long(unit):
                there = self.packed.get(part)
                if there is not None:
                    out.append(there)
                else:  # the last byte holds the character
                    raw = part.encode()
                    out += [self.byte_ids[b] for b in raw]
                    out[-1] |= len(raw) << 32
            made = struct.pack(f"<{len(out)}Q", *out)
        if len(unit) <= SHORT_UNIT:
            if self.known_bytes > CACHE_BYTES // 2:
                self.older, self.known, self.known_bytes = self.known, {}, 0
            self.known_bytes += 230 + 2 * len(unit) + len(made)
            self.known[unit] = made
        return made

    def encode(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(ids as little-endian 32-bit integers, first source byte of each piece, byte after its last)."""
        ids: list[bytes] = []
        starts: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        base = 0
        for number, part in enumerate(self._parts(text)):
            plain, source = self.normalise(part, number == 0)
            known = self.known.get
            found = np.frombuffer(b"".join([known(u) or self.pieces(u) for u in self.unit.findall(plain)]), "<u8")
            ids.append((found & 0xFFFFFFFF).astype("<u4").tobytes())
            after = np.cumsum(found >> 32, dtype=np.int64)
            ends.append(source[after] + base)
            starts.append(source[np.append(np.zeros(1, np.int64), after[:-1])] + base if len(after) else after)
            base += int(source[-1])
        return b"".join(ids), np.concatenate(starts), np.concatenate(ends)

    def _parts(self, text: str):
        """The text in parts that normalise and merge apart from each other."""
        at = 0
        while self.in_parts and len(text) - at > CHUNK_CHARS:
            found = _CUT.search(text, at + CHUNK_CHARS)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    # ---- decoding ----------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that form no character become U+FFFD each."""
        low, high = 0, len(ids)
        while low < high and not self.shown[ids[low]]:
            low += 1
        while low < high and not self.shown[ids[high - 1]]:
            high -= 1
        ids = ids[low:high]
        if not ids:
            return ""
        parts = [self.surface[i] for i in ids]
        if self.marked[ids[0]] and (self.dummy or self.squeeze):
            parts[0] = parts[0][1:]
            if self.squeeze:
                self._without_marks(ids, parts)
        try:
            if self.hidden.isdisjoint(ids):  # an id that shows nothing parts bytes
                return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
        out, run = [], []
        for i, part in zip(ids, parts):
            if self.is_byte[i]:
                run.append(part)
            else:
                out += [_each_byte(b"".join(run)), part.decode()]
                run = []
        return "".join([*out, _each_byte(b"".join(run))])

    def _without_marks(self, ids: list[int], parts: list[bytes]) -> None:
        """A squeezing model takes the mark off every piece until something is shown."""
        for k, i in enumerate(ids):
            if self.marked[i]:
                parts[k] = self.surface[i][1:]
            if parts[k]:
                break


def _each_byte(data: bytes) -> str:
    """Characters of a run of byte pieces; a byte that begins none becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append("�")
        at += size
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a file, one per Python process."""
    if path not in _MODELS:
        with open(path, "rb") as f:
            _MODELS[path] = PieceModel(f.read())
    return _MODELS[path]


def encode(documents: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, ids, starts, ends, covered.

    ``ids`` are little-endian unsigned 32-bit integers with the begin and the end id; ``starts`` and
    ``ends`` give the UTF-8 bytes of the source that each id stands for, the begin and the end id
    none; ``covered`` is the sum of the spans. A null text counts as empty: two ids. An empty table
    gives no rows. Rows are independent, so repeated rows, null ids and further columns of any
    name change nothing. Long texts are encoded in parts, cut in front of spaces where no piece crosses.
    """

    def make():
        m = model(path)
        first, last = struct.pack("<I", m.begin), struct.pack("<I", m.end)

        def run(rows: dict) -> dict:
            out: dict[str, list] = {n: [] for n in ("n_bytes", "n_tokens", "ids", "starts", "ends", "covered")}
            for text in rows["text"]:
                size = len(text.encode()) if text else 0
                ids, starts, ends = m.encode(text or "")
                out["n_bytes"].append(size)
                out["n_tokens"].append(len(ids) // 4 + 2)
                out["ids"].append(first + ids + last)
                out["starts"].append(np.concatenate([[0], starts, [size]]).astype(np.int32))
                out["ends"].append(np.concatenate([[0], ends, [size]]).astype(np.int32))
                out["covered"].append(int((ends - starts).sum()))
            return {"doc_id": rows["doc_id"], **out}

        return run

    return by_batch(
        documents.select(F.col("doc_id").cast("long"), "text"), make,
        "doc_id long, n_bytes long, n_tokens long, ids binary, starts array<int>, ends array<int>, covered long",
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the text of its ids as ``decoded``; null ids count as none."""

    def make():
        m = model(path)

        def run(rows: dict) -> dict:
            ids = [np.frombuffer(x or b"", "<u4").tolist() for x in rows["ids"]]
            return {**rows, "decoded": [m.decode(x) for x in ids]}

        return run

    return by_batch(
        encoded.select("doc_id", "n_tokens", "ids"), make, "doc_id long, n_tokens long, ids binary, decoded string"
    )
