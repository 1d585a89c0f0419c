"""Order-preserving packing of documents into training sequences.

Documents are encoded and laid out in their order; a dynamic program then chooses where to cut. A
window from cut i to cut j of at most ``size`` tokens costs its padding, and a cut inside a document
costs a penalty, less at the end of a sentence than elsewhere:

    best[j] = penalty[j] + size - at[j] + min(best[i] + at[i])   over at[j] - at[i] <= size

The minimum slides with j, so a monotone queue of candidates gives it in constant time. A window
whose length is a power of two needs no padding and is tried as well where both ends are cuts.
The rows of a task are packed in blocks of bounded size; nothing is shuffled.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 2048
SENTENCE_PENALTY = 8
INSIDE_PENALTY = 32
#: Cost of a sequence that is a shorter power of two: few full sequences are better than many short.
SHORT_PENALTY = 16
#: Shorter powers of two are not tried.
SHORTEST = 64
#: Tokens that are packed together; the last sequence of a block may be padded.
BLOCK_TOKENS = 2_000_000
#: Chunks between white space, and their words, whose ids a Python worker keeps.
CACHE_CHUNKS = 1_200_000
#: Words of letters that the library encodes as one text.
WORDS_AT_ONCE = 400
#: The id after each document.
END_ID = 1

_WS = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[^{_WS}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SIGNS = ".,;:!?"

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


class Encoder:
    """Ids of texts by a vocabulary file whose pre-tokenizer drops white space.

    What stands between white space is encoded apart from the rest, so its ids are kept and a
    text costs a look-up per chunk. Ids are little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.last = np.zeros(len(self.ends), bool)
        for token, i in vocab.items():
            self.ends[i] = bool(re.search(r"[.!?]+(</w>)?$", token))
            self.last[i] = token.endswith("</w>")

    def _learn_words(self, words: list[str]) -> None:
        """Ids of words of letters only, many per call: each is one pre-token and ends with ``</w>``."""
        for low in range(0, len(words), WORDS_AT_ONCE):
            part = words[low : low + WORDS_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                self.known.update(zip(part, (raw[a:b] for a, b in zip([0, *stops], stops))))
            else:  # a letter that is several characters in lower case
                self._learn_rest(part)

    def _learn_rest(self, chunks: list[str]) -> None:
        for c, e in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)):
            ids = e.ids
            self.known[c] = struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, chunks: set[str]) -> None:
        """Chunks of letters and signs behind them are put together of both; words and signs are chunks too."""
        known = self.known
        words, rest, parts = set(), set(), []
        for c in chunks:
            word = c.rstrip(_SIGNS)
            if word.isalpha():
                lower = word.lower() if word.isascii() else word
                words.add(lower)
                if lower != c:
                    tail = c[len(word) :]
                    rest.add(tail)
                    parts.append((c, lower, tail))
            else:
                rest.add(c)
        rest.discard("")
        known[""] = b""
        self._learn_words([w for w in words if w not in known])
        self._learn_rest([c for c in rest if c not in known])
        known.update({c: known[word] + known[tail] for c, word, tail in parts})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        # str.split parts at the same signs, and at four more that only few texts have
        chunked = [(_CHUNK.findall(t) if _SEPARATORS.search(t) else t.split()) if t else [] for t in texts]
        known = self.known
        if len(known) > CACHE_CHUNKS:
            known.clear()
        new = set().union(*chunked).difference(known)
        if new:
            self._learn(new)
        return [b"".join([known[c] for c in chunks]) for chunks in chunked]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])]


def choose_cuts(at: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Positions of the chosen cuts, 0 and the last one included.

    ``at``: increasing candidate positions from 0, at most ``size`` apart; ``penalty``: of a cut there.
    """
    n = len(at)
    partners: dict[int, list[int]] = {}
    power = SHORTEST
    while power < size:  # both ends of a short window without padding are candidates
        left = np.searchsorted(at, at - power)
        right = np.flatnonzero((at >= power) & (at[left] == at - power))
        for j, k in zip(right.tolist(), left[right].tolist()):
            partners.setdefault(j, []).append(k)
        power *= 2
    where, cost = at.tolist(), penalty.tolist()
    best, came = [0] * n, [0] * n
    low, who, front = [0], [0], 0  # the queue: best + at, increasing, and its cut
    for j in range(1, n):
        here = where[j]
        least = here - size
        while where[who[front]] < least:
            front += 1
        i = who[front]
        value = low[front] + size - here
        if j in partners:
            for k in partners[j]:
                if best[k] + SHORT_PENALTY < value:
                    value, i = best[k] + SHORT_PENALTY, k
        value += cost[j]
        best[j], came[j] = value, i
        value += here
        last = len(low)
        while last > front and low[last - 1] >= value:
            last -= 1
        del low[last:], who[last:]
        low.append(value)
        who.append(j)
    cuts, j = [where[-1]], n - 1
    while j > 0:
        j = came[j]
        cuts.append(where[j])
    return cuts[::-1]


def window_cuts(lengths: np.ndarray, sentence_ends: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Cut positions of a block of documents with these token counts, from 0 to the total.

    ``sentence_ends``: positions after a sentence. Stretches without a candidate get one every
    ``size`` tokens. A last window that would be padded more than further cuts cost is cut into
    powers of two.
    """
    docs = np.cumsum(lengths)
    total = int(docs[-1])
    at = _distinct(np.concatenate([[0], sentence_ends, docs]))
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > size)
    if len(wide):
        more = [np.arange(at[k] + size, at[k + 1], size) for k in wide]
        at = _distinct(np.concatenate([at, *more]))
    penalty = np.full(len(at), INSIDE_PENALTY)
    penalty[np.isin(at, sentence_ends)] = SENTENCE_PENALTY
    penalty[np.isin(at, docs)] = 0
    cuts = choose_cuts(at, penalty, size)
    rest = total - cuts[-2]
    if rest & (rest - 1) and (INSIDE_PENALTY + SHORT_PENALTY) * rest.bit_count() < size - rest:
        cuts.pop()
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                cuts.append(cuts[-1] + (1 << bit))
    return np.array(cuts, np.int64)


def _pack_block(doc_ids: list, ids: list[bytes], ends: np.ndarray, first_sequence: int, size: int) -> tuple[dict, int]:
    """Piece columns of a block of documents, and the number of its sequences."""
    stream = b"".join(ids)
    flat = np.frombuffer(stream, "<u4")
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    cuts = window_cuts(lengths, np.flatnonzero(ends[flat]) + 1, size)
    doc_end = np.cumsum(lengths)
    doc_start = doc_end - lengths
    edges = _distinct(np.concatenate([cuts, doc_end]))
    begin, length = edges[:-1], np.diff(edges)
    doc = np.searchsorted(doc_end, begin, side="right")
    sequence = np.searchsorted(cuts, begin, side="right") - 1
    pieces = [stream[4 * b : 4 * (b + n)] for b, n in zip(begin.tolist(), length.tolist())]
    return {
        "doc_id": [doc_ids[d] for d in doc.tolist()], "start": begin - doc_start[doc], "length": length,
        "ids_crc32": [zlib.crc32(p) for p in pieces], "doc_tokens": lengths[doc],
        "sequence_id": sequence + first_sequence, "offset": begin - cuts[sequence], "ids": pieces,
    }, len(cuts) - 1


def pack(documents: DataFrame, path: str, size: int = SIZE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Every document is its ids followed by ``END_ID``; a null or empty text is that id alone. Each id
    lies in exactly one piece; the pieces of a sequence have offsets from 0 without gaps. Rows are
    packed in the order of their partition; ``sequence_id`` carries the partition above 32 bits. Read
    ``documents`` from a table, so that a task that runs again sees the same order. Repeated rows are
    packed one by one, and an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    source = documents.select(F.col("doc_id").cast("long"), "text")
    kind = documents.sparkSession.createDataFrame([], SCHEMA).schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        doc_ids: list = []
        ids: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal doc_ids, ids, held, sequence
            if ids:
                columns, n = _pack_block(doc_ids, ids, enc.ends, sequence, size)
                sequence += n
                doc_ids, ids, held = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                for doc_id, x in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    doc_ids.append(doc_id)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= block_tokens:
                        yield from flush()
        yield from flush()

    return source.mapInArrow(run, kind)
