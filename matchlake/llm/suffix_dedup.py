"""Removal of long repeated byte strings with run-length indexes.

A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller id.

1. *Routing.* Of the strings' K-byte grams the one with the smallest hash decides where a string is
   looked at, so equal strings always meet. Neighbouring strings with one such gram form a piece (at
   most 2 * LENGTH - K bytes). Documents send two hashes per piece, packed by bucket.
   Buckets with many entries (hot pieces) are dealt in parts of bounded size: each part is reduced to the
   smallest and largest document of its distinct pieces, Spark aggregates those, and the pieces that are
   shared go back to the parts.
2. *Single pieces.* A gram with one distinct piece needs no text: all documents but the first lose it.
3. *Index.* Grams with several pieces (the ends of copies) send each distinct piece once. A task builds
   the Burrows-Wheeler transform of its pieces, keeps its runs with the last-to-first map of each run
   head, and samples at run ends: the smallest document of the suffix interval that shares LENGTH bytes.
   The pieces stream backwards through the runs, all in lockstep, and every long match is marked.
4. *Removal.* Marks go back to their documents, which drop the bytes.

No Python group holds all documents of a piece; what grows with its copies is one mark per copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import by_batch, staged

LENGTH, K = 50, 24
SPAN = LENGTH - K + 1
#: Text bytes whose pieces share a bucket, pieces of one index, text bytes hashed at once.
BUCKET_BYTES, INDEX_PIECES, CHUNK_BYTES = 8 << 20, 10_000, 256 << 10
#: Entries (one per document and piece) of a bucket that are one Python group; about 0.6 million are usual.
PART_ENTRIES = 1_500_000

_END = 0xFF  # in no UTF-8 text
_RANDOM = np.random.default_rng(7)
_TABLE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_ALL = (1 << 63) - 1


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        with np.errstate(over="ignore"):
            _POWERS[base] = np.cumprod(np.append(np.uint64(1), np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)))
    return _POWERS[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done, step = x, 1
    while step * 2 <= width:
        done = np.minimum(done[:-step], done[step:])
        step *= 2
    rest = width - step
    return np.minimum(done[: len(done) - rest], done[rest:]) if rest else done


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, strings, gram, key) of all pieces; start is inside the document.

    ``gram`` is the hash of the deciding gram, ``key`` that of the piece's bytes. Texts beyond CHUNK_BYTES are
    hashed in parts that overlap, so a piece may be cut there, never a string.
    """
    parts: list[tuple[int, int, bytes]] = []
    for d, text in enumerate(texts):
        for low in range(0, max(len(text) - LENGTH + 1, 0), CHUNK_BYTES):
            parts.append((d, low, text[low : low + CHUNK_BYTES + LENGTH - 1]))
    found = []
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for part in [*parts, None]:
        if group and (part is None or held + len(part[2]) > CHUNK_BYTES):
            found.append(_pieces(group))
            group, held = [], 0
        if part:
            group.append(part)
            held += len(part[2]) + 1
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _pieces(group: list[tuple[int, int, bytes]]):
    sizes = np.array([len(x[2]) + 1 for x in group])
    raw = np.frombuffer(b"\xff".join(x[2] for x in group) + b"\xff", np.uint8)
    begin = np.cumsum(sizes) - sizes
    n = len(raw)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[raw] * _powers(_BASE, n), out=sums[1:])
        back = _powers(_INVERSE, n)
        gram = _mixed((sums[K:] - sums[:-K]) * back[: n - K + 1])
        order = (gram & ~np.uint64((1 << 24) - 1)) | np.arange(len(gram), dtype=np.uint64)  # leftmost of equals
        at = (_sliding_min(order, SPAN) & np.uint64((1 << 24) - 1)).astype(np.int64)  # per string start
        part = np.repeat(np.arange(len(group)), sizes)
        valid = part[: len(at)] == part[LENGTH - 1 : LENGTH - 1 + len(at)]
        valid &= raw[LENGTH - 1 : LENGTH - 1 + len(at)] != _END
        starts = np.flatnonzero(valid)
        if not len(starts):
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        decide = at[starts]
        first = np.append(True, (decide[1:] != decide[:-1]) | (part[starts[1:]] != part[starts[:-1]]))
        head = np.flatnonzero(first)
        count = np.diff(np.append(head, len(starts)))
        s = starts[head]
        e = s + count + LENGTH - 1
        key = _mixed((sums[e] - sums[s]) * back[s] + count.astype(np.uint64))
        owner = part[s]
    docs = np.array([x[0] for x in group])[owner]
    lows = np.array([x[1] for x in group])[owner]
    return docs, s - begin[owner] + lows, count, gram[decide[head]], key


def piece_id(gram: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One signed 64-bit name of a piece: 16 bits of its gram and 48 of its bytes, as buckets keep them."""
    return (((gram >> np.uint64(24)) << np.uint64(48)) | (key & np.uint64((1 << 48) - 1))).view(np.int64)


def _refined(rank: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Ranks of values whose equals are told apart by ``by``; a rank is the place of the first of its equals."""
    pair = (rank << 32) | by
    o = np.argsort(pair)
    pair = pair[o]
    new = np.append(True, pair[1:] != pair[:-1])
    old = np.append(True, pair[1:] >> 32 != pair[:-1] >> 32)
    at, more = np.flatnonzero(new), np.cumsum(new) - 1
    out = np.empty(len(rank), np.int64)
    out[o] = (pair >> 32) + at[more] - np.flatnonzero(old)[np.cumsum(old) - 1]
    return out


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a set of pieces, with samples at its runs.

    Suffixes end with their piece and equal ones stand in the order of the pieces, so the
    last-to-first map is exact: within a run it moves by one.
    """

    def __init__(self, texts: list[bytes], docs: np.ndarray):
        self.sizes = np.array([len(t) for t in texts])
        width = int(self.sizes.max()) + 1
        grid = np.full((len(texts), width + 8), _END, np.uint8)
        for i, t in enumerate(texts):
            grid[i, : len(t)] = np.frombuffer(t, np.uint8)
        inside = np.arange(width + 8)[None, :] <= self.sizes[:, None]  # the end mark has a suffix too
        row, col = np.nonzero(inside)
        raw = grid.reshape(-1).astype(np.uint64)
        words = np.zeros(raw.size - 7, np.uint64)
        for k in range(8):
            words = (words << np.uint64(8)) | raw[k : raw.size - 7 + k]
        words = words[np.flatnonzero(inside)]
        o = np.argsort(words)
        new = np.append(True, words[o][1:] != words[o][:-1])
        rank = np.empty(len(words), np.int64)
        rank[o] = np.flatnonzero(new)[np.cumsum(new) - 1]
        # suffixes of a piece follow each other, so the one ``reach`` bytes on is that many places on
        room = self.sizes[row] - col
        reach, at_half = 8, None
        while reach < width:
            if reach == 32:
                at_half = rank.copy()
            shared = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)  # the others have their place
            if not len(shared):
                break
            inner = room[shared] >= reach
            second = np.zeros(len(shared), np.int64)
            second[inner] = rank[shared[inner] + reach] + 1
            rank[shared] = _refined(rank[shared], second)
            reach *= 2
        order = np.argsort(rank, kind="stable")
        n = len(order)
        # suffix intervals that share LENGTH bytes: equal first 32 and equal 32 that end at LENGTH
        at_half = rank if at_half is None else at_half
        long = room >= LENGTH
        tail = np.full(n, -1, np.int64)
        tail[long] = at_half[np.flatnonzero(long) + LENGTH - 32]
        a, b = at_half[order], tail[order]
        fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | ~long[order][1:])
        self.interval_start = np.flatnonzero(fresh)
        self.interval_low = np.minimum.reduceat(docs[row[order]], self.interval_start)
        last = np.where(col > 0, grid[row, col - 1], _END)[order]  # the transform
        self.run_start = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
        run_symbol = last[self.run_start].astype(np.int64)
        run_length = np.diff(np.append(self.run_start, n))
        by_symbol = np.argsort(run_symbol, kind="stable")
        lengths = run_length[by_symbol]
        # end marks sort last of all: their run heads map behind every other symbol, in order
        self.run_to = np.empty(len(run_symbol), np.int64)
        self.run_to[by_symbol] = np.cumsum(lengths) - lengths
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.end_place = place[np.flatnonzero(col == self.sizes[row])]
        run_end = np.append(self.run_start[1:], n) - 1
        self.sample = np.searchsorted(self.interval_start, run_end, side="right") - 1

    def stream(self) -> np.ndarray:
        """Smallest document of each string of each piece, by column; a large number where there is none."""
        most = int(self.sizes.max())
        out = np.full((len(self.sizes), max(most - LENGTH + 1, 1)), _ALL, np.int64)
        at, left = self.end_place.copy(), self.sizes.copy()
        active = np.arange(len(at))
        while len(active):
            run = np.searchsorted(self.run_start, at[active], side="right") - 1
            at[active] = self.run_to[run] + (at[active] - self.run_start[run])
            left[active] -= 1
            long = active[self.sizes[active] - left[active] >= LENGTH]
            interval = np.searchsorted(self.interval_start, at[long], side="right") - 1
            out[long, left[long]] = self.interval_low[interval]
            active = active[left[active] > 0]
        return out


def _bucket_rows(documents: DataFrame, buckets: int) -> DataFrame:
    """Hashes of pieces by bucket: per batch and bucket the documents, their piece counts, and the packed hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                batch = whole.slice(low, 2000)
                ids = np.array(batch.column(0).to_pylist(), np.int64)
                doc, _, _, gram, key = pieces([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()])
                if not len(doc):
                    continue
                bucket = ((gram >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                name = piece_id(gram, key)
                o = np.lexsort((name, ids[doc], bucket))
                bucket, owner, gram, name = bucket[o], ids[doc][o], gram[o], name[o]
                keep = np.append(True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1]) | (name[1:] != name[:-1]))
                bucket, owner, gram, name = bucket[keep], owner[keep], gram[keep], name[keep]
                edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                rows = {"bucket": [], "ids": [], "counts": [], "packed": []}
                packed = np.empty((len(gram), 11), np.uint8)
                packed[:, :5] = gram.view(np.uint8).reshape(-1, 8)[:, 3:8]
                packed[:, 5:] = name.view(np.uint8).reshape(-1, 8)[:, :6]
                for a, b in zip(edge, np.append(edge[1:], len(bucket))):
                    mine = owner[a:b]
                    new = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                    rows["bucket"].append(int(bucket[a]))
                    rows["ids"].append(mine[new].astype("<i8").tobytes())
                    rows["counts"].append(np.diff(np.append(new, b - a)).astype("<u4").tobytes())
                    rows["packed"].append(packed[a:b].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["bucket"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in ("ids", "counts", "packed"))],
                    names=list(rows))

    return documents.mapInArrow(run, "bucket int, ids binary, counts binary, packed binary")


def _with_parts(rows: DataFrame) -> DataFrame:
    """``rows`` with _parts, the number of parts of the row's bucket, and _part, the row's own."""
    amount = rows.groupBy("bucket").agg(F.sum(F.octet_length("packed")).alias("_bytes")).select(
        F.col("bucket").alias("_bucket"), F.ceil(F.col("_bytes") / (11 * PART_ENTRIES)).cast("int").alias("_parts")
    )
    return rows.join(amount, F.col("bucket") == F.col("_bucket")).drop("_bucket").withColumn(
        "_part", F.pmod(F.xxhash64("ids", "packed"), F.col("_parts")).cast("int")
    )


def _entries(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, key) of the entries of bucket rows, sorted by gram, key and document."""
    doc = np.concatenate([np.repeat(np.frombuffer(i, "<i8"), np.frombuffer(c, "<u4")) for i, c in zip(part["ids"], part["counts"])])
    packed = np.frombuffer(b"".join(part["packed"]), np.uint8).reshape(-1, 11)

    def number(a: int, b: int) -> np.ndarray:
        wide = np.zeros((len(packed), 8), np.uint8)
        wide[:, : b - a] = packed[:, a:b]
        return wide.reshape(-1).view(np.int64)

    gram, key = number(0, 5), number(5, 11)
    o = np.lexsort((doc, key, gram))
    return doc[o], gram[o], key[o]


def _name(gram: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (((gram & 0xFFFF) << 48) | key).astype(np.int64)


def _shared_pieces(part: pd.DataFrame) -> pd.DataFrame:
    """Pieces of grams that several documents have: document, piece, gram, first document, and if it stands alone."""
    doc, gram, key = _entries(part)
    new_gram = np.append(True, gram[1:] != gram[:-1])
    new_piece = new_gram | np.append(True, key[1:] != key[:-1])
    g, p = np.cumsum(new_gram) - 1, np.cumsum(new_piece) - 1
    starts = np.flatnonzero(new_gram)
    low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
    several = np.bincount(g[new_piece]) > 1
    first = doc[new_piece][p]
    use = (low != high)[g] & (several[g] | (doc > first))
    g_used = g[use]
    return pd.DataFrame({"doc": doc[use], "piece": _name(gram[use], key[use]), "gram": gram[use], "first": first[use], "alone": ~several[g_used]})


def _distinct_pieces(part: pd.DataFrame) -> pd.DataFrame:
    """Distinct pieces of a part of a bucket with their smallest and largest document."""
    doc, gram, key = _entries(part)
    at = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])))
    return pd.DataFrame({"bucket": part["bucket"].iloc[0], "_part": part["_part"].iloc[0], "gram": gram[at], "key": key[at],
                         "low": doc[at], "high": doc[np.append(at[1:], len(doc)) - 1]})


def _shared_of_part(part: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
    """What _shared_pieces gives, for one part of a bucket and the shared ones of its distinct pieces."""
    if not len(part) or not len(shared):
        return pd.DataFrame({"doc": [], "piece": [], "gram": [], "first": [], "alone": []})
    doc, gram, key = _entries(part)
    new = np.append(True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1]))
    p = np.cumsum(new) - 1
    g_own, k_own = gram[new], key[new]
    known = shared.sort_values(["gram", "key"])
    full = pd.MultiIndex.from_arrays([known["gram"], known["key"]])
    at = full.get_indexer(pd.MultiIndex.from_arrays([g_own, k_own]))[p]
    first, alone = known["first"].to_numpy(np.int64)[at], known["alone"].to_numpy(bool)[at]
    use = (at >= 0) & (~alone | (doc > first))
    return pd.DataFrame({"doc": doc[use], "piece": _name(gram[use], key[use]), "gram": gram[use], "first": first[use], "alone": alone[use]})


def _shared(rows: DataFrame) -> DataFrame:
    """Pieces of grams that several documents have, of all buckets."""
    schema = "doc long, piece long, gram long, first long, alone boolean"
    dealt = _with_parts(rows)
    whole = dealt.filter("_parts = 1").groupBy("bucket").applyInPandas(_shared_pieces, schema)
    split = dealt.filter("_parts > 1")
    own = staged(split.groupBy("bucket", "_part").applyInPandas(
        _distinct_pieces, "bucket int, _part int, gram long, key long, low long, high long"))
    of_piece = own.groupBy("gram", "key").agg(F.min("low").alias("first"), F.max("high").alias("_last"))
    of_gram = of_piece.groupBy(F.col("gram").alias("_gram")).agg(
        (F.count(F.lit(1)) == 1).alias("alone"), F.min("first").alias("_low"), F.max("_last").alias("_high")
    ).filter("_low <> _high")
    pieces_used = of_piece.join(of_gram, F.col("gram") == F.col("_gram")).select(
        F.col("gram").alias("_g"), F.col("key").alias("_k"), "first", "alone")
    back = own.join(pieces_used, (F.col("gram") == F.col("_g")) & (F.col("key") == F.col("_k"))).select(
        "bucket", "_part", "gram", "key", "first", "alone")
    parts = split.groupBy("bucket", "_part").cogroup(back.groupBy("bucket", "_part")).applyInPandas(_shared_of_part, schema)
    return whole.union(parts)


def _pieces_of(rows: dict) -> dict:
    """Bytes of the wanted pieces of each document."""
    out: dict[str, list] = {"piece": [], "gram": [], "low": [], "bytes": []}
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows["text"]]
    doc, start, count, gram, key = pieces(texts)
    names = piece_id(gram, key)
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d, wanted in enumerate(rows["wanted"]):
        mine = {int(x): k for k, x in zip(range(edge[d], edge[d + 1]), names[edge[d] : edge[d + 1]])}
        for w in wanted:
            k = mine.get(w["piece"])
            if k is None:  # in another row of this id, which sends it
                continue
            out["piece"].append(w["piece"])
            out["gram"].append(w["gram"])
            out["low"].append(rows["_id"][d])
            out["bytes"].append(texts[d][start[k] : start[k] + count[k] + LENGTH - 1])
    return out


def _index(part: pd.DataFrame) -> pd.DataFrame:
    """Smallest documents of the strings of each piece of an index."""
    low = RunLengthIndex(list(part["bytes"]), part["low"].to_numpy(np.int64)).stream()
    n = part["bytes"].map(len).to_numpy() - LENGTH + 1
    return pd.DataFrame({"piece": part["piece"], "lows": [row[:k].tolist() for row, k in zip(low, n)]})


def _remove(rows: dict) -> dict:
    """Texts without their marked bytes."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows["text"]]
    marked = [d for d, m in enumerate(rows["marks"]) if m]
    doc, start, count, gram, key = pieces([texts[d] for d in marked])
    names = piece_id(gram, key)
    edge = np.searchsorted(doc, np.arange(len(marked) + 1))
    removed, spans, kept = [0] * len(texts), [0] * len(texts), texts[:]
    for at, d in enumerate(marked):
        wanted = np.array([m["piece"] for m in rows["marks"][d]], np.int64)
        bits = np.array([m["bits"] for m in rows["marks"][d]], np.int64)
        o = np.argsort(wanted)
        wanted, bits = wanted[o], bits[o]
        mine = names[edge[at] : edge[at + 1]]
        k = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
        hit = np.flatnonzero(wanted[k] == mine)
        base = start[edge[at] : edge[at + 1]][hit]
        amount = count[edge[at] : edge[at + 1]][hit]
        offset = np.arange(SPAN)
        on = ((bits[k[hit]][:, None] >> offset[None, :]) & 1).astype(bool) & (offset[None, :] < amount[:, None])
        begin = (base[:, None] + offset[None, :])[on]
        if not len(begin):
            continue
        change = np.zeros(len(texts[d]) + 1, np.int64)
        np.add.at(change, begin, 1)
        np.subtract.at(change, begin + LENGTH, 1)
        gone = np.cumsum(change)[:-1] > 0
        removed[d] = int(gone.sum())
        spans[d] = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept[d] = np.frombuffer(texts[d], np.uint8)[~gone].tobytes()
    return {"doc_id": rows["_id"], "n_bytes": [len(t) for t in texts], "n_removed": removed, "n_spans": spans,
            "kept_sha256": [hashlib.sha256(t).hexdigest() for t in kept], "kept": kept}


def dedup(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    Matches never cross documents; strings are judged on the input. A null text is empty. Rows that share
    an id are one document to each other: they lose nothing to one another. Rows without an id come before
    all others. Texts shorter than LENGTH lose nothing. An empty table gives no rows.
    """
    none = -(1 << 63)
    source = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("_id"), "text")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # hashes neither repeat nor compress: small row groups, so that writers hold few of them
    small = {"parquet.block.size": 8 << 20, "parquet.enable.dictionary": False}
    rows = staged(_bucket_rows(source, max(1, -(-total // BUCKET_BYTES))), **small)
    shared = staged(_shared(rows))
    several = shared.filter(~F.col("alone"))
    wanted = several.filter("doc = first").groupBy("doc").agg(
        F.collect_set(F.struct("piece", "gram")).alias("wanted")
    )
    # one row per distinct piece: its first document sends the bytes
    sends = source.join(wanted.hint("merge"), F.col("_id") == F.col("doc")).select("_id", "text", "wanted")
    distinct = by_batch(sends, lambda: _pieces_of, "piece long, gram long, low long, bytes binary")
    number = max(1, (several.filter("doc = first").count()) // INDEX_PIECES)
    lows = (
        distinct.withColumn("_task", F.pmod(F.xxhash64("gram"), F.lit(number)))
        .groupBy("_task").applyInPandas(_index, "piece long, lows array<long>")
        .withColumnRenamed("piece", "_piece").dropDuplicates(["_piece"])
    )
    one = F.aggregate(
        F.transform("lows", lambda x, i: F.when(x < F.col("doc"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))
    marks = (
        several.join(lows, F.col("piece") == F.col("_piece")).select("doc", "piece", one.alias("bits")).filter("bits <> 0")
        .union(shared.filter("alone").select("doc", "piece", F.lit(_ALL).alias("bits")))
        .groupBy(F.col("doc").alias("_of")).agg(F.collect_list(F.struct("piece", "bits")).alias("marks"))
    )
    joined = source.join(marks.hint("merge"), F.col("_id") == F.col("_of"), "left").select("_id", "text", "marks")
    out = by_batch(joined, lambda: _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))
