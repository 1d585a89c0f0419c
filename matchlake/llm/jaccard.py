"""N-gram Jaccard join with a MinHash LSH forest.

Texts are sets of hashed five-word shingles. Equal sets form a class first, so copies cost one row.
Class representatives stand in a forest of prefix tries over their MinHash signatures: a trie node of
depth d is the set of representatives that share the first d values of a tree. The join verifies all
pairs that meet at the largest depth that finds a pair of the lowest similarity with the target recall,
so whether a pair is found does not depend on other documents.

Pairs are never rows. Representatives that meet in a node are joined to a hub of the node, connected
hubs form blocks, and a task verifies the pairs of two blocks with exact set sizes; it returns one row
per representative with its links counted and one representative that it is connected to.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import by_batch, free_name, staged

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH = 16, 5
#: Prefix lengths that are tried, from selective to complete.
DEPTHS = (5, 4, 3)
TARGET_RECALL = 0.999
#: Shingles that a block of representatives holds on average at most; larger groups are split.
BLOCK_SHINGLES = 300_000
CACHE_WORDS = 400_000

_WORD = re.compile(r"\w+")
_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of texts."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        raw = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        h = self.known[word] = int.from_bytes(raw, "little") | 1
        return h

    def shingles(self, text: str | None) -> np.ndarray:
        """A text of fewer words, but not none, is one shingle; without words there is none."""
        words = _WORD.findall(text.lower()) if text else []
        if not words:
            return np.empty(0, np.uint64)
        get, new = self.known.get, self._word
        h = np.array([get(w) or new(w) for w in words], np.uint64)
        size = min(self.words, len(h))
        with np.errstate(over="ignore"):
            x = h[: len(h) - size + 1].copy()
            for k in range(1, size):
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size)
            x ^= x >> np.uint64(32)
        x.sort()
        return x[np.append(True, x[1:] != x[:-1])]


def signature(shingles: np.ndarray) -> bytes:
    """TREES x DEPTH MinHash values of four bytes."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), 2048):
            part = shingles[start : start + 2048]
            low = np.minimum(low, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def found_probability(similarity: np.ndarray | float, depth: int) -> np.ndarray:
    """Chance that two sets of this similarity share a prefix of this length in some tree."""
    return 1.0 - (1.0 - np.asarray(similarity, float) ** depth) ** TREES


def depth_for(target_recall: float) -> int:
    """Largest prefix length that finds even a pair of the lowest similarity with this chance."""
    return next((d for d in DEPTHS if found_probability(SIMILARITY, d) >= target_recall), DEPTHS[-1])


def with_signatures(documents: DataFrame) -> DataFrame:
    """(_id, _text, _set, _n, _sig): id, hash of the text, hash of the shingle set, its size, signature."""

    def make():
        s = Shingler()

        def run(rows: dict) -> dict:
            sets = [s.shingles(t) for t in rows["text"]]
            return {
                "_id": rows["_id"], "_text": rows["_text"], "_n": [len(x) for x in sets],
                "_set": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets],
                "_sig": [signature(x) if len(x) else None for x in sets],
            }

        return run

    source = documents.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"), "text")
    return by_batch(source, make, "_id long, _text long, _set binary, _n long, _sig binary")


def meetings(representatives: DataFrame, depth: int) -> DataFrame:
    """(_rep, _hub): keys of representatives and the smallest of each trie node they share with others."""
    keys = [F.xxhash64(F.lit(t), F.substring("_sig", 1 + 4 * DEPTH * t, 4 * depth)) for t in range(TREES)]
    placed = representatives.filter("_n > 0").select("_rep", F.explode(F.array(*keys)).alias("_node"))
    nodes = placed.groupBy("_node").agg(F.min("_rep").alias("_hub"), F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    return placed.join(nodes.drop("_k"), "_node").filter("_rep <> _hub").select("_rep", "_hub").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of (a, b) edges with the smallest node it is connected to.

    Large-star and small-star rounds: each round hooks neighbours to the smallest one known, as
    grouped minima and joins on even keys; the edges of a round are a written table.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = staged(small.union(down.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray):
    """Yield (rows of left, columns of right, common shingles) in tiles of bounded size."""
    lengths = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1  # a shingle of one set alone is in no overlap
    owner, number = owner[shared], (np.cumsum(new[shared] | np.append(True, number[shared][1:] != number[shared][:-1])) - 1)
    count = int(number[-1]) + 1 if len(number) else 0
    tile, wide = 512, 4096
    for a in range(0, len(left), tile):
        for b in range(0, len(right), tile):
            rows, cols = left[a : a + tile], right[b : b + tile]
            out = np.zeros((len(rows), len(cols)), np.float32)
            place_r = np.full(len(sets), -1)
            place_c = np.full(len(sets), -1)
            place_r[rows], place_c[cols] = np.arange(len(rows)), np.arange(len(cols))
            r, c = place_r[owner], place_c[owner]
            in_r, in_c = np.flatnonzero(r >= 0), np.flatnonzero(c >= 0)
            both = np.zeros(count, bool)  # shingles on both sides only
            both[number[in_r]] = True
            seen = np.zeros(count, bool)
            seen[number[in_c]] = True
            both &= seen
            in_r, in_c = in_r[both[number[in_r]]], in_c[both[number[in_c]]]
            rank = np.cumsum(both) - 1
            nr, nc = rank[number[in_r]], rank[number[in_c]]
            for low in range(0, int(both.sum()), wide):
                x = np.zeros((len(rows), wide), np.float32)
                y = np.zeros((len(cols), wide), np.float32)
                kr, kc = (nr >= low) & (nr < low + wide), (nc >= low) & (nc < low + wide)
                x[r[in_r[kr]], nr[kr] - low] = 1
                y[c[in_c[kc]], nc[kc] - low] = 1
                out += x @ y.T
            yield rows, cols, out


def verify(ids: np.ndarray, sets: list[np.ndarray], block: np.ndarray, depth: int, similarity: float = SIMILARITY):
    """(links, expected links, smallest connected key) per set; with two blocks only pairs across count."""
    n = len(ids)
    size = np.array([len(x) for x in sets], float)
    links, expected, root = np.zeros(n, np.int64), np.zeros(n), np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = int(block.min())
    left = np.flatnonzero(block == first)
    right = np.flatnonzero(block != first)
    within = not len(right)
    for rows, cols, common in _overlaps(sets, left, left if within else right):
        j = common / (size[rows][:, None] + size[cols][None, :] - common)
        hit = j >= similarity - 1e-9
        if within:
            hit &= rows[:, None] < cols[None, :]
        at_r, at_c = np.nonzero(hit)
        weight = 1.0 / found_probability(np.minimum(j[at_r, at_c], 1.0), depth)
        for at in (rows[at_r], cols[at_c]):
            links += np.bincount(at, minlength=n)
            expected += np.bincount(at, weights=weight, minlength=n)
        for a, b in zip(rows[at_r].tolist(), cols[at_c].tolist()):
            a, b = top(a), top(b)
            if a != b:
                if ids[a] > ids[b]:
                    a, b = b, a
                root[b] = a
    return links, expected, ids[[top(i) for i in range(n)]]


def verified(documents: DataFrame, representatives: DataFrame, met: DataFrame, depth: int) -> DataFrame:
    """(rep, links, root) of every representative in every task that verified it."""
    groups = components(met.select(F.col("_rep").alias("a"), F.col("_hub").alias("b")))
    members = staged(groups.join(representatives.select("_rep", "_id", "_text", "_n"), F.col("node") == F.col("_rep")).select("root", "_rep", "_id", "_text", "_n"))
    sizes = members.groupBy("root").agg(F.sum("_n").alias("_all"))
    total = members.agg(F.sum("_n")).first()[0] or 0
    buckets = max(1, total // BLOCK_SHINGLES)
    n = F.ceil(F.col("_all") / BLOCK_SHINGLES).cast("int")
    block = F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int")
    other = F.col("_other")
    tasks = (
        members.join(sizes, "root").withColumn("_blocks", n).withColumn("_block", block)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            "_rep", F.col("_id").alias("_of"), "_text", "root", "_block", (F.col("_block") == other).alias("_within"),
            F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(buckets)))
            .otherwise(F.xxhash64("root", F.least("_block", other), F.greatest("_block", other))).alias("_task"),
        )
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_own"), "text")
    rows = tasks.hint("merge").join(texts, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_own"))).select(
        "_task", "_rep", "root", "_block", "_within", "text"
    )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        s = Shingler()
        out = []
        for _, g in part.drop_duplicates(["root", "_rep"]).groupby("root", sort=False):
            # a task of two blocks of which one is empty has nothing to count: pairs inside a block have their own task
            if len(g) > 1 and (g["_within"].iloc[0] or g["_block"].nunique() > 1):
                ids = g["_rep"].to_numpy(np.int64)
                links, _, root = verify(ids, [s.shingles(t) for t in g["text"]], g["_block"].to_numpy(), depth)
                out.append(pd.DataFrame({"rep": ids, "links": links, "root": root}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "links": [], "root": []})

    return rows.groupBy("_task").applyInPandas(run, "rep long, links long, root long")


def grouped(documents: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """``join`` with one more column, _group: the key of a group, also of one without any id."""
    rows = staged(with_signatures(documents))
    classes = staged(
        rows.groupBy("_set").agg(
            F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_text")).alias("_first"),
            F.count(F.lit(1)).alias("n_copies"), F.max("_n").alias("_n"), F.max("_sig").alias("_sig"))
        .select("_set", F.xxhash64("_set").alias("_rep"), F.col("_first._id").alias("_id"),
                F.col("_first._text").alias("_text"), "n_copies", "_n", "_sig")
    )
    depth = depth_for(target_recall)
    checked = staged(verified(documents, classes, staged(meetings(classes, depth)), depth))
    links = checked.groupBy(F.col("rep").alias("_rep")).agg(F.sum("links").alias("n_links"))
    groups = components(checked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    placed = classes.select("_set", "_rep", F.col("_id").alias("class_id"), "n_copies").join(
        groups.select(F.col("node").alias("_rep"), F.col("root").alias("_root")), "_rep", "left"
    ).withColumn("_root", F.coalesce("_root", "_rep"))
    smallest = placed.groupBy("_root").agg(F.min("class_id").alias("group_id"))
    known = placed.join(links, "_rep", "left").join(smallest, "_root").select(
        "_set", "class_id", "n_copies", "n_links", "group_id", "_root"
    )
    return rows.select("_id", "_text", "_set").join(known, "_set").select(
        F.col("_id").alias("doc_id"), "class_id", "n_copies",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "group_id", F.col("_text").alias("digest"),
        F.col("_root").alias("_group"),
    )


def join(documents: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_copies, n_links, group_id, digest.

    ``class_id`` is the smallest id among documents with the same set of shingles, ``n_copies`` their
    number, ``n_links`` the number of other classes at similarity 0.8 or more, ``group_id`` the smallest
    id among all documents connected by links or copies. Words are runs of word characters in lower
    case. Texts without words (null ones too) are copies of each other and link to nothing. Repeated
    rows are copies. Rows without an id join a class but are never its id. Ties need no rule: ids are
    minima. An empty table gives no rows.
    """
    return grouped(documents, target_recall).drop("_group")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id, with its columns.

    Groups are told apart by their texts, so documents without an id or with one id stay if they are unrelated.
    Further columns may have any name.
    """
    kept_id, kept_text = free_name(documents, "_kept_id"), free_name(documents, "_kept_text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("_kept")
    kept = grouped(documents).groupBy("_group").agg(first).select(
        F.col("_kept.doc_id").alias(kept_id), F.col("_kept.digest").alias(kept_text)
    )
    same = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.xxhash64("text") == F.col(kept_text))
    columns = [documents[c] for c in documents.columns]
    return (
        documents.join(kept.hint("merge"), same, "left_semi").select(*columns, F.xxhash64("text").alias(kept_text))
        .dropDuplicates(["doc_id", kept_text]).drop(kept_text)
    )
