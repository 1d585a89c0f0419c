"""Divergence of the sources of a language, priced over hash-consed segment trees of term counts.

The kept terms of a language get ids: a block by hash, and in it a place by falling total, so that rare
terms lie side by side. A group's counts in a block are the leaves of a segment tree. The trees of all
groups of a block are built together, level by level, and equal pairs of children get one node: equal
count subtrees are shared, whichever group or place they come from. Two trees are priced by walking
both at once; on each level a pair of nodes occurs once, however many places it stands for, and
its price is multiplied up on the way back. Prices of blocks are added by Spark.

Work is dealt by (language, block of terms, two blocks of sources), so a task holds a bounded number of
trees over a bounded number of terms, whatever one source or language holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import staged

#: Documents of its language that a kept term is in, at least.
MIN_DOCS = 10
#: Added to every count.
PRIOR = 2
#: Shares are whole multiples of one part in this.
SCALE = 1_000_000_000
#: Terms that a group is told apart by.
TOP_TERMS = 10

#: Kept terms of a language that are in one tree, on average.
BLOCK_TERMS = 16_384
#: Sources of a language that are in one block, on average.
BLOCK_SOURCES = 40
#: Entries of the counters of a task before they are handed on.
COUNTED_TERMS = 300_000
#: Bytes of a text that are cut into terms at a time.
CHUNK_BYTES = 4_000_000

# A-Z lower-cased, other letters and all bytes of characters beyond ASCII kept, the rest separates.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, a part at a time."""
    at = 0
    while at < len(text):
        end = at + CHUNK_BYTES
        while end < len(text) and _LETTERS[text[end]] != 32:  # a part ends at a separator
            end += 1
        yield text[at:end].translate(_LETTERS).split()
        at = end


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents), added up per group and term."""
    plain = documents.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                there = docs[lang, source]
                names = list(terms)
                for low in range(0, len(names), 50_000):
                    some = names[low : low + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                            pa.array(some, pa.binary()).cast(pa.string()),
                            pa.array([terms[t] for t in some], pa.int64()), pa.array([there[t] for t in some], pa.int64()),
                        ],
                        ["lang", "source", "term", "n", "docs"],
                    )
            n.clear()
            docs.clear()

        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                group = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                mine, there = n.setdefault(group, Counter()), docs.setdefault(group, Counter())
                before, seen = len(mine), set()
                for terms in terms_of(batch.column(2)[i].as_py()):
                    mine.update(terms)
                    seen.update(terms)
                there.update(seen)
                held += len(mine) - before
                if held >= COUNTED_TERMS:
                    yield from hand_on()
                    held = 0
        yield from hand_on()

    parts = plain.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---- trees and prices -------------------------------------------------------


class Trees:
    """Segment trees over the rows of a matrix of counts, with shared nodes.

    ``roots`` has a node per row; level k holds the children (left, right) of the nodes of height
    k + 1; nodes of height 0 are the distinct counts in ``leaves``, -1 standing for no term.
    """

    def __init__(self, counts: np.ndarray):
        rows, width = counts.shape
        size = 1 << max(0, (width - 1).bit_length())
        full = np.full((rows, size), -1, np.int64)
        full[:, :width] = counts
        self.leaves, nodes = np.unique(full, return_inverse=True)
        nodes = nodes.reshape(rows, size)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.empty = [self.leaves <= 0]  # nodes without any occurrence
        while nodes.shape[1] > 1:
            base = int(nodes.max()) + 1
            pairs = nodes[:, ::2] * base + nodes[:, 1::2]
            both, inner = np.unique(pairs, return_inverse=True)
            self.levels.append((both // base, both % base))
            self.empty.append(self.empty[-1][both // base] & self.empty[-1][both % base])
            nodes = inner.reshape(pairs.shape)
        self.roots = nodes[:, 0]

    def shares(self, total: int, kept: int) -> np.ndarray:
        """p of every leaf for a group with ``total`` occurrences of ``kept`` terms."""
        below = total + PRIOR * kept
        if not below:
            return np.zeros(len(self.leaves), np.int64)
        # counts times SCALE can pass 64 bits, the result cannot
        return np.array([1 + SCALE * (int(c) + PRIOR) // below if c >= 0 else 0 for c in self.leaves], np.int64)

    def price(self, a: int, b: int, p: np.ndarray, q: np.ndarray) -> int:
        """Sum of f over all terms for two roots; every pair of nodes is priced once."""
        left_of, right_of = np.array([a]), np.array([b])
        ways = []
        for left, right in reversed(self.levels):
            x = np.concatenate([left[left_of], right[left_of]])
            y = np.concatenate([left[right_of], right[right_of]])
            base = int(y.max()) + 1
            pairs, inner = np.unique(x * base + y, return_inverse=True)
            left_of, right_of = pairs // base, pairs % base
            ways.append(inner)
        prices = difference(p[left_of], q[right_of])
        for inner in reversed(ways):
            both = prices[inner]
            prices = both[: len(both) // 2] + both[len(both) // 2 :]
        return int(prices[0])

    def places(self, a: int) -> np.ndarray:
        """Places with occurrences below a root; subtrees without any are left out whole."""
        nodes, places = np.array([a]), np.zeros(1, np.int64)
        for height in range(len(self.levels), 0, -1):
            some = ~self.empty[height][nodes]
            nodes, places = nodes[some], places[some]
            left, right = self.levels[height - 1]
            nodes = np.concatenate([left[nodes], right[nodes]])
            places = np.concatenate([places * 2, places * 2 + 1])
        return places[~self.empty[0][nodes]]


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits 64 bits."""
    both = p + q
    return np.where(both > 0, (p - q) ** 2 // np.maximum(both, 1), 0)


_PRICED = "lang string, part string, a string, b string, value long"


def _price_unit(rows: pd.DataFrame) -> pd.DataFrame:
    """Prices of one block of terms for all pairs of two blocks of sources.

    Rows with ``kind`` 0 are groups (source, side, places, counts); the row with kind 1, there where
    both blocks of sources are the same, holds the terms and the totals of the language.
    """
    lang = rows["lang"].iloc[0]
    groups = rows[rows["kind"] == 0].sort_values("source", key=lambda s: s.map(str.encode))
    whole = rows[rows["kind"] == 1]
    kept, width = int(rows["kept"].iloc[0]), int(rows["width"].iloc[0])
    counts = np.zeros((len(groups) + len(whole), max(width, 1)), np.int64)
    if not width:
        counts[:] = -1
    for i, (places, n) in enumerate(zip(groups["places"], groups["counts"])):
        if places is not None and len(places):
            counts[i, np.asarray(places, np.int64)] = np.asarray(n, np.int64)
    if len(whole) and width:
        counts[-1, :] = np.asarray(whole["counts"].iloc[0], np.int64)
    trees = Trees(counts)
    names, sides = groups["source"].tolist(), groups["side"].tolist()
    shares = [trees.shares(int(t), kept) for t in groups["total"]]
    out: list[tuple] = []
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            if len(whole) or sides[i] != sides[j]:
                value = trees.price(trees.roots[i], trees.roots[j], shares[i], shares[j])
                out.append((lang, "pair", names[i], names[j], value))
    if len(whole) and width:
        terms = whole["terms"].iloc[0]
        of_lang = trees.shares(int(whole["total"].iloc[0]), kept)[np.searchsorted(trees.leaves, counts[-1])]
        for i in range(len(names)):
            at = trees.places(trees.roots[i])
            p, q = shares[i][np.searchsorted(trees.leaves, counts[i, at])], of_lang[at]
            at, value = at[p > q], difference(p, q)[p > q]
            if len(at) > TOP_TERMS:
                least = np.partition(value, len(value) - TOP_TERMS)[len(value) - TOP_TERMS]
                at, value = at[value >= least], value[value >= least]
            best = sorted(zip((-value).tolist(), [terms[k].encode() for k in at]))[:TOP_TERMS]
            out += [(lang, "term", names[i], t.decode(), -v) for v, t in best]
    return pd.DataFrame(out, columns=["lang", "part", "a", "b", "value"])


# ---- the audit --------------------------------------------------------------


#: Parts that the rows of one language are dealt to where they meet what is known of the language.
SALTS = 64


def _with_language(rows: DataFrame, by: str, known: DataFrame, how: str = "inner") -> DataFrame:
    """Join by language; rows are dealt by language and hash of ``by``, so a hot language is spread."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    copies = known.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["lang", "_salt"], how).drop("_salt")


def _blocks(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("long")


def audit(documents: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how far every (lang, source) group is from others.

    Part ``pair`` has a row for each other source of the language, part ``term`` the ten terms that
    mark the group against its language. Null text, lang and source count as ''. A language without
    kept terms has pairs of value 0 and no terms; a group that is alone in its language has no pairs;
    repeated rows count as often as they stand there, ids are not looked at. An empty table gives no
    rows. Texts of any length are read in parts. Further columns of any name are not looked at.
    """
    found = staged(term_counts(documents))
    groups = documents.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    ).distinct()
    kept = (
        found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        .filter(F.col("docs") >= MIN_DOCS).select("lang", "term", "n")
    )
    kept = staged(kept)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
    # (lang, block): terms by falling total; a term's place is its index there
    dealt = _with_language(kept, "term", sizes.select("lang", "kept")).withColumn(
        "block", F.pmod(F.xxhash64("term"), _blocks(F.col("kept"), BLOCK_TERMS))
    )
    listed = staged(
        dealt.groupBy("lang", "block")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "term"))).alias("list"))
        .withColumn("width", F.size("list"))
    )
    places = listed.select("lang", "block", F.posexplode("list").alias("place", "it")).select(
        "lang", "block", "place", F.col("it.term").alias("term")
    )
    vectors = staged(
        found.select("lang", "source", "term", "n").join(places, ["lang", "term"])
        .groupBy("lang", "source", "block")
        .agg(F.collect_list(F.struct("place", "n")).alias("list"), F.sum("n").alias("n"))
    )
    totals = vectors.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = (
        _with_language(groups, "source", sources.join(sizes.select("lang", "kept"), "lang", "left"))
        .join(totals, ["lang", "source"], "left")
        .select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"),
            _blocks(F.col("sources"), BLOCK_SOURCES).alias("of"),
            F.pmod(F.xxhash64("source"), _blocks(F.col("sources"), BLOCK_SOURCES)).alias("side"),
        )
    )
    # every group stands in every block of terms, with or without occurrences, and meets all blocks of sources
    widths = groups.select("lang").distinct().join(listed.select("lang", "block", "width"), "lang", "left")
    widths = widths.select("lang", F.coalesce("block", F.lit(-1)).alias("block"), F.coalesce("width", F.lit(0)).alias("width"))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("other")
    rows = (
        _with_language(groups, "source", widths).join(vectors.drop("n"), ["lang", "source", "block"], "left")
        .select("*", partner)
        .select(
            "lang", "block", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"),
            F.lit(0).alias("kind"), "source", "side", "total", "kept", "width",
            F.col("list.place").alias("places"), F.col("list.n").alias("counts"), F.lit(None).cast("array<string>").alias("terms"),
        )
    )
    sides = groups.select("lang", "side").distinct()
    whole = listed.join(sizes, "lang").join(sides, "lang").select(
        "lang", "block", F.col("side").alias("low"), F.col("side").alias("high"), F.lit(1).alias("kind"),
        F.lit(None).cast("string").alias("source"), "side", "total", "kept", "width",
        F.lit(None).cast("array<int>").alias("places"),
        F.transform("list", lambda x: -x["less"]).alias("counts"), F.col("list.term").alias("terms"),
    )
    empty = widths.filter("width = 0").join(sides, "lang").select(  # no terms: only says that the pairs are within
        "lang", "block", F.col("side").alias("low"), F.col("side").alias("high"), F.lit(1).alias("kind"),
        F.lit(None).cast("string").alias("source"), "side", F.lit(0).cast("long").alias("total"),
        F.lit(0).cast("long").alias("kept"), "width", F.lit(None).cast("array<int>").alias("places"),
        F.lit(None).cast("array<bigint>").alias("counts"), F.lit(None).cast("array<string>").alias("terms"),
    )
    priced = staged(
        rows.unionByName(whole).unionByName(empty)
        .groupBy("lang", "block", "low", "high").applyInPandas(_price_unit, _PRICED)
    )
    pairs = priced.filter("part = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))
    )).alias("it")
    pairs = pairs.select("lang", both, "value").select("lang", "it.source", F.lit("pair").alias("part"), "it.item", "value")
    terms = priced.filter("part = 'term'").select(
        "lang", F.col("a").alias("source"), "part", F.col("b").alias("item"), "value"
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
