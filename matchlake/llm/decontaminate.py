"""Benchmark decontamination: a broadcast set of normalised test n-grams against token windows.

DataFrame functions only. Texts become word arrays, words become windows of ``size`` words,
and the windows meet the distinct windows of the benchmark in one hash join. The join key is
the window's text itself, so a match is verified by the join and no hash can collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import free_name

WINDOW = 10
#: The benchmark's windows are broadcast only up to this size; beyond it the join is left to Spark.
BROADCAST_BYTES = 64 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, split at every ASCII character but letters and digits."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.coalesce(F.array_remove(F.split(low, _BETWEEN), ""), F.array().cast("array<string>"))


def _windows(of: Column, n: Column, size: int) -> Column:
    """Texts of all windows of ``size`` words, in order; none if there are fewer words."""
    starts = F.sequence(F.lit(1), n - (size - 1))
    every = F.transform(starts, lambda i: F.array_join(F.slice(of, i, size), " "))
    return F.when(n >= size, every).otherwise(F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, words, items): distinct windows with the sorted ids of the items that hold them.

    An item of fewer than ``size`` words, but not none, is one window. Items without an id or
    without words are ignored.
    """
    w, n = F.col("_w"), F.size("_w")
    whole = F.array(F.array_join(w, " "))
    return (
        benchmark.filter("item_id IS NOT NULL")
        .select(F.col("item_id").cast("string").alias("_item"), words(F.col("text")).alias("_w"))
        .filter(n > 0)
        .select("_item", F.least(n, F.lit(size)).alias("_k"),
                F.explode(F.when(n < size, whole).otherwise(_windows(w, n, size))).alias("_window"))
        .groupBy("_window")
        .agg(F.first("_k").alias("_k"), F.array_sort(F.collect_set("_item")).alias("_items"))
    )


def find_hits(
    documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, spans, digest (of the text).

    ``spans`` lists (start, words) of every window that occurs, ``n_hit`` the words inside any.
    Null or empty texts have no words. Repeated rows are returned as often as they occur; rows
    with one id and different texts are judged apart. Without benchmark rows nothing is hit.

    One scan: each document sends a marker row with its word count next to its windows, the
    windows that are no test window die in the map-side join, and what is left is grouped.
    """
    grams = benchmark_windows(benchmark, size)
    known = grams.agg(
        F.coalesce(F.sum(F.octet_length("_window") + 8 * F.size("_items") + 64), F.lit(0)).alias("b"),
        F.sort_array(F.collect_set("_k")).alias("k"),
    ).first()
    lengths = known["k"]  # at most `size` numbers

    w, n = F.col("_w"), F.col("_n")
    parsed = documents.select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_digest"), words(F.col("text")).alias("_w")
    ).withColumn("_n", F.size("_w"))
    parts = [F.array(F.lit(""))] + [_windows(w, n, k) for k in lengths]
    seen = parsed.select("_id", "_digest", "_n", F.posexplode(F.concat(*parts)).alias("_at", "_text"))
    if known["b"] <= broadcast_bytes:
        grams = F.broadcast(grams)
    joined = seen.join(grams, F.col("_text") == F.col("_window"), "left").filter(
        (F.col("_at") == 0) | F.col("_window").isNotNull()
    )
    # windows of one length follow those of the shorter lengths: take their number off
    before: Column = F.lit(1)
    start: Column = F.lit(None).cast("int")
    for k in lengths:
        start = F.when(F.col("_k") == k, F.col("_at") - before).otherwise(start)
        before = before + F.greatest(n - (k - 1), F.lit(0))
    hit = F.col("_window").isNotNull()
    grouped = joined.groupBy("_id", "_digest", "_n").agg(
        F.count_if(F.col("_at") == 0).cast("int").alias("_copies"),
        F.array_sort(F.collect_set(F.when(hit, F.struct(start.alias("start"), F.col("_k").alias("words"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
    )

    def cover(acc: Column, s: Column) -> Column:
        end = s["start"] + s["words"]
        new = F.greatest(end - F.greatest(acc["end"], s["start"]), F.lit(0))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["end"], end).alias("end"))

    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), cover, lambda acc: acc["n"])
    return (
        grouped.withColumn("n_hit", n_hit.cast("long"))
        .withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(F.col("_id").alias("doc_id"), F.col("_n").cast("long").alias("n_words"), "n_hit",
                F.size("items").cast("long").alias("n_items"), "items", "spans", F.col("_digest").alias("digest"))
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Documents without any word inside a test window; columns as they were.

    The removed rows are those with a window of their own text in the benchmark, so rows that
    share an id are judged by their text. Further columns may have any name.
    """
    bad_id, bad_text = free_name(documents, "_bad_id"), free_name(documents, "_bad")
    bad = find_hits(documents, benchmark, size).filter("n_hit > 0").select(
        F.col("doc_id").alias(bad_id), F.col("digest").alias(bad_text)
    )
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_text))
    return documents.join(bad.hint("merge"), same, "left_anti")
