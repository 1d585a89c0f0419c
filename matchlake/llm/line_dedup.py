"""Line deduplication with a log-template tree.

DataFrame functions only. A line goes down a tree of fixed depth: its number of tokens, then its
leading tokens. Tokens with a digit are variable fields and read ``<*>`` from the start. In a leaf
a line is generalised further: besides its own template it has four in which one quarter of the
tokens after the leading ones is a single ``<*>``, so lines that differ inside one quarter meet in
a common template. A template needs a constant token: rows of nothing but numbers are content. How many
documents make it recurring depends on how much it says: ``specific_docs`` from ``specific_tokens``
constant tokens on, ``min_docs`` below. The lines of a recurring template are dropped everywhere but
in the document with the smallest id.

Only 64-bit keys of templates are written and shuffled, never lines; a hot template is pre-aggregated per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import staged

#: Documents that make a template recurring, and constant tokens from which fewer do.
MIN_DOCS, SPECIFIC_DOCS = 5, 2
SPECIFIC_TOKENS = 20
LEADING = 2
#: Shorter lines are not generalised beyond their variable fields.
MIN_TOKENS = 8
QUARTERS = 4

OPEN = "<*>"
_SPACE, _TOKEN = r"[\x09-\x0D ]+", r"[^\x09-\x0D ]"


def tokens(line: Column) -> Column:
    """Tokens between ASCII white space; those with a digit become ``<*>``."""
    plain = F.array_remove(F.split(line, _SPACE), "")
    masked = F.transform(plain, lambda t: F.when(t.rlike("[0-9]"), F.lit(OPEN)).otherwise(t))
    return F.when(line.rlike("[0-9]"), masked).otherwise(plain)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def _edges(t: Column, leading: int) -> list[Column]:
    """Borders of the leading tokens and of the quarters of the rest."""
    rest = F.size(t) - leading
    return [F.lit(0), *[F.lit(leading) + F.floor(rest * q / QUARTERS).cast("int") for q in range(QUARTERS + 1)]]


def _parts(t: Column, leading: int, of) -> Column:
    """A value of the leading tokens and of each quarter of the rest, from tokens, start and length."""
    edges = _edges(t, leading)
    parts = [of(t, a, b - a) for a, b in zip(edges, edges[1:])]
    return F.when(F.size(t) >= leading, F.array(*parts)).otherwise(F.array(of(t, F.lit(0), F.size(t))))


def part_hashes(t: Column, leading: int) -> Column:
    """Hashes of the leading tokens and of the quarters of the rest; each token is hashed once."""
    return _parts(t, leading, lambda t, a, n: F.xxhash64(F.slice(t, a + 1, n)))


def part_constants(t: Column, leading: int) -> Column:
    """Numbers of constant tokens in the same parts."""
    counted = _parts(t, leading, lambda t, a, n: F.size(F.array_remove(F.slice(t, a + 1, n), OPEN)))
    return F.when(F.array_contains(t, OPEN), counted).otherwise(_parts(t, leading, lambda t, a, n: n))


def template_keys(n: Column, parts: Column, constants: Column, min_tokens: int, specific: int) -> Column:
    """Keys of the templates of a line of n tokens: its own first, then those with one open quarter.

    The lowest bit of a key says that the template has ``specific`` constant tokens or more;
    templates without any have no key.
    """
    def key(value: Column, count: Column) -> Column:
        marked = F.shiftleft(value, 1).bitwiseOR(F.when(count >= specific, 1).otherwise(0).cast("long"))
        return F.when(count > 0, marked)

    def said(but: int | None = None) -> Column:
        total = F.lit(0)
        for k in range(QUARTERS + 1):
            if k != but:
                total = total + F.coalesce(F.get(constants, k), F.lit(0))
        return total

    def without(q: int) -> Column:
        hashed = F.xxhash64(n, F.lit(q), *[F.get(parts, k) for k in range(QUARTERS + 1) if k != q + 1])
        return key(hashed, said(q + 1))

    own = key(F.xxhash64(n, F.lit(-1), parts), said())
    keys = F.when(n >= min_tokens, F.array(own, *[without(q) for q in range(QUARTERS)])).otherwise(F.array(own))
    return F.array_compact(keys)


def _lines(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_digest"), F.split(text, "\n", -1).alias("_lines")
    )


def dropped_lines(
    documents: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, min_tokens: int = MIN_TOKENS,
    specific_tokens: int = SPECIFIC_TOKENS, specific_docs: int = SPECIFIC_DOCS,
) -> DataFrame:
    """(_id, _digest, _drop): sorted positions from 0 of the lines to drop, of documents that have any."""
    def parted(t):
        return F.struct(F.size(t).alias("n"), part_hashes(t, leading).alias("parts"), part_constants(t, leading).alias("said"))

    keys = _let(_let(tokens(F.col("_line")), parted), lambda x: template_keys(
        x["n"], x["parts"], x["said"], min_tokens, specific_tokens
    ))
    keyed = staged(  # read twice, made once
        _lines(documents)
        .select("_id", "_digest", F.posexplode_outer("_lines").alias("_at", "_line"))
        .filter(F.col("_line").rlike(_TOKEN))  # before the tokens: a filter on them would make them twice
        .select("_id", "_digest", "_at", F.explode(keys).alias("_key"))
    )
    needed = F.when(F.col("_key").bitwiseAND(F.lit(1)) == 1, min(min_docs, specific_docs)).otherwise(min_docs)
    recurring = (
        keyed.groupBy("_key", "_id").agg(F.lit(1).alias("_one"))
        .groupBy("_key").agg(F.count(F.lit(1)).alias("_docs"), F.min("_id").alias("_first"))
        .filter(F.col("_docs") >= needed)
        .select(F.col("_key").alias("_known"), "_first")
    )
    return (
        keyed.join(recurring, (F.col("_key") == F.col("_known")) & ~F.col("_id").eqNullSafe(F.col("_first")))
        .groupBy("_id", "_digest")
        .agg(F.array_sort(F.collect_set("_at")).alias("_drop"))
    )


def dedup_lines(
    documents: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, min_tokens: int = MIN_TOKENS,
    specific_tokens: int = SPECIFIC_TOKENS, specific_docs: int = SPECIFIC_DOCS,
) -> DataFrame:
    """``documents`` with recurring lines taken out of ``text``, plus n_lines and n_dropped.

    A line is what stands between line feeds; one without tokens is always kept. A null text has
    no lines and stays null. A template counts once per document however often it recurs inside,
    and its document with the smallest id keeps all its lines. Rows without an id count as one
    document. Repeated rows are kept and treated alike. An empty table gives no rows; texts of any
    length are cut into lines where they are read. Other columns are left as they are, of any name;
    n_lines and n_dropped of the input are replaced.
    """
    free = "_" * (1 + max(len(c) for c in documents.columns))
    drop = dropped_lines(documents, min_docs, leading, min_tokens, specific_tokens, specific_docs).toDF(
        f"{free}id", f"{free}digest", f"{free}drop"
    )
    same = documents["doc_id"].eqNullSafe(F.col(f"{free}id")) & (F.xxhash64(documents["text"]) == F.col(f"{free}digest"))
    lines, dropped = F.split("text", "\n", -1), F.col(f"{free}drop")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    kept = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    return documents.join(drop.hint("merge"), same, "left").select(
        *[F.when(dropped.isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text"
          else documents[c] for c in documents.columns if c not in ("n_lines", "n_dropped")],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(dropped.isNull(), 0).otherwise(F.size(dropped)).cast("long").alias("n_dropped"),
    )
