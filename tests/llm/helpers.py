"""Small tables with the odd rows that every operator must take."""

import random

CLASH = "_id string, _digest string, _text string, _key int, _at int, _n int, bucket int, marks string, score double, kept string, " \
    "_bad string, _BAD_ID string, _kept string, _kept_id string, _kept_text string, _drop string, _drop_id string, _group string"


def documents(spark, rows, clash=True):
    """Rows (doc_id, text[, source]) as a documents table, with further columns of clashing names."""
    full = [(i, t, "en", (s or ["src0"])[0], None if t is None else len(t)) for i, t, *s in rows]
    if clash:
        full = [(*r, "x", "y", "z", 1, 2, 3, 4, "m", 0.5, "k", *"abcdefgh") for r in full]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + (f", {CLASH}" if clash else ""))


def words(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary):x}" for _ in range(n)]


ODD = ["", None, "   \n\n ", "One", "Ünïcode ÄÖ 日本語 🎉 текст", "a b c d e f g h i j", "x" * 5000, "der " * 3000, "\x00 nul \x1f"]


def odd_rows(spark, clash=True):
    """Null and empty texts, long ones, a repeated row, repeated and missing ids."""
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(5, "a b c d e f g h i j"), (5, "another text under the same id"), (None, "no id"), (None, None)]
    return documents(spark, rows, clash)
