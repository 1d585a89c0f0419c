"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression over counts of the text gives each document its own evidence. Sums of that
evidence over *all* documents, by host and by path below the host, give beta posteriors: a path
shrinks toward its host and a host toward the global mean, with strengths estimated from the spread
between hosts and between paths. A document's log-odds move by what its site says beyond the mean,
its own share taken out of the site's sums first, so a sparse site moves nothing.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import by_batch, free_name, held_out, staged
from matchlake.llm.quality_rules import Text

KEEP_FROM = 0.5
#: Labelled rows the regression is fitted on at most: those with the smallest hash of their id.
TRAIN_ROWS = 40_000
#: Site columns from host to path; documents name a source and, below it, a language.
HOST, PATH = ["source"], ["source", "lang"]
#: Bounds of the prior strengths, in documents.
WEAKEST, STRONGEST = 1.0, 1e6

FEATURES = ["log_words", "symbols", "repeats", "dup_lines", "word_length", "distinct", "upper", "bangs", "digits", "pipes"]

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))


def features(text: str | None) -> list[float]:
    """Numbers of one text, all of them bounded; zeros if it has no words."""
    t = Text(text)
    n = t.n_words
    if not n:
        return [0.0] * len(FEATURES)
    raw = t.raw

    def count(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    return [
        math.log1p(n), min(t.n_symbols / n, 3.0), t.n_repeat_words / n, t.n_dup_lines / max(t.n_lines, 1),
        min(t.word_chars / n, 40.0), len(set(t.tokens)) / math.sqrt(n * 100) if n > 100 else len(set(t.tokens)) / n,
        count(_UPPER) / max(count(_LETTERS), 1), min(count(b"!") / n, 3.0), min(count(_DIGITS) / n, 5.0),
        min(count(b"|") / n, 3.0),
    ]


def with_features(documents: DataFrame) -> DataFrame:
    """(_id, _digest, site columns, _x): features of every whole text; sites without a name are ''."""
    sites = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in PATH]

    def make():
        return lambda r: {k: v for k, v in r.items() if k != "text"} | {"_x": [features(t) for t in r["text"]]}

    rows = documents.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_digest"), *sites, "text")
    kinds = ", ".join(f"{c} string" for c in PATH)
    return by_batch(rows, make, f"_id long, _digest long, {kinds}, _x array<double>")


def fit(features_of: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Standardised logistic regression on labelled rows that are not held out."""
    good = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.max("quality").cast("double").alias("label"))
        .orderBy(F.xxhash64("_label_id"), "_label_id").limit(train_rows)
    )
    rows = staged(
        features_of.join(F.broadcast(good), F.col("_id") == F.col("_label_id"))
        .select("_id", "label", "_x").repartition(4, "_id")
    )
    classes = [r[0] for r in rows.select("label").distinct().limit(2).collect()]
    if len(classes) < 2:
        p = classes[0] if classes else 0.5
        return {"w": [0.0] * len(FEATURES), "b": math.log((p + 0.01) / (1.01 - p))}
    model = LogisticRegression(regParam=0.001, maxIter=40, labelCol="label", featuresCol="x").fit(
        rows.select("label", array_to_vector("_x").alias("x"))
    )
    return {"w": [float(w) for w in np.asarray(model.coefficients)], "b": float(model.intercept)}


def evidence(features_of: DataFrame, model: dict) -> DataFrame:
    """The regression's probability of good quality, clamped away from 0 and 1, as ``_p``."""
    x: Column = F.lit(model["b"])
    for i, w in enumerate(model["w"]):
        x = x + F.lit(w) * F.col("_x")[i]
    p = 1.0 / (1.0 + F.exp(-x))
    return features_of.withColumn("_p", F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))).drop("_x")


def _strength(groups: DataFrame, centre: Column) -> float:
    """Prior strength by moments: the spread of group means around ``centre`` beyond chance."""
    mean = F.col("_sum") / F.col("_n")
    r = groups.agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum("_sum").alias("s"),
        F.sum(F.col("_n") * (mean - centre) * (mean - centre)).alias("v"),
    ).first()
    if not r["n"]:
        return STRONGEST
    m = r["s"] / r["n"]
    within = m * (1 - m)
    between = r["v"] / r["n"] - within * r["g"] / r["n"]
    return STRONGEST if between <= 0 else min(max(within / between - 1, WEAKEST), STRONGEST)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(documents: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: doc_id, evidence, host_posterior, path_posterior, score, kept, digest.

    Null and empty texts have zero features and are judged like any other text. Without labels the
    evidence is the same for all. Rows without a site form the site ''. Repeated rows count as often
    as they occur; an empty table gives no rows. Further columns are not looked at.
    """
    x = staged(with_features(documents))
    model = fit(x, labels)
    p = evidence(x, model)
    paths = staged(p.groupBy(*PATH).agg(F.sum("_p").alias("_sum"), F.count(F.lit(1)).alias("_n")))
    hosts = paths.groupBy(*HOST).agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    total = hosts.agg(F.sum("_sum").alias("s"), F.sum("_n").alias("n")).first()
    mean = min(max(total["s"] / total["n"], 1e-4), 1 - 1e-4) if total["n"] else 0.5
    by_host = _strength(hosts, F.lit(mean))
    of_host = hosts.select(*HOST, F.col("_sum").alias("_host_sum"), F.col("_n").alias("_host_n"))
    sites = paths.join(of_host, HOST)
    by_path = _strength(sites, F.col("_host_sum") / F.col("_host_n"))
    own = F.col("_p")
    host = (F.col("_host_sum") - own + by_host * mean) / (F.col("_host_n") - 1 + by_host)
    path = (F.col("_sum") - own + by_path * F.col("host_posterior")) / (F.col("_n") - 1 + by_path)
    bounded = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("path_posterior")))
    odds = _logit(own) + _logit(bounded) - math.log(mean / (1 - mean))
    return (
        p.join(sites, PATH)
        .withColumn("host_posterior", host)
        .withColumn("path_posterior", path)
        .withColumn("score", 1.0 / (1.0 + F.exp(-odds)))
        .select(F.col("_id").alias("doc_id"), own.alias("evidence"), "host_posterior", "path_posterior", "score",
                (F.col("score") >= keep_from).alias("kept"), F.col("_digest").alias("digest"))
    )


def keep_good(documents: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Documents that the classifier keeps, with their columns; rows of one id are judged by their text.

    Further columns may have any name: those of the verdict are chosen free of them.
    """
    bad_id, bad_text = free_name(documents, "_bad_id"), free_name(documents, "_bad")
    bad = classify(documents, labels, keep_from).filter(~F.col("kept")).select(
        F.col("doc_id").alias(bad_id), F.col("digest").alias(bad_text)
    ).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_text))
    return documents.join(bad.hint("merge"), same, "left_anti")
