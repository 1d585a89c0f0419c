import random
import re
from collections import Counter

import pytest

from matchlake.llm import quality_classifier as Q
from matchlake.llm import quality_rules as R
from tests.llm.helpers import documents, odd_rows, words


def brute(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    rep = {i + k for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def counts(text):
    t = R.Text(text)
    return t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words


@pytest.mark.parametrize("seed", range(30))
def test_base_counts(seed):
    r = random.Random(seed)
    parts = [r.choice(["a", "bb", "ü#", "<x>", "$", "z "]) + r.choice([" ", "\n", "\t", "  ", "\x0b", " "]) for _ in range(r.randrange(120))]
    text = "".join(parts)
    assert counts(text) == brute(text)


def test_base_counts_of_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert counts(r.text) == brute(r.text)


def test_cascade(spark):
    clean = " ".join(words(1, 200))
    rows = [(1, clean), (2, "SHOUT LOUD AND EVERY WORD " * 1 + " ".join(w.upper() for w in "all of these words are loud and many more too".split())),
            (3, " ".join(w + "###" for w in words(2, 50))), (4, "few words"), (5, "same words again and again " * 30)]
    got = {r.doc_id: (r.kept, r.base_failed) for r in R.apply_rules(documents(spark, rows)).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, False), 4: (False, True), 5: (False, True)}
    kept = [{r.doc_id for r in R.apply_rules(documents(spark, rows), order=o).filter("kept").collect()} for o in (list(R.RULES), list(R.RULES)[::-1])]
    assert kept == [{1}, {1}]


def test_order_prefers_rejections_per_second():
    slow = {"cheap": lambda t: True, "never": lambda t: False, "dear": lambda t: sum(range(20_000)) > 0}
    assert R.rule_order([" ".join(words(i, 20)) for i in range(30)], slow) == ["cheap", "dear", "never"]


def test_odd_rows(spark):
    got = R.apply_rules(odd_rows(spark))
    assert got.count() == odd_rows(spark).count() and R.apply_rules(odd_rows(spark).limit(0)).count() == 0
    want = sorted(brute(r.text) for r in odd_rows(spark).collect())
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()) == want


def test_classifier_is_right_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    want = {r.doc_id: r.quality for r in labels.collect()}
    got = Q.classify(docs, labels).withColumn("out", Q.held_out(Q.F.col("doc_id"))).collect()
    assert len(got) == docs.count()
    out = [r for r in got if r.out and r.doc_id in want]
    assert sum(r.kept == (want[r.doc_id] == 1) for r in out) >= 0.97 * len(out)


def test_sites_shrink_to_the_global_mean(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = r.random() < (0.9 if i % 2 else 0.3)
        text = " ".join(words(i, 60) if good else [w + "###" for w in words(i, 60)])
        rows.append((i, text, f"host{i % 2}"))
        labels.append((i, int(good)))
    rows.append((1000, " ".join(words(1000, 60)), "lonely"))
    got = {x.doc_id: x for x in Q.classify(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    mean = sum(x.evidence for x in got.values()) / len(got)
    assert abs(got[1000].host_posterior - mean) < 0.02  # its own share is taken out
    assert got[0].host_posterior < mean < got[1].host_posterior


def test_classifier_on_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.classify(odd_rows(spark), none).count() == odd_rows(spark).count()
    assert Q.classify(odd_rows(spark).limit(0), none).count() == 0
    one = spark.createDataFrame([(5, 1), (None, 0), (6, None)], "doc_id long, quality int")
    kept = Q.keep_good(odd_rows(spark), one)
    assert kept.columns == odd_rows(spark).columns and kept.count() == odd_rows(spark).count()


def test_arrow_batches_are_bounded_by_their_bytes(spark):
    from matchlake.llm.common import BATCH_BYTES, by_batch

    long = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "repeat('x', 100000) AS text")
    got = by_batch(long, lambda: lambda r: {"n": [len(r["text"])] * len(r["text"])}, "n long").collect()
    assert len(got) == 200 and max(x.n for x in got) * 100_000 <= 1.1 * BATCH_BYTES
