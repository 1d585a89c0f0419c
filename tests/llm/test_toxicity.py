import random
from zlib import crc32

from matchlake.llm import toxicity as T
from tests.llm.helpers import documents, odd_rows, words


def sample(spark, n=900):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = words(i, 60, 800)
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vile", "scornful", "hateful"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, want = sample(spark)
    got = T.score(docs, T.train(docs, labels)).collect()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in want if crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == want[r.doc_id] for r in out) > 0.9 * len(out)
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels, want = sample(spark, 240)
    flipped = spark.createDataFrame(
        [(i, 1 - y if crc32(str(i).encode()) % 3 == 1 else y) for i, y in want.items()], "doc_id long, toxic int")
    a, b = T.train(docs, labels), T.train(docs, flipped)
    assert a["bias"] == b["bias"] and (a["w"] == b["w"]).all()


def test_odd_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.train(odd_rows(spark), none)
    got = T.score(odd_rows(spark), model)
    assert got.count() == odd_rows(spark).count() and {r.score for r in got.collect()} == {0.5}
    assert T.score(odd_rows(spark).limit(0), model).count() == 0
    odd = spark.createDataFrame([(None, 1), (3, None), (3, 1), (3, 0)], "doc_id long, toxic int")
    assert T.score(odd_rows(spark), T.train(odd_rows(spark), odd)).filter("score BETWEEN 0 AND 1").count() == odd_rows(spark).count()
