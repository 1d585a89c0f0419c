import re

from matchlake.llm import decontaminate as D
from tests.llm.helpers import documents, odd_rows, words

_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_UP))


def brute(text, items):
    ws, hit, ids = split(text), set(), set()
    for item, t in items:
        b = split(t)
        k = min(len(b), 10)
        grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
        for i in range(len(ws) - k + 1 if k else 0):
            if tuple(ws[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                ids.add(str(item))
    return len(ws), len(hit), sorted(ids)


def check(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_hits(documents(spark, rows), bench).collect()
    want = sorted((i, *brute(t, items)) for i, t in rows)
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == want


def test_windows_short_items_and_case(spark):
    item = " ".join(words(1, 25))
    rows = [(1, "Intro, " + item.upper() + "! End."), (2, " ".join(item.split()[3:14])), (3, " ".join(item.split()[3:11])),
            (4, "so short an Item is"), (5, "ÄPFEL und äpfel"), (6, item + " gap " + item), (7, "short an item " * 3)]
    check(spark, rows, [(9, item), (10, "short an item"), (11, " ".join(item.split()[5:20])), (12, ""), (13, None), (14, "äPFEL")])


def test_odd_rows_and_no_benchmark(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    got = D.find_hits(odd_rows(spark), empty)
    assert got.count() == odd_rows(spark).count() and got.filter("n_hit > 0").count() == 0
    items = spark.createDataFrame([(1, "der der der der der der der der der der"), (None, "one")], "item_id long, text string")
    hit = {r.doc_id: r.n_hit for r in D.find_hits(odd_rows(spark), items).collect() if r.n_hit}
    assert hit == {7: 3000}
    assert D.find_hits(odd_rows(spark).limit(0), items).count() == 0


def test_removal_judges_rows_by_text(spark):
    item = " ".join(words(3, 12))
    docs = documents(spark, [(1, "bad " + item), (1, "good text"), (2, "fine"), (None, item), (None, None)])
    kept = D.remove_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (1, "good text"), (2, "fine")]
