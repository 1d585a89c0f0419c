import random
from collections import defaultdict

import numpy as np

from matchlake.llm import jaccard as J
from tests.llm.helpers import documents, odd_rows, words


def near(seed, base, edits):
    r = random.Random(seed)
    w = list(base)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def brute(rows):
    s = J.Shingler()
    sets = defaultdict(list)
    for i, t in rows:
        sets[frozenset(s.shingles(t).tolist())].append(i)
    reps = {min(v): k for k, v in sets.items()}
    links = {a: {b for b, y in reps.items() if b != a and x and y and len(x & y) >= 0.8 * len(x | y)} for a, x in reps.items()}
    group = {}
    for a in sorted(reps):
        todo = [a]
        while todo:
            b = todo.pop()
            if b not in group:
                group[b] = a
                todo += links[b]
    return {i: (min(v), len(v), len(links[min(v)]), group[min(v)]) for v in sets.values() for i in v}


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = []
    for g in range(40):
        base = words(g, r.randrange(40, 300))
        for k in range(r.randrange(1, 7)):
            rows.append((len(rows) * 3 % 1009, near(g * 100 + k, base, r.choice([0, 0, 1, 2, 4, 8]))))
    rows += [(2000 + i, t) for i, t in enumerate(["", None, "one", "one", "a b c d", "A, b. c d!"])]
    got = {x.doc_id: (x.class_id, x.n_copies, x.n_links, x.group_id) for x in J.join(documents(spark, rows)).collect()}
    assert got == brute(rows)


def test_large_groups_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 2000)
    base = words(7, 120)
    rows = [(i, near(i, base, 1 + i % 3)) for i in range(90)]
    got = {x.doc_id: (x.class_id, x.n_copies, x.n_links, x.group_id) for x in J.join(documents(spark, rows)).collect()}
    assert got == brute(rows)


def test_probability_and_verification():
    assert J.found_probability(0.8, J.DEPTHS[0]) > 0.998 and J.found_probability(1.0, 8) == 1
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    links, _, root = J.verify(np.arange(30), sets, np.zeros(30, int), 5, 0.5)
    want = [sum(len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) for b in sets) - 1 for a in sets]
    assert links.tolist() == want and (root <= np.arange(30)).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 60), (70, 70)]
    got = dict((r.node, r.root) for r in J.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 50: 40, 60: 40}


def test_odd_rows(spark):
    got = J.join(odd_rows(spark)).collect()
    assert len(got) == odd_rows(spark).count()
    assert {r.doc_id: r.n_copies for r in got}[0] == 4  # the texts without words, of which one has no id
    assert J.join(odd_rows(spark).limit(0)).count() == 0
    kept = J.keep_one(odd_rows(spark))
    assert kept.columns == odd_rows(spark).columns
    assert sum(1 for r in kept.collect() if not (r.text or "").strip()) == 1


def test_unrelated_documents_without_an_id_or_with_one_id_stay(spark):
    a, b, c, d = (" ".join(words(seed, 60)) for seed in range(4))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (5, d), (6, near(1, d.split(), 1)), (None, c)]
    got = [(r.doc_id, r.text) for r in J.keep_one(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (5, c), (5, d)], key=str)


def test_pairs_of_a_block_count_once_beside_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 100)
    rows = [(10 * g + k, near(10 * g + k, words(g, 120), 1)) for g in range(8) for k in range(3)]
    got = {x.doc_id: (x.class_id, x.n_copies, x.n_links, x.group_id) for x in J.join(documents(spark, rows)).collect()}
    assert got == brute(rows)


def test_a_hot_group_does_not_change_which_links_of_others_are_found(spark):
    s = J.Shingler()

    def meet(texts, depth):
        a, b = (np.frombuffer(J.signature(s.shingles(t)), "<u4").reshape(J.TREES, J.DEPTH)[:, :depth] for t in texts)
        return (a == b).all(axis=1).any()

    def pair(seed):
        w = words(seed, 58, 10**6)  # 48 of 60 shingles in common
        return " ".join(w), " ".join([*w[:20], f"new{seed}", "next", *w[22:]])

    lone = next(p for p in map(pair, range(10**5)) if not meet(p, J.DEPTHS[0]) and meet(p, J.DEPTHS[1]))
    hot = words(-1, 400)
    rows = [(i, near(i, hot, 1)) for i in range(30)] + [(100 + i, t) for i, t in enumerate(lone)]
    got = {x.doc_id: (x.class_id, x.n_copies, x.n_links, x.group_id) for x in J.join(documents(spark, rows)).collect()}
    assert got == brute(rows) and got[101] == (101, 1, 1, 100)
