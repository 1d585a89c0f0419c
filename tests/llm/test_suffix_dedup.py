import hashlib
import random

import numpy as np
import pytest

from matchlake.llm import suffix_dedup as S
from tests.llm.helpers import documents, odd_rows


def brute(rows):
    """rows: (id, text); ids may repeat and count as one document then."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - S.LENGTH + 1):
            s = b[k : k + S.LENGTH]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - S.LENGTH + 1):
            if first[b[k : k + S.LENGTH]] < i:
                gone[k : k + S.LENGTH] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup(documents(spark, rows)).collect())


def corpus(seed, n):
    r = random.Random(seed)
    parts = ["".join(r.choice("abcd é🎉\n") for _ in range(r.randrange(10, 140))) for _ in range(12)]
    return [(i * 7 % 101, "".join(r.choice(parts)[r.randrange(8) :] for _ in range(r.randrange(12))) + r.choice(["", "ab" * 60, "z" * 99])) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = corpus(seed, 60)
    assert run(spark, rows) == brute(rows)


def test_boundaries(spark):
    base = "".join(chr(97 + i * 7 % 26) for i in range(49)) + "!"
    rows = [(1, base[:49]), (2, base), (3, "x" + base + "y"), (4, base[:25]), (5, base[25:]), (6, base[:49] + "?"), (7, base + base), (8, base + base)]
    assert run(spark, rows) == brute(rows)


def test_texts_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", 300)
    rows = corpus(9, 12) + [(500 + i, "".join(t or "" for _, t in corpus(9, 12))) for i in range(2)]
    found = S.pieces([(t or "").encode() for _, t in rows])
    assert sum(found[2]) == sum(max(len((t or "").encode()) - S.LENGTH + 1, 0) for _, t in rows)  # every string once


def test_run_length_index():
    r = random.Random(2)
    base = [bytes(r.choice(b"abcd") for _ in range(76)) for _ in range(6)]
    texts = list({b[k : k + r.randrange(50, 77 - k)] for b in base for k in range(8)})
    docs = np.array([r.randrange(30) for _ in texts])
    index = S.RunLengthIndex(texts, docs)
    assert len(index.run_start) < sum(map(len, texts)) // 2  # repetitive texts have few runs
    low = index.stream()
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            assert low[i, k] == min(d for u, d in zip(texts, docs) if t[k : k + 50] in u)


def test_odd_rows(spark):
    got = S.dedup(odd_rows(spark))
    assert got.count() == odd_rows(spark).count() and got.filter("n_removed > 0").count() == 0
    assert S.dedup(odd_rows(spark).limit(0)).count() == 0
    twice = [(1, "q" * 20 + "unique text that is long enough to be a repeated string"), (None, "unique text that is long enough to be a repeated string")]
    assert {r.doc_id: r.n_removed for r in S.dedup(documents(spark, twice)).collect()} == {1: len(twice[1][1]), None: 0}


def test_rows_of_one_id_with_different_texts(spark):
    r = random.Random(5)
    passage, *ends = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (90, 80, 80, 80, 80, 80)]
    for i in (None, 1):
        rows = [(i, ends[0] + passage + ends[1]), (i, ends[4] + ends[2]), (7, ends[2] + passage + ends[3]), (8, ends[1] + passage + ends[4])]
        want = brute([(-1 if d is None else d, t) for d, t in rows])
        got = S.dedup(documents(spark, rows)).collect()
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want


def test_hot_pieces_are_dealt_in_parts(spark, monkeypatch):
    r = random.Random(6)
    hot = "".join(r.choice("abcdefgh ") for _ in range(120))
    rows = [(i, "".join(r.choice("ijklmnop ") for _ in range(70)) + (hot if i % 3 else "")) for i in range(300)] + corpus(4, 40)
    docs = documents(spark, rows).repartition(40)
    held = []
    shared = S._shared
    monkeypatch.setattr(S, "_shared", lambda x: held.append(x) or shared(x))
    monkeypatch.setattr(S, "PART_ENTRIES", 400)
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in S.dedup(docs).collect())
    assert got == brute(rows)
    dealt = S._with_parts(held[0])
    assert dealt.groupBy("bucket").agg(S.F.expr("sum(octet_length(packed)) / 11").alias("n")).agg({"n": "max"}).first()[0] > 2000
    assert dealt.groupBy("bucket", "_part").agg(S.F.expr("sum(octet_length(packed)) / 11").alias("n")).agg({"n": "max"}).first()[0] < 1000


def test_hashing_holds_little():
    import tracemalloc

    r = random.Random(3)
    texts = [r.randbytes(2000).replace(b"\xff", b"") for _ in range(1500)]
    tracemalloc.start()
    S.pieces(texts)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60  # 191 with parts of 2 MB


def test_places_in_an_index_are_those_of_sorted_suffixes():
    r = random.Random(5)
    some = sorted({bytes(r.choice(b"ab") for _ in range(r.randrange(50, 77))) for _ in range(40)} | {b"a" * n for n in range(50, 77)})
    suffixes = sorted((t[k:] + b"\xff", d) for d, t in enumerate(some) for k in range(len(t) + 1))
    ends = [i for i, (t, _) in enumerate(suffixes) if t == b"\xff"]
    assert S.RunLengthIndex(some, np.arange(len(some))).end_place.tolist() == ends
