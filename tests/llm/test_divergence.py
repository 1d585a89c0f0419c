import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from matchlake.llm import divergence
from tests.llm.helpers import CLASH, odd_rows

_TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """Straight from the definition, over (text, lang, source)."""
    counts, there, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(_LOWER) for t in _TERM.findall(text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        there[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in there[lang].items() if n >= 10)
        mine = {s: {t: counts[lang, s][t] for t in kept} for g, s in groups if g == lang}
        whole = {t: sum(m[t] for m in mine.values()) for t in kept}

        def share(m):
            below = sum(m.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (m[t] + 2) // below for t in kept}

        p = {s: share(m) for s, m in mine.items()}
        q = share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in mine if o != s]
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(sorted(pairs))}
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if mine[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(sorted(terms)[:10])}
    return out


def frame(spark, rows):
    full = [(i, *r, 1, "x", "y", "z", 1, 2, 3, 4, "m", 0.5, "k", 7, 8, 9) for i, r in enumerate(rows)]
    names = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}, term int, block long, rank int"
    return spark.createDataFrame(full, names)


def corpus(seed, n, sources):
    r = random.Random(seed)
    vocabulary = ["the", "Éa", "日本", "the-end", "a1b", "ÀB"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for _ in range(n):
        k = min(int(r.expovariate(0.3)), sources - 1)  # one source holds about a third
        words = r.choices(vocabulary[k % 7 :], weights=[1 / (i + 1) for i in range(len(vocabulary) - k % 7)], k=r.randrange(60))
        rows.append((r.choice([" ", "\n", "... "]).join(words), r.choice(["en", "en", "de", None, "xx" if r.random() < 0.02 else "en"]), r.choice([f"s{k}", f"s{k}", None])))
    return rows


@pytest.mark.parametrize("terms,sources", [(16_384, 40), (32, 40), (32, 3)])
def test_against_brute_force(spark, monkeypatch, terms, sources):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", sources)
    rows = corpus(terms + sources, 700, 12)
    rows += [("", "alone", "s1"), (None, None, "only null"), ("a " * 50_000, "en", "long"), ("Aa aA", "zz", "s1"), ("b", "zz", "s2")]
    got = divergence.audit(frame(spark, rows)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows)


def test_ties_go_by_bytes(spark):
    rows = [(t, "en", s) for s in ("s1", "s2", "é", "z") for t in ("alpha beta Gamma", "ÄÖ ß") for _ in range(10)]
    assert {tuple(r) for r in divergence.audit(frame(spark, rows)).collect()} == brute(rows)


def test_large_counts_are_exact():
    counts = np.array([[9_300_000_000_000, 1, 0], [5, 7_000_000_000_000, 0]])
    trees = divergence.Trees(counts)
    p, q = trees.shares(int(counts[0].sum()), 3), trees.shares(int(counts[1].sum()), 3)
    exact = [[1 + 10**9 * (int(c) + 2) // (int(r.sum()) + 6) for c in r] for r in counts]
    assert trees.price(trees.roots[0], trees.roots[1], p, q) == sum((a - b) ** 2 // (a + b) for a, b in zip(*exact))


def test_equal_subtrees_are_one_node():
    trees = divergence.Trees(np.array([[3, 1, 3, 1, 0, 0, 0, 0], [0, 0, 0, 0, 3, 1, 3, 1]]))
    assert [len(left) for left, _ in trees.levels] == [2, 2, 2]  # (3, 1) and (0, 0); those doubled; two roots
    assert sorted(trees.places(trees.roots[1])) == [4, 5, 6, 7]


def test_long_text_in_parts(monkeypatch):
    text = ("Über-Maß AB cd\x00éé " * 100).encode()
    whole = list(divergence.terms_of(text))[0]
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 7)
    assert [t for part in divergence.terms_of(text) for t in part] == whole
    assert [t.decode() for t in whole] == [t.translate(_LOWER) for t in _TERM.findall(text.decode())]


def test_counters_handed_on_early(spark, monkeypatch):
    rows = corpus(3, 200, 4)
    monkeypatch.setattr(divergence, "COUNTED_TERMS", 20)
    assert {tuple(r) for r in divergence.audit(frame(spark, rows)).collect()} == brute(rows)


def test_odd_rows_and_empty_table(spark):
    assert divergence.audit(odd_rows(spark)).filter("part = 'term'").count() == 0
    assert divergence.audit(odd_rows(spark).limit(0)).count() == 0
