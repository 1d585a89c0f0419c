import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from matchlake.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, key string, n int, block int, name string, depth string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "x", "y") for r in rows], SCHEMA)


def brute(rows):
    """Straight from the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(set)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        new = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
        ends[new].append(c)
        for d in range(len(new) + 1):
            members[new[:d]].add(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children.get(k)
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children.get(k, 0), leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
        for k, m in members.items()
    )


def run(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, ct.trie(df).collect()))


def conversations(seed, n, spread=1):
    r = random.Random(seed)
    texts = ["", "hi", "日本語", "a longer text " * 20, None] + [f"t{i}" for i in range(60)]
    rows = []
    for c in range(n):
        hot = r.random() < 0.35
        for t in range(3 if hot else r.randrange(1, 8)):
            rows.append((c * spread, t, "user" if t % 2 == 0 else r.choice(["bot", "bot", None]), "same" if hot else r.choice(texts)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("keys,size", [(20_000, 10**9), (7, 10**9), (1, 10**9), (20_000, 100)])
def test_against_brute_force(spark, monkeypatch, keys, size):
    monkeypatch.setattr(ct, "BLOCK_KEYS", keys)
    monkeypatch.setattr(ct, "BLOCK_BYTES", size)
    rows = conversations(keys, 600)
    assert run(frame(spark, rows)) == brute(rows)


def test_lists_of_ids_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(ct, "CHUNK_BITS", 4)
    rows = [(c, t, "user", "same") for c in range(-350, 350) for t in range(6)] + [(c + 1000, *r) for c, *r in conversations(9, 40, 1000)]
    assert run(frame(spark, rows)) == brute(rows)


def test_deep_conversations(spark, monkeypatch):
    rows = [(c, t, "user", f"x{t}" if t < 400 + 3 * c else f"{c}") for c in range(0, 60) for t in range(500)]
    monkeypatch.setattr(ct, "BLOCK_KEYS", 9)
    assert run(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, 0, "user", "x" * 100_000), (100, 0, "user", "base")]
    rows += [(101, 0, "user", "own")] * 3  # repeated rows of one turn stay
    rows += [(102, 1, "b", "z"), (102, 1, "a", "y"), (-205, 0, "user", "q"), (-200, 0, "user", "r"), (7_000_000_000_123, 0, "u", "🎉")]
    got = run(frame(spark, rows))
    assert got == brute(rows) and got[0][1] == 0
    assert run(frame(spark, rows).limit(0)) == []


def test_hot_first_turn_reaches_all_layouts():
    tree = ct.RadixTree()
    keys = sorted(hashlib.sha256(str(i).encode()).digest()[:20] for i in range(5000))
    for i, k in enumerate(keys):
        tree.insert(k, (i, 1, "e"))
    layouts = set()
    todo, found = [(tree.root, b"")], []
    while todo:
        node, above = todo.pop()
        layouts.add(node.layout)
        if node.value:
            found.append((above + node.path, node.value[0]))
        todo += [(c, above + node.path) for c in node.in_order()]
    assert layouts == {4, 16, 48, 256} and sorted(found) == [(k, i) for i, k in enumerate(keys)]
    rows = list(ct.walk(tree, keys[0], keys[-1]))
    assert len(rows) == 5001 and sorted(r[0] for r in rows)[-4:] == [-1, 0, 1, 2]
