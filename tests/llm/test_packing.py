import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchlake.llm import packing as P
from tests.llm.helpers import odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def padding(n):
    return 0 if n & (n - 1) == 0 else P.SIZE - n


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_optimal(seed, monkeypatch):
    monkeypatch.setattr(P, "SHORTEST", 4)
    r = random.Random(seed)
    at = np.cumsum([0] + [r.randrange(1, 14) for _ in range(40)])
    penalty = np.array([r.choice([0, 8, 32]) for _ in at])
    size = 16

    def cost(a, b):
        n = int(at[b] - at[a])
        full = size - n
        return min(full, P.SHORT_PENALTY) if n & (n - 1) == 0 and 4 <= n < size else full

    best = [0] + [10**9] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            if at[j] - at[i] <= size:
                best[j] = min(best[j], best[i] + cost(i, j) + int(penalty[j]))
    cuts = P.choose_cuts(at, penalty, size)
    index = {int(x): k for k, x in enumerate(at)}
    k = [index[c] for c in cuts]
    assert sum(cost(a, b) + int(penalty[b]) for a, b in zip(k, k[1:])) == best[-1]


def test_encoder_is_the_library():
    library = Tokenizer.from_file(PATH)
    texts = ["Don't you're İstanbul ΑΣΣ ΟΔΟΣ. 're\n\n x <|endoftext|>a <|endof 日本語 🎉é é ́x a\x1cb a b​c", "", None,
             "<|startoftext|>", "Ünïcode² ½ K Å ﬁ"]
    got = [np.frombuffer(x, "<u4").tolist() for x in P.encoder(PATH).encode(texts)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def check(rows, docs):
    library = Tokenizer.from_file(PATH)
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= P.SIZE
    want = defaultdict(list)
    for d in docs:
        want[d.doc_id].append(library.encode(d.text or "", add_special_tokens=False).ids + [P.END_ID])
    for i, each in want.items():
        if len(each) > 1:
            continue
        ids, at = np.array(each[0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = sum(len(x) for each in want.values() for x in each)
    assert total == sum(r.length for r in rows)
    return sum(padding(sum(n for _, n in p)) for p in sequences.values()) / total


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = P.pack(docs, PATH).drop("ids").collect()
    assert check(rows, docs.collect()) < 0.02
    small = P.pack(docs, PATH, block_tokens=5000).drop("ids").collect()
    check(small, docs.collect())


def test_odd_rows(spark):
    docs = odd_rows(spark)
    check(P.pack(docs, PATH).collect(), docs.collect())
    assert P.pack(docs.limit(0), PATH).count() == 0


def test_chunks_are_parted_where_the_library_parts_them():
    library = Tokenizer.from_file(PATH)
    assert [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (P._CHUNK.match(chr(c)) is None) != chr(c).isspace()
            ] == ["\x1c", "\x1d", "\x1e", "\x1f"]
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [s.join(["Über", "das...", "One,", "a1-b", "!?", "x"]) for s in spaces] + ["a.b a... ... A. a"]
    encoder = P.Encoder(PATH)
    for _ in range(2):  # the second time from what is kept, words and signs alike
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    encode = library.encode(" ".join(encoder.known), add_special_tokens=False)
    assert b"".join(encoder.known.values()) == np.array(encode.ids, "<u4").tobytes()
