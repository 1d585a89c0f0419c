import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from matchlake.llm import sentence_pieces as sp
from tests.llm.helpers import documents, odd_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list("  \t\n▁aeéＡＢｶﾞ①½ﬁ日本🎉🫠　 ̈́ﷺ<>s/thein0\x00​ﾞ가") + [" ", "  ", "the", "ing", "▁▁", " ̈"]
ODD = ["", "   ", "▁", " ▁ ", "a" * 700, "ab " * 300, "日本" * 500, " " * 100, "x" + " " * 50, "¨a", "ﷺ b", "<s></s><unk><0x41>"]


def _number(n):
    out = b""
    while n >= 128:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _variants():
    """The given model, and the same pieces under compiled character maps with all white-space rules."""
    with open(PATH, "rb") as f:
        plain = f.read()
    yield sentencepiece.SentencePieceProcessor(model_file=PATH), sp.model(PATH)
    own = sp.fields(plain)[3][0]
    assert plain.endswith(own)
    pieces = plain[: -len(own) - 1 - len(_number(len(own)))]
    for rule in ("nmt_nfkc", "nfkc_cf"):
        made = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        blob = sp.fields(sp.fields(made)[3][0])[2][0]
        for dummy in (0, 1):
            for squeeze in (0, 1):
                rules = b"\x12" + _number(len(blob)) + blob + bytes([24, dummy, 32, squeeze])
                data = pieces + b"\x1a" + _number(len(rules)) + rules
                yield sentencepiece.SentencePieceProcessor(model_proto=data), sp.PieceModel(data)


VARIANTS = list(_variants())
_random = random.Random(5)


def same(library, model, text):
    ids, starts, ends = model.encode(text)
    ids = np.frombuffer(ids, "<u4").tolist()
    there = library.encode(text, return_type="proto").pieces
    assert ids == [p.id for p in there], text
    assert starts.tolist() == [p.begin for p in there] and ends.tolist() == [p.end for p in there], text
    ids = [model.begin, *ids, model.end]
    assert model.decode(ids) == library.decode(ids), text
    _random.shuffle(ids)
    assert model.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("at", range(len(VARIANTS)))
def test_like_the_library(at):
    for text in ODD:
        same(*VARIANTS[at], text)
    for _ in range(300):
        same(*VARIANTS[at], "".join(_random.choice(ALPHABET) for _ in range(_random.randrange(30))))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(*VARIANTS[0], text)
    same(*VARIANTS[-1], text)


def test_parts_and_forgotten_units(monkeypatch):
    monkeypatch.setattr(sp, "CHUNK_CHARS", 50)
    monkeypatch.setattr(sp, "CACHE_BYTES", 2000)
    for text in [*ODD, "the  end of ▁ it " * 200, "word " * 100 + "日本語" * 100 + " x" * 100]:
        same(*VARIANTS[0], text)


def test_very_long_texts():
    library, model = VARIANTS[0]
    same(library, model, "some words, é and 日本語  again\n" * 60_000)  # some parts of CHUNK_CHARS
    same(library, model, "x" * 300_000)  # one unit


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        sp.PieceModel(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto() + b"\x0a\x03\x0a\x01a")


def test_spans_give_the_text_back(spark):
    docs = odd_rows(spark)
    rows = sp.encode(docs, PATH).collect()
    assert len(rows) == docs.count()
    texts = {(r.doc_id, r.text or "") for r in docs.collect()}
    decoded = {(r.doc_id, r.decoded) for r in sp.decode(sp.encode(docs, PATH), PATH).collect()}
    assert decoded == texts
    for r in rows:
        assert r.covered == r.n_bytes and r.n_tokens == len(r.starts) == len(r.ends) == len(r.ids) // 4
        assert r.ends[-1] == r.n_bytes and list(r.starts[1:]) == list(r.ends[:-1])


def test_empty_table(spark):
    docs = documents(spark, [(1, "a")]).limit(0)
    encoded = sp.encode(docs, PATH)
    assert encoded.count() == 0 and sp.decode(encoded, PATH).count() == 0
