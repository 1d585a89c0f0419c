import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchlake.llm import token_counts as C
from tests.llm.helpers import ODD, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [t for t in ODD if t and len(t) < 400] + [
    "don't you're  they've 're\n\n x  y\t\tz <|endoftext|> <|endof it's", "   ", "\n\n  'tis", "a" * 150,
    "<|endoftext|><|endoftext|>", " <|endoftext|>\n a  <|endoftext|>", "!'re　x  y\x85z\x1cq", "🎉" * 40,
]


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix(text):
    library, table = Tokenizer.from_file(PATH), C.counter(PATH).deltas(text)
    want = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
    assert [C.tokens_of_prefix(table, p) for p in range(len(text) + 1)] == want
    for budget in (0, 1, 3, 10_000):
        assert C.longest_prefix(table, budget) == max(p for p, n in enumerate(want) if n <= budget)


def test_rows(spark):
    library = Tokenizer.from_file(PATH)
    rows = odd_rows(spark)
    got = sorted((r.n_bytes, r.n_tokens) for r in C.prefix_counts(rows, PATH).collect())
    texts = [r.text or "" for r in rows.collect()]
    assert got == sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert C.prefix_counts(rows.limit(0), PATH).count() == 0


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in C.prefix_counts(docs, PATH).select("doc_id", "n_tokens").collect()}
    assert got == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
