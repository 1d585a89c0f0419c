"""Quality rules as a short-circuit cascade.

Every rule is a small function of the counts of one text. On a bounded sample each rule is timed
and its share of rejections measured; the cascade then runs the rules in the order of rejections
per second, and a document leaves it at the first rule that rejects. The verdict is the same in
any order, only the work differs.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import by_batch

#: Rows by which costs and rejections are estimated (the order of the rules, never the verdict).
SAMPLE_ROWS = 500

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
_UPPER_WORD = re.compile(r"\b[^\W\d_]{2,}\b")


def repeated_words(tokens: list[bytes]) -> int:
    """Words inside any 5-word window that occurs twice or more, its first occurrence included."""
    n = len(tokens)
    if n < 6:
        return 0
    seen: dict[bytes, int] = {}
    number = np.fromiter((seen.setdefault(t, len(seen)) for t in tokens), np.int64, n)
    if len(seen) == n:
        return 0
    # equal windows have equal sums; most texts end here, the others are numbered exactly
    with np.errstate(over="ignore"):
        u = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        u ^= u >> np.uint64(29)
        mix = u[:-4].copy()
        for k in range(1, 5):
            mix = mix * np.uint64(0xD6E8FEB86659FD93) + u[k : n - 4 + k]
    mix.sort()
    if not (mix[1:] == mix[:-1]).any():
        return 0
    ids = _pair_numbers(number[:-1], number[1:])
    ids = _pair_numbers(ids[:-2], ids[2:])
    ids = _pair_numbers(ids[:-1], number[4:])
    hit = np.bincount(ids)[ids] > 1
    mark = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(mark, starts, 1)
    np.subtract.at(mark, starts + 5, 1)
    return int((np.cumsum(mark)[:n] > 0).sum())


def _pair_numbers(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Small numbers that are equal where both parts are."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


class Text:
    """One text with its base counts; further counts are made when a rule asks for them."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")
        self.tokens = self.raw.split()
        self.n_words = len(self.tokens)
        n_space = len(self.raw) - len(self.raw.translate(None, _SPACE))
        self.word_chars = len(self.text) - n_space
        self.n_symbols = len(self.raw) - len(self.raw.translate(None, _SYMBOLS))
        lines = [line for line in self.raw.split(b"\n") if line.strip()]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words = repeated_words(self.tokens)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


def _shouting(t: Text) -> bool:
    upper = sum(w.isupper() for w in _UPPER_WORD.findall(t.text))
    return upper > 0.4 * t.n_words


def _one_word(t: Text) -> bool:
    return len(set(t.tokens)) < 0.1 * t.n_words and t.n_words < 2000


def _bangs(t: Text) -> bool:
    return t.raw.count(b"!!") > 0.3 * t.n_words


#: Name -> True if the text is rejected.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: t.n_symbols > 0.15 * t.n_words,
    "duplicate_lines": lambda t: t.n_lines >= 5 and t.n_dup_lines > 0.3 * t.n_lines,
    "word_length": lambda t: not 2 <= t.word_chars / t.n_words <= 20,
    "few_words": _one_word,
    "shouting": _shouting,
    "bangs": _bangs,
}


def rule_order(sample: list[str | None], rules: dict[str, Callable[[Text], bool]] = RULES) -> list[str]:
    """Rule names by rejections per second on the sample, best first; names settle ties."""
    texts = [x for x in map(Text, sample) if not x.base_failed]
    gain = {}
    for name, rule in rules.items():
        began = time.perf_counter()
        rejected = sum(map(rule, texts))
        gain[name] = rejected / max(time.perf_counter() - began, 1e-9)
    return sorted(rules, key=lambda k: (-gain[k], k))


def apply_rules(
    documents: DataFrame, order: list[str] | None = None, rules: dict[str, Callable[[Text], bool]] = RULES,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, rejected_by.

    Null and empty texts have no words and fail the base. ``rejected_by`` is the rule at which the
    cascade ended (``base``, a rule, or null). Rows are independent: repeated rows and ids, null
    ids and further columns change nothing. An empty table gives no rows.
    """
    if order is None:
        order = rule_order([r[0] for r in documents.select("text").limit(sample_rows).collect()], rules)
    steps = [(name, rules[name]) for name in order]

    def make():
        def run(rows: dict) -> dict:
            out: dict[str, list] = {k: [] for k in (*_COUNTS, "kept", "rejected_by")}
            for text in rows["text"]:
                t = Text(text)
                why = "base" if t.base_failed else next((name for name, rule in steps if rule(t)), None)
                for k in _COUNTS:
                    out[k].append(getattr(t, k))
                out["kept"].append(why is None)
                out["rejected_by"].append(why)
            return out | {"doc_id": rows["doc_id"]}

        return run

    return by_batch(
        documents.select(F.col("doc_id").cast("long"), "text"), make,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, rejected_by string",
    )
