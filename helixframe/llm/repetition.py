"""Quality rules by suffix-array repetition.

Each text's words are numbered and a suffix array of all texts of a batch is built by
prefix doubling (only suffixes that still tie are sorted again). Longest common prefixes of
neighbours come from the ranks that each doubling left. The deepest prefix interval that
holds a suffix has length L = max(lcp before, lcp after): the longest maximal repeat that
starts there. The union of the spans [i, i + L) over all i with L >= ``min_words`` is the
part of the text that maximal repeats cover.

A text is rejected if that part exceeds ``max_covered`` of its words, or if one repeat is
longer than ``max_repeat`` words. Null and empty texts have no words: every count is 0 and
the base rule (fewer than 50 words) rejects them. Repeated rows get equal results; an empty
table gives an empty one; columns beside key and text are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import fresh, map_texts, table, with_fields

MIN_WORDS, MAX_COVERED, MAX_REPEAT = 5, 0.35, 60
_SPACE, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the length of its longest prefix that starts elsewhere in its text too.

    ``words``: numbers of the words of all texts, one text after another, no number shared
    by two texts. ``ends``: for each position, the end of its text.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    order = np.argsort(words, kind="stable")
    new = np.r_[True, words[order][1:] != words[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    levels, h = [rank], 1
    alone = np.r_[new[1:], True] & new
    active = np.sort(order[~alone])
    while len(active):
        rank = rank.copy()
        nxt = active + h
        second = np.where(nxt < ends[active], levels[-1][np.minimum(nxt, n - 1)] + 1, 0)
        old = levels[-1][active]
        key = old * (n + 1) + second
        o = np.argsort(key, kind="stable")
        k, old, idx = key[o], old[o], np.arange(len(o))
        new = np.r_[True, k[1:] != k[:-1]]
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], idx, 0))
        rank[active[o]] = old + np.maximum.accumulate(np.where(new, idx, 0)) - group
        active = np.sort(active[o][~(np.r_[new[1:], True] & new)])
        levels.append(rank)
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = at
    same = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    i, j = sa[same], sa[same + 1]
    lcp = np.zeros(len(same), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + lcp, j + lcp
        ok = (a < ends[i]) & (b < ends[j])
        eq = ok & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        lcp[eq] += 1 << k
    out = np.zeros(n, np.int64)
    np.maximum.at(out, i, lcp)
    np.maximum.at(out, j, lcp)
    return out


def covered(length: np.ndarray, least: int, fixed: int | None = None) -> np.ndarray:
    """Which positions the spans [i, i + length[i]) (or of ``fixed`` words) with length >= ``least`` cover."""
    i = np.flatnonzero(length >= least)
    reach = np.zeros(len(length), np.int64)
    reach[i] = i + (length[i] if fixed is None else fixed)
    return np.maximum.accumulate(reach) > np.arange(len(length))


def measure(texts: list[str], min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    number: dict = defaultdict(itertools.count().__next__)
    n_words, chars, symbols, dup_lines, ids = [], [], [], [], []
    for k, text in enumerate(texts):
        b = text.encode("utf-8", "surrogatepass")
        words = b.split()
        n_words.append(len(words))
        chars.append(len(text) - len(b) + len(b.translate(None, _SPACE)))
        symbols.append(len(b) - len(b.translate(None, _SYMBOLS)))
        lines = [x for x in b.split(b"\n") if x.strip(_SPACE)]
        dup_lines.append(len(lines) - len(set(lines)))
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    n = np.array(n_words, np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    ends = np.repeat(np.cumsum(n), n)
    words = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    length = longest_repeats(words + doc * (len(number) + 1), ends)
    count = lambda flags: np.bincount(doc[flags], minlength=len(texts))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, length)
    return {
        "n_words": n,
        "word_chars": np.array(chars, np.int64),
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": count(covered(length, 3, 3)),
        "n_covered_words": count(covered(length, min_words)),
        "longest_repeat": longest,
    }


def judge(texts: list[str], min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> dict[str, np.ndarray]:
    m = measure(texts, min_words)
    m["base_failed"] = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    m["repetitive"] = (m["n_covered_words"] > max_covered * m["n_words"]) | (m["longest_repeat"] > max_repeat)
    m["kept"] = ~m["base_failed"] & ~m["repetitive"]
    return m


def score_repetition(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures and the verdict of every row, beside its key."""
    kind = dict(df.dtypes)[key]
    schema = (
        f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
    )
    return map_texts(df.select(key, text), lambda batch, texts: judge(texts), schema, text)


def filter_repetition(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes the rules, with all their columns."""
    (flag,) = fresh(df.columns, "kept_by_repetition")
    return map_texts(df, lambda batch, texts: {flag: judge(texts)["kept"]}, with_fields(df.schema, **{flag: BooleanType()}), text).filter(F.col(flag)).drop(flag)


def op8_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_repetition(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, "n_covered_words", "longest_repeat")
