"""Language identification by prediction by partial matching.

For each language a variable-order context tree over bytes (orders 0 to ``ORDER``) is
counted from labelled texts, then frozen. The probability of a byte after its context is
that of the longest context seen: count / (total + distinct), or else the escape
probability distinct / (total + distinct) times the probability after the next shorter
context, down to 1/256. The code length of a text under a language is the sum of -log2 of
its bytes' probabilities, and the language with the shortest code is predicted. As the
statistics are frozen, a byte's code length depends only on the last ``ORDER`` bytes, so
each distinct window is evaluated once and exactly.

Learning uses at most ``PER_LANGUAGE`` texts of each of at most ``LANGUAGES`` languages (the
most frequent ones), taken by hash; a language whose texts hold no byte is not learned. Null
texts and those without a letter are 'und' with score 0; so is every text if nothing could
be learned. Ties go to the language that is first by name. Letters are lowered first.
Repeated rows get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import join_bytes, map_texts, sums_by, table

ORDER, PER_LANGUAGE, LANGUAGES = 4, 500, 500
_LETTERS = re.compile(r"[^\W\d_]").finditer


def has_letter(text: str) -> bool:
    """Whether any sign is a letter; signs such as a half or a raised two are none."""
    return any(m[0].isalpha() for m in _LETTERS(text))


def _windows(data: np.ndarray, order: int) -> np.ndarray:
    """Code of the last ``order`` + 1 bytes at every position (fewer at the beginning)."""
    code = data.astype(np.int64)
    for k in range(1, order + 1):
        code[k:] |= data[:-k].astype(np.int64) << (8 * k)
    return code


class ContextTrees:
    """Frozen counts of all languages. ``order`` + 1 bytes make a window; zero bytes stand before a text."""

    def __init__(self, texts: dict[str, Iterable[str]], order: int = ORDER):
        texts = {lang: held for lang, x in texts.items() if any(held := list(x))}
        self.languages, self.order = sorted(texts), order
        self.levels = []
        per: list[list[tuple]] = [[] for _ in range(order + 1)]
        for lang in self.languages:
            data, starts, lengths = join_bytes([x.lower().encode("utf-8", "surrogatepass") for x in texts[lang]], order)
            inside = np.zeros(len(data) + 1, np.int64)
            np.add.at(inside, starts, 1)
            np.add.at(inside, starts + lengths, -1)
            code = _windows(data, order)[np.cumsum(inside[:-1]) > 0]
            for k in range(order + 1):
                per[k].append(np.unique(code & ((1 << 8 * (k + 1)) - 1), return_counts=True))
        n = len(self.languages)
        for found in per:
            codes = np.unique(np.concatenate([c for c, _ in found])) if n else np.zeros(0, np.int64)
            counts = np.zeros((len(codes), n), np.int32)
            for j, (c, v) in enumerate(found):
                counts[np.searchsorted(codes, c), j] = v
            context, inverse = np.unique(codes >> 8, return_inverse=True)
            totals, distinct = np.zeros((len(context), n)), np.zeros((len(context), n))
            np.add.at(totals, inverse, counts)
            np.add.at(distinct, inverse, counts > 0)
            self.levels.append((codes, counts, context, totals, distinct))

    def bits(self, windows: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each window, one column per language."""
        out = np.full((len(windows), len(self.languages)), 8.0)
        for k, (codes, counts, contexts, totals, distinct) in enumerate(self.levels):
            if not len(codes):
                continue
            w = windows & ((1 << 8 * (k + 1)) - 1)
            at, cat = np.searchsorted(codes, w), np.searchsorted(contexts, w >> 8)
            at, cat = np.minimum(at, len(codes) - 1), np.minimum(cat, len(contexts) - 1)
            seen = counts[at] * (codes[at] == w)[:, None]
            total = totals[cat] * (contexts[cat] == w >> 8)[:, None]
            escape = distinct[cat]
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = np.log2(total + escape) - np.log2(seen)
                miss = np.log2(total + escape) - np.log2(escape) + out
            out = np.where(total > 0, np.where(seen > 0, hit, miss), out)
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language."""
        data, starts, lengths = join_bytes([x.lower().encode("utf-8", "surrogatepass") for x in texts], self.order)
        out = np.zeros((len(texts), len(self.languages)))
        if len(data):
            number, windows = pd.factorize(_windows(data, self.order))
            bits = self.bits(windows)
            for j in range(bits.shape[1]):
                out[:, j] = sums_by(bits[number, j], starts, lengths)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits = self.code_lengths(texts)
        known = np.array([has_letter(x) for x in texts], bool)
        best = bits.argmin(axis=1)
        share = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0))
        score = np.where(known, 1 / share.sum(axis=1), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], score


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER, languages: int = LANGUAGES) -> ContextTrees:
    """Trees from at most ``per_language`` texts of each language, by hash of id and text; all if there are fewer.

    ``docs`` has doc_id, text, lang. The hash first thins each language to about twice what
    is wanted, so what is ranked stays small at any size; the text of least hash stays
    always. At most ``languages`` counts and ``languages`` x ``per_language`` texts come to the driver.
    """
    docs = docs.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text", F.lit("language")).alias("draw"))
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).orderBy(F.desc("n"), "lang").limit(languages)
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n"))
    chosen = docs.join(F.broadcast(counts), "lang").filter((F.shiftrightunsigned("draw", 11) * F.lit(2.0**-53) < share) | (F.col("draw") == F.col("least")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    texts: dict[str, list[str]] = {}
    for lang, text in chosen.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "text").toLocalIterator():
        texts.setdefault(lang, []).append(text)
    return ContextTrees(texts, order)


def identify(df: DataFrame, trees: ContextTrees, key: str = "doc_id", text: str = "text") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        lang, score = shared.value.predict(texts)
        return {"lang_pred": lang, "score": score}

    return map_texts(df.select(key, text), work, f"`{key}` {dict(df.dtypes)[key]}, lang_pred string, score double", text)


def op3_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4, F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = fit_languages(docs.filter(remainder != 2))
    return identify(docs, trees).select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")
