"""Phrases whose words stand together more often than their parts would by chance.

Texts are cut into pieces at punctuation; equal pieces of a language are one row with a
multiplicity. Phrases are counted order by order over these rows. A phrase can reach the
least count only if the two phrases of one word less inside it do, so places where one of
these does not are left out before counting: a bitmap of ``BITS`` bits, of fixed size and
broadcast, holds the hashes of those that do. It lets some others through, never fewer, so
counts stay exact at any size; only its use fades. What is left is summed in the batch,
shuffled by its hash, and each hash bucket summed by duckdb within ``BUCKET_MEMORY``, beyond
which it goes to disk.

A cut phrase needs the counts of its two parts: every candidate sends a request for each
part, shuffled to the counts by the part; the replies are brought back to the candidate.
Requests whose reply equals the candidate's own count also say which candidates lie in a
longer one as frequent as they are: a longer phrase that drops a candidate leaves every
phrase between the two at the same count, so one word more is all that must be looked at.

Null texts are empty, null languages are ``und``. Repeated rows count each. Empty tables give
no rows. Products are exact decimals of 38 digits. Columns beside text and language are
ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, mix64, table, translated

#: Words of the longest phrase, and its least count.
ORDERS, LEAST = 5, 100
#: Bits of the filter between two orders: 16 MB, whatever the input.
BITS = 1 << 27
#: Bytes of pieces that are counted together before they are shuffled.
STEP = 12 << 20
BUCKET_MEMORY = "400MB"
#: Parts that each language's candidates are dealt to before the first are taken.
DEAL = 64
#: Languages whose word counts are broadcast at most.
BROADCAST_LANGS = 10_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, piece, m): the distinct pieces of each language, lower-cased with single blanks, and how often they occur."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text_")).filter("text_ is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)):
                parts = pc.split_pattern(translated(batch.column("text_"), _LOWER), "\n")
                flat, of = parts.flatten(), pc.list_parent_indices(parts)
                flat = pc.ascii_trim(flat, " ")
                some = pc.greater(pc.binary_length(flat), 0)
                flat, of = flat.filter(some), of.filter(some)
                if pc.any(pc.match_substring(flat, "  ")).as_py():
                    flat = pc.replace_substring_regex(flat, " +", " ")
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(of), flat.cast(pa.string())], ["lang", "piece"])

    return rows.mapInArrow(run, "lang string, piece string").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))


def _hashes(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(values.to_pylist(), dtype=object), categorize=False).astype(np.uint64)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_bits(langs: np.ndarray, words: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bit, below ``bits``, of each ``order`` consecutive words: langs and words are 64-bit hashes; shorter than ``words`` by order - 1."""
    n = len(words) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = langs[:n].copy()
        for j in range(order):
            total = total * _STEP + words[j : j + n]
        return (mix64(total) & np.uint64(bits - 1)).astype(np.int64)


def phrase_bits(langs: pa.Array, phrases: pa.Array, order: int, bits: int) -> np.ndarray:
    """The same bits for phrases of ``order`` words as text."""
    words = _hashes(pc.split_pattern(phrases, " ").flatten())
    return gram_bits(np.repeat(_hashes(langs), order), words, order, bits)[::order]


def _counted(batch: pa.Table, order: int, filled: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """(lang, phrase, f) of one step of pieces; order 1 has a row with the phrase '' for all words of a language."""
    lists = pc.ascii_split_whitespace(batch.column("piece").combine_chunks())
    flat, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    words = flat.dictionary_encode()
    code, vocabulary = words.indices.to_numpy().astype(np.int64), words.dictionary
    langs = batch.column("lang").combine_chunks().dictionary_encode()
    lang_of, lang_names = langs.indices.to_numpy().astype(np.int64), langs.dictionary
    weight = batch.column("m").to_numpy()
    if order == 1:
        key, at = np.unique(lang_of[of] * max(1, len(vocabulary)) + code, return_inverse=True)
        f = np.bincount(at, weight[of], len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        lang, word = key // max(1, len(vocabulary)), key % max(1, len(vocabulary))
        total = np.bincount(lang, f, len(lang_names)).astype(np.int64)
        names = pa.concat_arrays([lang_names.take(pa.array(lang)), lang_names])
        phrases = pa.concat_arrays([vocabulary.take(pa.array(word)).cast(pa.string()), pa.array([""] * len(lang_names))])
        return pa.RecordBatch.from_arrays([names, phrases, pa.array(np.r_[f, total])], ["lang", "phrase", "f"])
    word_hash, lang_hash = _hashes(vocabulary)[code], _hashes(lang_names)[lang_of][of]
    bit = gram_bits(lang_hash, word_hash, order - 1, bits)
    on = (filled[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
    n = len(code) - order + 1
    start = np.flatnonzero((on[:n] & on[1 : n + 1]).astype(bool) & (of[:n] == of[order - 1 :])) if n > 0 else np.zeros(0, np.int64)
    # number the phrases exactly, word by word
    at = lang_of[of[start]]
    for j in range(order):
        _, at = np.unique(at * max(1, len(vocabulary)) + code[start + j], return_inverse=True)
    _, first = np.unique(at, return_index=True)
    f = np.bincount(at, weight[of[start]], len(first)).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    one = start[first]
    columns = [vocabulary.take(pa.array(code[one + j])).cast(pa.string()) for j in range(order)]
    return pa.RecordBatch.from_arrays([lang_names.take(pa.array(lang_of[of[one]])), pc.binary_join_element_wise(*columns, " "), pa.array(f)], ["lang", "phrase", "f"])


def phrase_counts(distinct: DataFrame, order: int, least: int, filled=None, step: int = STEP, bits: int = BITS) -> DataFrame:
    """(lang, phrase, f, bit): phrases of ``order`` words that occur ``least`` times; with order 1 also '' for all words."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(filled.value, np.uint8) if filled is not None else None
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= step:
                yield _counted(pa.Table.from_batches(held), order, bitmap, bits)
                held, size = [], 0
        if held:
            yield _counted(pa.Table.from_batches(held), order, bitmap, bits)

    def sum_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
        # only what goes beyond the memory, and only while this bucket is summed
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"memory_limit": BUCKET_MEMORY, "threads": "1", "temp_directory": spill, "preserve_insertion_order": "false"}) as con:
            rows = pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches))
            con.register("counted", rows)
            out = con.sql(f"SELECT lang, phrase, CAST(sum(f) AS BIGINT) AS f FROM counted GROUP BY lang, phrase HAVING sum(f) >= {least} OR phrase = ''").to_arrow_reader(100_000)
            for batch in out:
                bit = np.where(pc.equal(batch.column("phrase"), "").to_numpy(zero_copy_only=False), -1, 0).astype(np.int64)
                real = np.flatnonzero(bit == 0)
                if len(real):
                    bit[real] = phrase_bits(batch.column("lang").take(pa.array(real)), batch.column("phrase").take(pa.array(real)), order, bits)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "phrase", "f")), pa.array(bit)], ["lang", "phrase", "f", "bit"])

    local = distinct.mapInArrow(gather, "lang string, phrase string, f long")
    return local.repartition("lang", "phrase").mapInArrow(sum_bucket, "lang string, phrase string, f long, bit long")


def filter_of(counts: DataFrame, bits: int = BITS):
    """A broadcast bitmap of the bits of ``counts``: at most ``bits`` / 8 bytes come to the driver."""
    rows = counts.filter("bit >= 0").groupBy((F.bitmap_bucket_number(F.col("bit") + 1)).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("x"))
    filled = np.zeros(bits // 8, np.uint8)
    for k, x in rows.toLocalIterator():
        filled[(k - 1) * len(x) : k * len(x)] = np.frombuffer(bytes(x), np.uint8)
    return counts.sparkSession.sparkContext.broadcast(filled.tobytes())


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most: int = 2000, step: int = STEP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``most`` phrases of each language."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    distinct = scratch.write(pieces(docs, text, lang), "pieces")
    counts = [scratch.write(phrase_counts(distinct, 1, least, None, step, bits), "phrases")]
    for order in range(2, ORDERS + 1):
        counts.append(scratch.write(phrase_counts(distinct, order, least, filter_of(counts[-1], bits), step, bits), "phrases"))
    scratch.drop(distinct)
    known = reduce(DataFrame.unionByName, counts).filter("phrase <> ''").select("lang", F.col("phrase").alias("part"), "f")
    totals = counts[0].filter("phrase = ''").select("lang", F.col("f").alias("n"))
    candidates = reduce(DataFrame.unionByName, counts[1:]).select("lang", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.array_join(x, " ").alias("part")) for s, x in (("l", F.slice("w", F.lit(1), F.col("k"))), ("r", F.slice("w", F.col("k") + 1, F.size("w"))))])
    requests = cuts.select("lang", "phrase", "a", F.size("w").alias("size"), "k", F.explode(sides).alias("x")).select("lang", "phrase", "a", "size", "k", "x.*")
    replies = scratch.write(requests.join(known, ["lang", "part"]), "replies")
    # one word less and as frequent: its candidate goes
    covered = replies.filter((F.col("f") == F.col("a")) & (F.col("size") > 2) & (((F.col("side") == "l") & (F.col("k") == F.col("size") - 1)) | ((F.col("side") == "r") & (F.col("k") == 1))))
    covered = covered.select("lang", F.col("part").alias("phrase")).distinct()
    both = replies.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    if totals.count() <= BROADCAST_LANGS:
        totals = F.broadcast(totals)
    exact = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    both = both.join(totals, "lang").withColumn("score", F.expr(f"(1000 * {exact('a')} * {exact('n')}) DIV ({exact('l')} * {exact('r')})"))
    cut = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("x")).select("lang", "phrase", "x.*")
    left = cut.join(covered, ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(DEAL))).orderBy(*order)
    first = left.withColumn("rank", F.row_number().over(dealt)).filter(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_bucketed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def plain_sql(least: int = LEAST, most: int = 2000) -> str:
    """The contract read plainly: every phrase of every piece, as text."""
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p) y WHERE len(w) > 0),
g AS (SELECT lang, o, unnest(list_transform(range(1, len(w) - o + 2), lambda s: array_to_string(w[s:s + o - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS o) z WHERE len(w) >= o),
f AS (SELECT lang, o, phrase, count(*) AS f FROM g GROUP BY lang, o, phrase),
total AS (SELECT lang, sum(f) AS n FROM f WHERE o = 1 GROUP BY lang),
c AS (SELECT lang, o, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE o > 1 AND f >= {least}),
parts AS (SELECT lang, o, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:o], ' ') AS y FROM (SELECT *, unnest(range(1, o)) AS k FROM c) v),
scored AS (SELECT q.lang, q.phrase, q.a, l.f AS l, r.f AS r, t.n, q.k, (1000::HUGEINT * q.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM parts q JOIN f l ON l.lang = q.lang AND l.phrase = q.x JOIN f r ON r.lang = q.lang AND r.phrase = q.y JOIN total t ON t.lang = q.lang),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM scored) v WHERE i = 1),
inner_ AS (SELECT DISTINCT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, o - m + 2)) AS s FROM (SELECT *, unnest(range(2, o)) AS m FROM c) v) u),
kept AS (SELECT x.* FROM cut x LEFT JOIN (SELECT i.lang, i.phrase, max(i.a) AS most FROM inner_ i GROUP BY i.lang, i.phrase) b ON b.lang = x.lang AND b.phrase = x.phrase WHERE b.most IS NULL OR 100 * b.most < 100 * x.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {most}"""


OP13_SQL = plain_sql()
