"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Words are lower-cased in A-Z and split at everything that is no letter, digit or sign beyond
ASCII. Of each ``WINDOW`` consecutive words the least hash among its ``K``-grams is kept (the
rightmost of equal ones): the fingerprint of the window. Which one is kept depends on the
window alone, so two texts that share a window share its fingerprint, at the same place in
it: a join of fingerprints finds every shared span of ``WINDOW`` words or more. Each hit is
then extended: the window around it must agree in its first and last ``K`` words, which
together are all of it, compared by two 64-bit hashes of words.

An item shorter than a window is one window of its own: its first ``min(n, K)`` words are
its fingerprint and every gram of that many words is kept in the documents, which is
winnowing with a sliding window of one gram; the rest of it is compared in the same way.

Everything but the join is inside the row. The distinct windows of the items are broadcast
where they are at most ``BROADCAST_WINDOWS`` (40 bytes each) and shuffled by fingerprint
beyond that. Hits are gathered per text, so copies of a text are one group of the same few
hits: sets of places in the text and of windows, both bounded by the text's length.

Null texts have no words, are hit nowhere and are kept; so are empty ones. Repeated rows give
equal rows. An item with a null or empty text hits nothing; one with a null id hits words and
counts as an item whose id is written as ''. Equal ids count once. Empty tables give no rows,
or rows without hits. Columns beside id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Words of a window, words of a gram, and grams of a window.
WINDOW, K = 10, 5
GRAMS = WINDOW - K + 1
#: Distinct windows of all items that are broadcast at most.
BROADCAST_WINDOWS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What words are made of, before upper case is lowered.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null for null. Only A-Z are lower-cased."""
    ascii = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _grams(of: str, k: int) -> Column:
    """Hashes of the ``k`` words from each place on; places where fewer are left have null."""
    at = lambda i: F.xxhash64(F.lit(k), *[F.get(F.col(of), i + j) for j in range(k)])
    return F.transform(F.col(of), lambda _, i: F.when(i <= F.size(of) - k, at(i)))


def _least(of: str) -> Column:
    """The least gram of the window at each place; null where a whole window is not left."""
    here = lambda i: [F.get(F.col(of), i + j) for j in range(GRAMS)]
    return F.transform(F.col(of), lambda _, i: F.when(i <= F.size(of) - WINDOW, F.least(*here(i))))


def _kept(of: str, least: str) -> Column:
    """Places of the grams that winnowing keeps: of each window's least ones the rightmost."""

    def place(m: Column, i: Column) -> Column:
        found = i
        for j in range(1, GRAMS):  # the last that is equal to the least wins
            found = F.when(F.get(F.col(of), i + j) == m, i + j).otherwise(found)
        return F.when(m.isNotNull(), found)

    return F.filter(F.array_distinct(F.transform(F.col(least), place)), lambda p: p.isNotNull())


def item_windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """(id, n, k, f, off, a, b): each item's windows: words, fingerprint with its words and place, hashes of the first and last words."""
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), words(F.col(text)).alias("w")).filter("size(w) > 0")
    long = rows.filter(F.size("w") >= WINDOW).select("id", "w").withColumn("h", _grams("w", K))
    starts = F.sequence(F.lit(0), F.size("w") - WINDOW)

    def window(s: Column) -> Column:
        here = [F.get(F.col("h"), s + j) for j in range(GRAMS)]
        off = F.lit(0)
        for j in range(1, GRAMS):
            off = F.when(here[j] == F.least(*here), F.lit(j)).otherwise(off)
        return F.struct(F.lit(WINDOW).alias("n"), F.lit(K).alias("k"), F.least(*here).alias("f"), off.alias("off"), here[0].alias("a"), here[-1].alias("b"))

    out = long.select("id", F.explode(F.transform(starts, window)).alias("x")).select("id", "x.*")
    for n in range(1, WINDOW):
        k = min(n, K)
        gram = lambda s: F.xxhash64(F.lit(k), *[F.get("w", F.lit(s + j)) for j in range(k)])  # noqa: B023, E731
        short = rows.filter(F.size("w") == n).select("id", F.lit(n).alias("n"), F.lit(k).alias("k"), gram(0).alias("f"), F.lit(0).alias("off"), gram(0).alias("a"), gram(n - k).alias("b"))
        out = out.unionByName(short)
    return out.distinct()


def fingerprints(docs: DataFrame, text: str, lengths: list[tuple[int, int]]) -> DataFrame:
    """(t1, t2, k, f, p, near): fingerprints of each text, their places, and the grams from ``GRAMS`` - 1 places before to as many after.

    ``lengths``: the (words, gram) of the items' windows; full windows are winnowed, and of
    shorter ones every gram is kept.
    """
    rows = docs.filter(F.col(text).isNotNull()).select(*text_key(text), words(F.col(text)).alias("w"))
    sizes = sorted({k for n, k in lengths if n < WINDOW} | ({K} if any(n >= K for n, _ in lengths) else set()))
    rows = rows.select("t1", "t2", *[_grams("w", k).alias(f"h{k}") for k in sizes])
    reach = GRAMS - 1
    before, after = F.array_repeat(F.lit(None).cast("long"), reach), F.array_repeat(F.lit(None).cast("long"), reach)
    rows = rows.select("t1", "t2", *[f"h{k}" for k in sizes], *[F.concat(before, F.col(f"h{k}"), after).alias(f"r{k}") for k in sizes])

    def near(k: int, p: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), F.get(F.col(f"h{k}"), p).alias("f"), p.alias("p"), F.slice(F.col(f"r{k}"), p + 1, F.lit(2 * reach + 1)).alias("near"))

    made = []
    if any(n == WINDOW for n, _ in lengths):
        made.append((K, "kept", rows.withColumn("least", _least(f"h{K}")).withColumn("kept", _kept(f"h{K}", "least"))))
    for k in sorted({k for n, k in lengths if n < WINDOW}):
        every = F.filter(F.transform(F.col(f"h{k}"), lambda h, i: F.when(h.isNotNull(), i)), lambda p: p.isNotNull())
        made.append((k, "every", rows.withColumn("every", every)))
    out = None
    for k, places, df in made:
        part = df.select("t1", "t2", F.explode(F.transform(F.col(places), lambda p: near(k, p))).alias("x")).select("t1", "t2", "x.*")  # noqa: B023
        part = part.withColumn("whole", F.lit(places == "kept"))
        out = part if out is None else out.unionByName(part)
    return out


def text_key(text: str) -> list[Column]:
    """A 128-bit key of a text: what is found in it depends on nothing else."""
    return [F.xxhash64(F.col(text)).alias("t1"), F.xxhash64(F.lit(17), F.col(text), F.octet_length(text)).alias("t2")]


def _covered(spans: Column) -> Column:
    """Words in the union of (start, n), sorted by start."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["start"] + s["n"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], s["start"])).alias("n"), end.alias("end"))

    return F.aggregate(spans, start, step)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key``, n_words, n_hit, n_items, items (their ids, sorted as strings), contaminated: one row per row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    of_items = scratch.write(item_windows(items, item, item_text), "item-windows")
    windows = of_items.select("n", "k", "f", "off", "a", "b").distinct()
    lengths = [(r.n, r.k) for r in of_items.select("n", "k").distinct().orderBy("n").collect()]  # ten at most
    rows = docs.select(F.col(key), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), *text_key(text))
    no_items = F.array().cast("array<string>")
    if not lengths:
        return rows.select(key, "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), no_items.alias("items"), F.lit(False).alias("contaminated"))
    if windows.count() <= BROADCAST_WINDOWS:
        windows = F.broadcast(windows)
    windows = windows.withColumn("whole", F.col("n") == WINDOW)
    reach = GRAMS - 1
    found = fingerprints(docs, text, lengths).join(windows, ["k", "f", "whole"])
    first, last = F.get("near", reach - F.col("off")), F.get("near", reach - F.col("off") + F.col("n") - F.col("k"))
    hits = found.filter((first == F.col("a")) & (last == F.col("b"))).select("t1", "t2", (F.col("p") - F.col("off")).alias("start"), "n", "k", "f", "off", "a", "b")
    window = ["n", "k", "f", "off", "a", "b"]
    per = hits.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.collect_set(F.struct(*window)).alias("windows"))
    per = scratch.write(per.select("t1", "t2", _covered(F.array_sort("spans")).cast("long").alias("n_hit"), "windows"), "hits")
    named = per.select("t1", "t2", F.explode("windows").alias("x")).select("t1", "t2", "x.*").join(of_items, window).groupBy("t1", "t2").agg(F.array_sort(F.collect_set("id")).alias("items"))
    told = per.select("t1", "t2", "n_hit").join(named, ["t1", "t2"])
    out = rows.join(told, ["t1", "t2"], "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", no_items)
    return out.select(key, "n_words", hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (hit > 0).alias("contaminated"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The contract read plainly: every window of words as text, looked up in every document.
OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: array_to_string(w[s:s + 9], ' '))) AS x FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda s: array_to_string(w[s:s + n - 1], ' '))) AS x FROM d JOIN sizes ON len(w) >= n),
hit AS (SELECT r, dw.n, s, id FROM dw JOIN iw ON iw.x = dw.x AND iw.n = dw.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) y GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM hit) z GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.r = d.r LEFT JOIN named m ON m.r = d.r"""
