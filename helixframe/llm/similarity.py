"""Similarity join of documents on word shingles by chosen paths.

A document is the set of its shingles: ``WORDS`` successive words (runs of letters, digits
and underscores, lowered), hashed to 64 bits; a shorter text is one shingle. Documents with
equal sets are one class member with a multiplicity. Each set is embedded as ``SKETCH``
minimum hashes, whose agreement estimates the Jaccard similarity of two sets.

In each of ``RUNS`` runs the join splits recursively: below a path every position of the
sketch is drawn with a probability of ``BRANCH`` / SKETCH by a hash of path and minimum, and
the member follows each drawn position to the bucket (path, position, minimum). Similar
sets share branches, others part at each level. Buckets of at most ``SMALL`` members, and
those at depth ``DEEP``, are compared by brute force, in blocks of ``BLOCK`` members.
Runs are repeated until a pair at the threshold is found with probability ``TARGET``
(``runs_for``); more similar pairs sooner.

Brute force first drops pairs whose sketches agree in less than ``LOOSE`` of all positions
(a pair at 0.8 falls below 0.5 with probability under 1e-7), then counts common shingles
exactly. A pair is counted in the first bucket that its members share and in no other, so
links are counted without a row per pair; each block reports a member's links and the least
member it is joined to, and classes are the connected components of those reports.

The result has one row per row of the table: its class (least doc_id among the members) and
its number of links, copies included. Texts without words link to nothing, not even each
other, and each is its own class. Rows without a doc_id are compared like any others; a class
of such rows alone has a null id. Repeated rows are copies. An empty table gives an empty
result; other columns are ignored.

Blocks are bounded in members and in shingles, so texts of any length fit a worker. Rows are
found again by a hash of id and text. Tables that no later step reads are deleted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, join_bytes, map_texts, mix64, settle, table

WORDS, SIMILARITY = 5, 0.8
SKETCH, BRANCH, DEEP, SMALL, BLOCK, TARGET, LOOSE = 64, 1.5, 4, 48, 1024, 0.995, 0.5
#: Shingles of a block at about this many.
BLOCK_SHINGLES = 1 << 21
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+")
_U = np.uint64
#: Punctuation outside ASCII that also ends a word (fixed values).
_APART = dict.fromkeys(map(ord, " ¡«·»¿–—‘’“”„…　、。"), " ")


def runs_for(similarity: float, target: float, branch: float = BRANCH, deep: int = DEEP) -> int:
    """Runs after which a pair has met in a bucket of depth ``deep`` with probability ``target``.

    Common branches of a pair are binomial with mean branch * similarity at each level, so
    the chance that none is left follows the generating function of a branching process.
    """
    none = 0.0
    for _ in range(deep):
        none = (1 - branch / SKETCH * (1 - none)) ** (SKETCH * similarity)
    return max(1, math.ceil(math.log(1 - target) / math.log(none)))


RUNS = runs_for(SIMILARITY, TARGET)


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The set of each text: sorted distinct 64-bit hashes."""
    raw = [t.lower().translate(_APART).encode("utf-8", "surrogatepass") for t in texts]
    data, starts, lengths = join_bytes(raw, 1)
    if not len(data):
        return [np.zeros(0, _U)] * len(texts)
    letter = (data >= 0x80) | ((data >= 0x30) & (data <= 0x39)) | ((data >= 0x61) & (data <= 0x7A)) | (data == 0x5F)
    edge = np.diff(np.r_[False, letter, False].astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return [np.zeros(0, _U)] * len(texts)
    at = np.flatnonzero(letter)
    size = last - first
    begin = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(begin, size)
    power = np.cumprod(np.r_[_U(1), np.full(int(size.max()) - 1, _U(0x9E3779B97F4A7C15 | 1))].astype(_U))
    word = mix64(np.add.reduceat((data[at].astype(_U) + _U(1)) * power[place], begin) + size.astype(_U))
    bounds = np.searchsorted(first, np.r_[starts, starts[-1] + lengths[-1]])
    total = np.zeros(len(word), _U)
    for k in range(words):  # hash of the words from each position
        total[: len(word) - k] = total[: len(word) - k] * _U(0xD6E8FEB86659FD93) + word[k:]
    total = mix64(total)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(total[a : b - words + 1]))
        elif b > a:
            h = _U(b - a)
            for w in word[a:b]:
                h = mix64(np.array([h], _U) * _U(0xD6E8FEB86659FD93) + w)[0]
            out.append(np.array([h], _U))
        else:
            out.append(np.zeros(0, _U))
    return out


_SALTS = mix64(np.arange(1, SKETCH + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def sketch(found: np.ndarray) -> np.ndarray:
    """``SKETCH`` 32-bit minima by true hash functions, the same for sets of every size; in strips."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max, _U)
    for a in range(0, len(found), 512):
        x = _SALTS[:, None] ^ found[None, a : a + 512]
        y = x >> _U(30)  # mix64 in place
        x ^= y
        x *= _U(0xBF58476D1CE4E5B9)
        np.right_shift(x, _U(27), out=y)
        x ^= y
        x *= _U(0x94D049BB133111EB)
        np.right_shift(x, _U(31), out=y)
        x ^= y
        np.minimum(out, x.min(axis=1), out=out)
    return (out >> _U(32)).astype(np.uint32)


def children(paths: np.ndarray, minima: np.ndarray, branch: float = BRANCH) -> tuple[np.ndarray, np.ndarray]:
    """Number of the row and path of each child; ``minima``: the sketch of each row."""
    node = mix64((paths[:, None] ^ _SALTS[None, :]) * _U(0x9FB21C651E98DF25) + minima.astype(_U))
    row, at = np.nonzero(node < _U(int(branch / SKETCH * 2.0**64)))
    return row, mix64(node[row, at] ^ _U(0x1234567887654321))


def _number(found: np.ndarray) -> int | None:
    """64 bits that stand for the set; None for the empty one."""
    return int((mix64(found).sum(dtype=_U) ^ mix64(np.array([len(found)], _U))[0]).astype(np.int64)) if len(found) else None


def locator() -> F.Column:
    """What finds a row again in another reading of the table."""
    return F.xxhash64("doc_id", "text")


def members(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, locator, number of the set (null without words), its shingles, its sketch."""

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        sets = shingles(texts)
        return {"member": [_number(s) for s in sets], "shingles": [len(s) for s in sets], "minima": [sketch(s).tobytes() if len(s) else None for s in sets]}

    rows = docs.select("doc_id", "text", locator().alias("locator"))
    return map_texts(rows, work, f"doc_id {dict(docs.dtypes)['doc_id']}, locator long, member long, shingles long, minima binary")


def _first_paths(rows: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(n, SKETCH)
                member = batch.column("member").to_numpy()
                for run in range(RUNS):
                    row, path = children(np.full(n, mix64(np.array([run + 1], _U))[0]), minima)
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(member[row])], names=["path", "member"])

    return rows.select("member", "minima").mapInArrow(work, "path long, member long")


def _next_paths(rows: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(n, SKETCH)
                row, path = children(batch.column("path").to_numpy().view(_U), minima)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(batch.column("member").to_numpy()[row])], names=["path", "member"])

    return rows.select("path", "member", "minima").mapInArrow(work, "path long, member long")


def buckets(kept: Scratch, rows: DataFrame) -> list[DataFrame]:
    """(path, member, size) of the buckets to compare, a table a depth; ``rows``: member, minima, one row per member."""
    out, level = [], _first_paths(rows)
    for depth in range(1, DEEP + 1):
        level = kept.write(level.distinct(), f"level{depth}")
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        found = level.join(sizes, "path")
        out.append(kept.write(found if depth == DEEP else found.filter(F.col("size") <= SMALL), "small"))
        if depth < DEEP:
            found = found.filter(F.col("size") > SMALL).drop("size")
            if found.isEmpty():
                kept.drop(level)
                break
            deeper = kept.write(_next_paths(found.join(rows, "member")), "deeper")
            kept.drop(level)
            level = deeper
    return out


def _blocks(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """Each row once for every pair of blocks of its bucket that it belongs to."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    if weight:
        n = F.greatest(n, F.least(F.ceil(F.col(weight) / BLOCK_SHINGLES).cast("int"), F.col("size").cast("int")))
    mine = F.pmod(F.xxhash64("member"), F.col("_n")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda k: F.struct(F.least(k, F.col("_mine")).alias("a"), F.greatest(k, F.col("_mine")).alias("b")),
    )
    return rows.withColumn("_n", n).withColumn("_mine", mine).withColumn("_pair", F.explode(pairs)).select("*", "_pair.a", "_pair.b").drop("_pair", "_n")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows equal in ``keys``; the rows arrive sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(k[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b")


def alive(rows: DataFrame) -> DataFrame:
    """(path, member, shingles) of the members whose sketch agrees loosely with another's in the bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["path", "a", "b"]):
            n = g.num_rows
            minima = np.frombuffer(b"".join(g.column("minima").to_pylist()), np.uint32).reshape(n, SKETCH)
            mine, a, b = g.column("_mine").to_numpy(), g.column("a")[0].as_py(), g.column("b")[0].as_py()
            left, right = np.flatnonzero(mine == a), np.flatnonzero(mine == b)
            hit = np.zeros(n, bool)
            for s in range(0, len(left), 64):
                i = left[s : s + 64]
                same = np.zeros((len(i), len(right)), np.int16)
                for k in range(SKETCH):
                    same += minima[i, k][:, None] == minima[right, k][None, :]
                ok = (same >= LOOSE * SKETCH) & (i[:, None] != right[None, :])
                hit[i] |= ok.any(axis=1)
                hit[right] |= ok.any(axis=0)
            if hit.any():
                yield g.select(["path", "member", "shingles"]).filter(pa.array(hit)).combine_chunks().to_batches()[0]

    return _sorted(_blocks(rows).select("path", "a", "b", "_mine", "member", "shingles", "minima")).mapInArrow(work, "path long, member long, shingles long")


def compare(sets: list[np.ndarray], similarity: float = SIMILARITY) -> Iterator[tuple[int, np.ndarray]]:
    """For strips of rows: the number of the first row, and which pairs reach the similarity."""
    size = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    known, inverse, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times > 1  # others are in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    row, inverse = row[keep], number[inverse[keep]]
    common_to_all = np.bincount(inverse, minlength=max(1, int(shared.sum()))) == len(sets)
    always = int(common_to_all.sum())
    keep = ~common_to_all[inverse]
    row, inverse = row[keep], inverse[keep]
    width = np.unique(inverse)
    inverse = np.searchsorted(width, inverse)
    strip = 4096  # columns of one dense step
    order = np.argsort(inverse, kind="stable")
    row, inverse = row[order], inverse[order]
    common = np.full((len(sets), len(sets)), always, np.float32)
    for a in range(0, len(width), strip):
        lo, hi = np.searchsorted(inverse, [a, a + strip])
        dense = np.zeros((len(sets), min(strip, len(width) - a)), np.float32)
        dense[row[lo:hi], inverse[lo:hi] - a] = 1
        common += dense @ dense.T
    union = size[:, None] + size[None, :] - common
    ok = common >= similarity * union - 1e-6
    np.fill_diagonal(ok, False)
    yield 0, ok


def links(rows: DataFrame) -> DataFrame:
    """(member, root, texts, copies): links of a member counted in a block, and the least member it is joined to.

    ``rows``: path, size, weight (shingles of the bucket), member, its multiplicity, its set,
    and the sorted paths it is alive in.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["path", "a", "b"]):
            n = g.num_rows
            if n < 2:
                continue
            sets = [np.frombuffer(x, _U) for x in g.column("tokens").to_pylist()]
            (_, ok), = compare(sets)
            mine, a, b = g.column("_mine").to_numpy(), g.column("a")[0].as_py(), g.column("b")[0].as_py()
            if a != b:
                ok &= mine[:, None] != mine[None, :]
            if not ok.any():
                continue
            path = g.column("path")[0].as_py()
            earlier = [np.array([p for p in x if p < path], np.int64) for x in g.column("paths").to_pylist()]
            own = ok.copy()
            if any(map(len, earlier)):
                seen, at = np.unique(np.concatenate(earlier), return_inverse=True)
                of = np.repeat(np.arange(n), [len(x) for x in earlier])
                met = np.zeros((n, n), np.float32)
                for s in range(0, len(seen), 4096):
                    dense = np.zeros((n, min(4096, len(seen) - s)), np.float32)
                    pick = (at >= s) & (at < s + 4096)
                    dense[of[pick], at[pick] - s] = 1
                    met += dense @ dense.T
                own &= met == 0
            member, copies = g.column("member").to_numpy(), g.column("copies").to_numpy()
            root = member.copy()
            while True:  # least member of each component of the block
                lower = np.minimum(root, np.where(ok, root[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (lower == root).all():
                    break
                root = lower
            hit = ok.any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(member[hit]), pa.array(root[hit]), pa.array(own.sum(axis=1).astype(np.int64)[hit]), pa.array((own * copies[None, :]).sum(axis=1).astype(np.int64)[hit])],
                names=["member", "root", "texts", "copies"],
            )

    columns = ["path", "a", "b", "_mine", "member", "copies", "tokens", "paths"]
    return _sorted(_blocks(rows, "weight").select(*columns)).mapInArrow(work, "member long, root long, texts long, copies long")


def components(kept: Scratch, edges: DataFrame) -> DataFrame:
    """(member, label): the least member of each connected component of ``edges`` (member, root).

    Alternates large and small stars; each round is written, and the rounds end when the
    edges no longer change. Rounds grow with the logarithm of the longest chain.
    """
    pairs = edges.filter("member <> root").select(F.greatest("member", "root").alias("u"), F.least("member", "root").alias("v")).distinct()
    pairs = kept.write(pairs, "edges")
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(pairs)
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        last, pairs = pairs, kept.write(small, "edges")
        kept.drop(last)
        now = mark(pairs)
        if now == before:
            return pairs.select(F.col("u").alias("member"), F.col("v").alias("label"))
        before = now


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, locator, member, label, class_id, n_links, n_texts) for every row of ``docs`` (doc_id, text)."""
    kept = Scratch(spark)
    rows = kept.write(members(docs), "members")
    sets = rows.filter("member is not null").groupBy("member").agg(F.first("minima").alias("minima"), F.max("shingles").alias("shingles"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min("locator").alias("locator"))
    sets = kept.write(sets, "sets")
    found = buckets(kept, sets.select("member", "minima"))
    live = kept.write(alive(reduce(DataFrame.unionByName, found).join(sets.select("member", "shingles", "minima"), "member")).distinct(), "alive")
    kept.drop(*found)
    # buckets with the same members say the same: the least path stands for them
    one = live.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.sum("shingles").alias("weight"), F.sum(F.xxhash64("member").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("member", F.lit(1)).cast("decimal(38,0)")).alias("t"))
    one = one.groupBy("size", "s", "t").agg(F.min(F.struct("path", "weight")).alias("x")).select("x.path", "size", "x.weight")
    every, live = live, kept.write(live.select("path", "member").join(one, "path"), "kept")
    kept.drop(every)
    paths = live.groupBy("member").agg(F.array_sort(F.collect_list("path")).alias("paths"))  # bounded by RUNS and BRANCH ** DEEP
    wanted = paths.join(sets.select("member", "locator"), "member").select("locator", "member")

    def tokens(batch: pa.RecordBatch, texts: list[str]) -> dict:
        sets = shingles(texts)
        return {"number": [_number(s) for s in sets], "tokens": [s.tobytes() for s in sets]}

    text = docs.select("text", locator().alias("locator")).join(wanted, "locator")
    text = map_texts(text, tokens, "member long, number long, tokens binary").filter("number = member")
    text = text.groupBy("member").agg(F.first("tokens").alias("tokens"))
    full = live.join(text, "member").join(sets.select("member", "copies"), "member").join(paths, "member")
    reports = kept.write(links(full), "links")
    kept.drop(live)
    label = components(kept, reports.select("member", "root"))
    counted = reports.groupBy("member").agg(F.sum("texts").alias("texts"), F.sum("copies").alias("linked"))
    named = sets.select("member", "copies", "least").join(label, "member", "left").withColumn("label", F.coalesce("label", "member"))
    ids = named.groupBy("label").agg(F.min("least").alias("class_id"))
    named = named.join(ids, "label").join(counted, "member", "left")
    per = named.select(
        "member",
        "label",
        "class_id",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_texts"),
    )
    out = rows.select("doc_id", "locator", "member").join(per, "member", "left")
    own = F.when(F.col("member").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", "locator", "member", "label", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))


def join_similar(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return classes(spark, docs).select("doc_id", "class_id", "n_links", "n_texts")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row with the least doc_id of each class, with all its columns; rows without words all stay."""
    found = classes(spark, docs)
    of_class = found.filter("member is not null and doc_id <=> class_id").groupBy("label").agg(F.min(F.struct("member", "locator")).alias("x"))
    stays = of_class.select("x.locator", F.lit(True).alias("one")).unionByName(found.filter("member is null").select("locator", F.lit(False).alias("one")).distinct())
    at, one, alone = fresh(docs.columns, "locator", "one", "alone")
    stays = settle(spark, stays, "stays").select(F.col("locator").alias(at), F.col("one").alias(one))
    out = docs.withColumn(at, locator()).join(stays, at)
    # rows without words are no copies of each other
    out = out.withColumn(alone, F.when(~F.col(one), F.monotonically_increasing_id()))
    return out.dropDuplicates([at, alone]).select(*docs.columns)


def op5_chosen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(spark, table(spark, sf_dir, "documents"))
