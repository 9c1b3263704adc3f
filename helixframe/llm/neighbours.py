"""Nearest neighbours by randomly rotated one-bit codes, in coarse cells.

Rows are assigned to the nearest of at most ``CELLS`` centres, found by k-means on at most
``SAMPLE`` rows. In a cell a vector's offset from the centre is scaled to unit length and
turned by a random rotation; its code keeps the signs, packed to bits, and two scalars: the
length r and f = <code, unit vector>. For a query, <code, q> / f estimates the inner
product, and sqrt((1 - f^2) / f^2) * EPSILON / sqrt(dims - 1) bounds its error with high
probability. Only vectors whose lower distance bound is within the query's bound are ranked
by their true distance, in double precision on the original vectors. That bound is the
least of two: the k-th smallest upper bound in the part of the cell, and the query's k-th
distance in the sample, which holds for all parts at once.

Each row is shuffled once, to its cell; a cell of more than ``PART`` rows is dealt over
several parts, so a cell that holds a third of all rows (one vector and its copies, say) is
no single task. A query goes to the cells nearest to it only. How many is measured: the
least number for which sampled queries find ``RECALL`` of their neighbours within the
sample, so it is few where vectors cluster and most cells where they don't. The cells
whose queries are more than ``QUERIES`` repeat their rows for every so many queries. A part
gives a query at most k rows, and a second stage keeps the k best of those.

Vectors that are null or zero or hold null or non-finite components take no part, nor do
those whose dimension is not the most frequent one (ties: the smaller). Repeated query ids
are searched once, with the first of their vectors in array order. A query never finds its
own id; rows that repeat an id are candidates each. Fewer candidates than k in the cells
that a query goes to: the cells taken for it then hold at least k other rows, or are all.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import settle, table

EPSILON, CELLS, SAMPLE, PART, QUERIES, RECALL = 3.0, 1024, 20_000, 16_384, 16_384, 0.99
#: Sampled rows of a cell at least, and queries by which the number of cells to search is measured.
ROWS_PER_CENTRE, MEASURED = 40, 400


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, not below 0."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def centres(sample: np.ndarray, most: int = CELLS, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means of the distinct rows of the sample; as many centres as the square root of the rows, or fewer."""
    rows = np.unique(sample, axis=0)
    n = max(1, min(most, int(np.sqrt(len(rows))), len(rows) // ROWS_PER_CENTRE))
    made = rows[np.random.default_rng(seed).choice(len(rows), n, replace=False)]
    for _ in range(rounds):
        own = squares(rows, made).argmin(axis=1)
        size = np.bincount(own, minlength=n)
        total = np.zeros_like(made)
        np.add.at(total, own, rows)
        made = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], made)
    return made


class Codes:
    """One-bit codes of vectors: packed bits, lengths from the centre, and <code, unit vector>."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        rest = vectors.astype(np.float64) - centre
        self.length = np.sqrt((rest * rest).sum(axis=1))
        unit = rest / np.where(self.length > 0, self.length, 1.0)[:, None]
        turned = unit @ turn.T
        self.dims = vectors.shape[1]
        self.bits = np.packbits(turned > 0, axis=1)
        self.f = np.abs(turned).sum(axis=1) / np.sqrt(self.dims)

    def inner(self, turned: np.ndarray) -> np.ndarray:
        """<code, query> for turned queries, from the packed bits: a table of 256 sums for every byte of a code."""
        pad = np.zeros((len(turned), self.bits.shape[1] * 8))
        pad[:, : self.dims] = turned
        signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
        out = np.zeros((len(turned), len(self.bits)))
        for k in range(self.bits.shape[1]):
            sums = pad[:, 8 * k : 8 * k + 8] @ signs.T
            out += sums[:, self.bits[:, k]]
        return out / np.sqrt(self.dims)

    def bounds(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of squared distances, one row per query."""
        rest = queries.astype(np.float64) - centre
        far = np.sqrt((rest * rest).sum(axis=1))
        turned = (rest / np.where(far > 0, far, 1.0)[:, None]) @ turn.T
        f = np.where(self.f > 0, self.f, 1.0)
        inner = self.inner(turned) / f
        error = np.sqrt(np.maximum(1 - f * f, 0) / (f * f)) * epsilon / np.sqrt(max(1, self.dims - 1)) + 1e-5
        square = self.length**2 + (far**2)[:, None]
        scale = 2 * self.length * far[:, None]
        return square - scale * np.minimum(inner + error, 1), square - scale * np.maximum(inner - error, -1)


def nearest(ids: np.ndarray, vectors: np.ndarray, codes: Codes, query_ids: np.ndarray, queries: np.ndarray, limit: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, and ids and distances of its at most ``k`` nearest in these vectors.

    ``limit``: a squared distance for each query within which k rows lie somewhere.
    """
    low, high = codes.bounds(queries, centre, turn)
    for j, q in enumerate(queries.astype(np.float64)):
        other = ids != query_ids[j]
        n = int(other.sum())
        if not n:
            continue
        kth = np.partition(high[j][other], min(k, n) - 1)[min(k, n) - 1] if n >= k else np.inf
        pick = np.flatnonzero(other & (low[j] <= min(kth, limit[j])))
        if not len(pick):
            continue
        rest = vectors[pick] - q
        distance = np.sqrt((rest * rest).sum(axis=1))
        best = np.lexsort((ids[pick], distance))[:k]
        yield j, ids[pick[best]], distance[best]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part; vectors as doubles."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), x.alias("vector"), fine.alias("fine")).filter("vec_id is not null and vector is not null and fine").drop("fine")
    sizes = sorted(map(tuple, rows.groupBy(F.size("vector")).count().collect()), key=lambda r: (-r[1], r[0]))
    return rows.filter(F.size("vector") == (sizes[0][0] if sizes else 0))


class Cells:
    """Centres, the sample, and how many of the nearest cells a query is sent to."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, k: int, most: int = CELLS, recall: float = RECALL):
        self.ids, self.sample, self.k = ids, sample, k
        self.centres = centres(sample, most)
        self.turn = rotation(sample.shape[1])
        self.probes = self._measure(recall)

    def own(self, vectors: np.ndarray) -> np.ndarray:
        return squares(vectors, self.centres).argmin(axis=1)

    def _measure(self, recall: float) -> int:
        """The least number of cells for which the first sampled queries find enough of their neighbours in the sample."""
        cell, n = self.own(self.sample), min(MEASURED, len(self.sample))
        square = squares(self.sample[:n], self.sample)
        square[self.ids[:n, None] == self.ids[None, :]] = np.inf
        k = min(self.k, len(self.sample) - 1)
        if k < 1:
            return len(self.centres)
        near = np.argpartition(square, k - 1, axis=1)[:, :k]
        order = squares(self.sample[:n], self.centres).argsort(axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(n, 0), axis=1)
        needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel()) + 1
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])

    def limits(self, query_ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The k-th squared distance from each query in the sample, its own id left out; infinite if there are fewer."""
        square = squares(queries, self.sample)
        square[query_ids[:, None] == self.ids[None, :]] = np.inf
        if square.shape[1] < self.k:
            return np.full(len(queries), np.inf)
        return np.partition(square, self.k - 1, axis=1)[:, self.k - 1] * (1 + 1e-9) + 1e-9


def search(df: DataFrame, is_query: F.Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", cells: int = CELLS, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest rows of ``df`` for each of its rows where ``is_query`` (over vec_id) holds."""
    spark = df.sparkSession
    kind = "query_id long, vec_id long, score double"
    rows = usable(df, key, vector)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Cells(sample["vec_id"].to_numpy(), np.stack(sample["vector"].to_numpy()).astype(np.float64), k, cells, recall)
    dims = index.sample.shape[1]
    shared = spark.sparkContext.broadcast(index)

    def matrix(batch: pa.RecordBatch, name: str = "vector") -> np.ndarray:
        return batch.column(name).flatten().to_numpy().reshape(-1, dims)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.own(matrix(batch)).astype(np.int32)), batch.column("vec_id"), batch.column("vector")], names=["cell", "vec_id", "vector"])

    placed = rows.select("vec_id", "vector").mapInArrow(assign, "cell int, vec_id long, vector array<double>")
    held = {c: n for c, n in placed.groupBy("cell").count().collect()}  # at most ``cells`` rows
    sizes = np.array([held.get(c, 0) for c in range(len(index.centres))], np.int64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids, q = part.column("vec_id").to_numpy(), matrix(part)
                order = squares(q, shared.value.centres).argsort(axis=1, kind="stable")
                reach = np.cumsum(sizes[order], axis=1)
                need = np.maximum((reach < k + 1).sum(axis=1) + 1, shared.value.probes)  # cells that hold k others
                row, at = np.nonzero(np.arange(order.shape[1])[None, :] < need[:, None])
                limit = shared.value.limits(ids, q)
                yield pa.RecordBatch.from_arrays([pa.array(order[row, at].astype(np.int32)), pa.array(ids[row]), part.column("vector").take(pa.array(row)), pa.array(limit[row])], names=["cell", "vec_id", "vector", "bound"])

    chosen = rows.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = settle(spark, chosen.mapInArrow(probe, "cell int, vec_id long, vector array<double>, bound double"), "asked")
    wanted = {c: n for c, n in asked.groupBy("cell").count().collect()}
    grid = [(c, max(1, -(-n // PART)), max(1, -(-wanted[c] // QUERIES))) for c, n in held.items() if c in wanted]
    parts = F.broadcast(spark.createDataFrame(grid, "cell int, row_parts int, query_parts int"))  # at most ``cells`` rows
    # a cell's rows are dealt to its row parts and repeated for its query parts, its queries the other way round
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    there = placed.join(parts, "cell").select("cell", deal("row_parts", F.monotonically_increasing_id()).alias("a"), every("query_parts").alias("b"), F.lit(0).alias("asks"), "vec_id", "vector", F.lit(0.0).alias("bound"))
    here = asked.join(parts, "cell").select("cell", every("row_parts").alias("a"), deal("query_parts", F.col("vec_id"), F.lit("query")).alias("b"), F.lit(1).alias("asks"), "vec_id", "vector", "bound")
    both = there.unionByName(here).repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b", "asks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts arrive one after another, each as at most about ``PART`` rows, then its queries."""
        index, now, ids, vectors, codes = shared.value, None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "a", "b", "asks")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                run = batch.slice(s, e - s)
                if tuple(keys[:3, s]) != now:
                    now, ids, vectors, codes = tuple(keys[:3, s]), [], [], None
                if not keys[3, s]:
                    ids.append(run.column("vec_id").to_numpy())
                    vectors.append(matrix(run))
                    continue
                if not ids:
                    continue
                centre = index.centres[now[0]]
                if codes is None:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    codes = Codes(vectors[0], centre, index.turn)
                for x in range(0, run.num_rows, 128):
                    some = run.slice(x, 128)
                    query_ids = some.column("vec_id").to_numpy()
                    found = list(nearest(ids[0], vectors[0], codes, query_ids, matrix(some), some.column("bound").to_numpy(), centre, index.turn, k))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.concatenate([np.full(len(i), query_ids[j]) for j, i, _ in found])),
                                pa.array(np.concatenate([i for _, i, _ in found])),
                                pa.array(np.concatenate([d for _, _, d in found])),
                            ],
                            names=["query_id", "vec_id", "score"],
                        )

    near = both.mapInArrow(compare, kind)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
