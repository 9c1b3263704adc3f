"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels. At each node every child makes a hash draw
u in (0, 1) from (key, child) and the child with the smallest -ln(u) / weight is taken, so
a child gets rows in proportion to its weight, and a change of one weight moves rows only
between that child and its siblings: movement stays in the subtrees whose weights change.

``grow`` adds a shard as a region of its own. No existing node's weight changes, so one
more shard takes rows only into itself, and no row moves between older shards.

Null keys hash like any other value (all of them go to one shard); repeated rows are kept
and get slots of their own; an empty table gives an empty result. Everything is a Spark
expression over the row; slots need one shuffle of counted (key, size, checksum) rows, and
a second one of those that stand for more than ``RUN`` equal rows, in runs of that many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import fresh, settle, table

#: Distinct rows that one sub-bucket of a shard holds at about this many; its rows are numbered in one task.
BUCKET_ROWS = 250_000
#: Copies of one row that are written out together.
RUN = 4096


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def topology(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4) -> list[Leaf]:
    """A regular tree over ``shards`` leaves of weight 1."""
    return [Leaf(s, s // (racks_per_region * shards_per_rack), s // shards_per_rack) for s in range(shards)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region and a rack of its own."""
    top = lambda f: 1 + max((getattr(x, f) for x in tree), default=-1)
    return [*tree, Leaf(top("shard"), top("region"), top("rack"), weight)]


def _children(tree: list[Leaf]) -> dict[str, dict[str, float]]:
    """Weight of each child under each inner node; a node's weight is the sum of its leaves'."""
    out: dict[str, dict[str, float]] = {}
    for x in tree:
        names = ["", f"region {x.region}", f"rack {x.rack}", f"shard {x.shard}"]
        for parent, child in zip(names, names[1:]):
            level = out.setdefault(parent, {})
            level[child] = level.get(child, 0.0) + x.weight
    return out


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a row by its key: three weighted hash draws, one per level."""
    children = _children(tree)
    entries = []
    for parent, level in children.items():
        kids = [F.struct(F.lit(c).alias("child"), F.lit(w).alias("weight")) for c, w in sorted(level.items()) if w > 0]
        entries += [F.lit(parent), F.array(*kids)]
    nodes = F.create_map(*entries)

    def draw(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, c["child"]), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((-F.log(u) / c["weight"]).alias("clock"), c["child"].alias("child"))

    def descend(node: Column) -> Column:
        return F.array_min(F.transform(F.element_at(nodes, node), draw))["child"]

    leaf = descend(descend(descend(F.lit(""))))
    return F.substring(leaf, 7, 20).cast("int")


def with_slots(df: DataFrame, shard: str, order: list[str], rows: int) -> DataFrame:
    """Gapless numbers from 0 in each shard, by ``order``; rows equal in all columns are kept apart.

    Equal rows are first counted, so copies of one key are one row in the shuffle. The
    running sum is taken inside hashed sub-buckets of a shard, about one for ``BUCKET_ROWS``
    of the ``rows``, whose totals are then prefix-summed, so no task holds a whole shard.
    Copies come back from their counts in runs of ``RUN``; long runs are dealt out again
    before they are written out, so copies of one row are spread over the tasks.
    """
    columns = df.columns
    n, first, bucket, end, before, step = fresh(columns, "n", "first", "bucket", "end", "before", "step")
    buckets = max(1, -(-rows // BUCKET_ROWS))
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(n))
    counted = settle(df.sparkSession, counted.withColumn(bucket, F.pmod(F.xxhash64(*[F.col(c) for c in order], F.lit("slot")), F.lit(buckets))), "counted")
    within = Window.partitionBy(shard, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn(end, F.sum(n).over(within))
    totals = counted.groupBy(shard, bucket).agg(F.sum(n).alias(end))
    earlier = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(shard, bucket, F.coalesce(F.sum(end).over(earlier), F.lit(0)).alias(before))
    joined = ranked.join(offsets, [shard, bucket]).select(*columns, n, (F.col(before) + F.col(end) - F.col(n)).alias(first))
    few = joined.filter(F.col(n) <= RUN)
    many = joined.filter(F.col(n) > RUN).withColumn(step, F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / RUN))))
    many = many.select(*columns, F.least(F.col(n) - F.col(step) * RUN, F.lit(RUN)).alias(n), (F.col(first) + F.col(step) * RUN).alias(first)).repartition(F.col(shard), F.col(first))
    return few.unionByName(many).select(*columns, F.explode(F.sequence(F.col(first), F.col(first) + F.col(n) - 1)).alias("slot"))


def op2_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = topology(24)
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    rows = docs.select(
        "doc_id",
        (F.col("_bytes") + 8).alias("size"),
        "text_crc32",
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), grow(tree)).alias("grown_shard"),
    )
    out = with_slots(rows, "shard", ["doc_id", "size", "text_crc32"], docs.count())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
