"""Quality classification by importance resampling.

Two generative models over hashed n-grams - byte 4-grams, and whether a word repeats the
one before it - are counted: one from labelled target texts, one from all texts. A text's
log weight is the log ratio of its probabilities under them. Adding Gumbel noise to the log
weights and keeping the k largest draws k texts without replacement in proportion to their
weights. k is the number of texts whose log weight reaches the cut that splits the labelled
texts best, an error on a target text counting ``TARGET_COST`` times one on another.

Target counts and the cut use at most ``TARGETS`` labelled target rows and ``OTHERS``
others, taken by hash of the id; the raw model and k cover all rows. The k-th largest key
is found by narrowing histograms, so no row is sorted or collected beyond a bounded last
bin. The noise is drawn from a hash of id and text: runs agree, and rows equal in both are
kept or dropped together. Null and empty texts have log weight -infinity and are dropped.
Without target labels every log weight is 0 and all other texts are kept.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import fresh, map_texts, settle, slices, table, with_fields

BITS, TARGETS, OTHERS, TARGET_COST = 15, 20_000, 5_000, 20.0
#: Byte n-grams, then: word differs from the one before, word repeats it.
FEATURES = (1 << BITS) + 2


def _events(raw: bytes) -> tuple[np.ndarray, int, int]:
    """Buckets of the byte 4-grams (the text after three zero bytes); repeated and other word pairs."""
    b = np.frombuffer(b"\0\0\0" + raw, np.uint8).astype(np.uint32)
    gram = b[3:] | b[2:-1] << np.uint32(8) | b[1:-2] << np.uint32(16) | b[:-3] << np.uint32(24)
    words = raw.split()
    same = sum(map(operator.eq, words, words[1:]))
    return (gram * np.uint32(2654435761)) >> np.uint32(32 - BITS), same, max(0, len(words) - 1) - same


def counts(text: str) -> np.ndarray:
    bucket, same, other = _events(text.encode("utf-8", "surrogatepass"))
    return np.r_[np.bincount(bucket, minlength=1 << BITS), other, same]


@dataclass
class Ratio:
    """Log of target over raw probability of each feature; the lowest key that is kept."""

    log: np.ndarray
    least: float = -np.inf

    @classmethod
    def of(cls, target: np.ndarray, raw: np.ndarray) -> Ratio:
        """Probabilities with one added to each count; n-grams and word pairs are separate models."""
        parts = []
        for at in (slice(0, 1 << BITS), slice(1 << BITS, FEATURES)):
            t, r = target[at] + 1.0, raw[at] + 1.0
            parts.append(np.log(t / t.sum()) - np.log(r / r.sum()))
        return cls(np.concatenate(parts) if target.sum() else np.zeros(FEATURES))

    def weight(self, text: str) -> float:
        if not text:
            return -np.inf
        bucket, same, other = _events(text.encode("utf-8", "surrogatepass"))
        return float(self.log[bucket].sum() + other * self.log[-2] + same * self.log[-1])


def chosen_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): a bounded sample of the labelled rows, by hash; the lower label of a repeated id."""
    one = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    draw = F.xxhash64("doc_id", F.lit("resampling"))
    return one.filter("quality = 1").orderBy(draw).limit(TARGETS).union(one.filter("quality <> 1").orderBy(draw).limit(OTHERS))


def _noise(text: str = "text") -> F.Column:
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.col(text), F.lit("gumbel")), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, collect: int = 5_000, bins: int = 2_000) -> float:
    """The ``k``-th largest value, exactly: histograms narrow to a range of few enough values."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    x = F.col(column)
    while True:
        here = df.filter((x >= low) & (x <= high))
        if high <= low or not low + (high - low) / bins > low:
            return low
        width = (high - low) / bins
        at = F.least(F.floor((x - low) / width), F.lit(bins - 1))
        found = sorted(here.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect(), reverse=True)
        for r in found:
            if k <= r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            k -= r["n"]
        if n <= collect:
            inside = sorted((v[0] for v in df.filter((x >= low) & (x <= high)).select(column).collect()), reverse=True)
            return inside[k - 1]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[Ratio, DataFrame]:
    """The fitted ratio with its least kept key, and (doc_id, log_weight, noise) of all rows."""
    docs = docs.select("doc_id", "text").join(F.broadcast(chosen_labels(labels)), "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                for text, quality in zip(batch.column("text").to_pylist(), batch.column("quality").to_pylist()):
                    if text:
                        found = counts(text)
                        raw += found
                        if quality == 1:
                            target += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["at", "raw", "target"])

    made = StructType([StructField("at", IntegerType()), StructField("raw", LongType()), StructField("target", LongType())])
    raw, target = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    for at, r, t in docs.mapInArrow(count, made).groupBy("at").agg(F.sum("raw"), F.sum("target")).collect():  # FEATURES rows at most
        raw[at], target[at] = r, t
    ratio = Ratio.of(target, raw)
    shared = spark.sparkContext.broadcast(ratio)
    kind = docs.schema["doc_id"].dataType.simpleString()
    label = docs.schema["quality"].dataType.simpleString()
    scored = map_texts(
        docs.withColumn("noise", _noise()),
        lambda batch, texts: {"log_weight": [shared.value.weight(t) for t in texts]},
        f"doc_id {kind}, quality {label}, log_weight double, noise double",
    )
    scored = settle(spark, scored, "weights")
    if target.sum():
        # one weight a labelled id, at most TARGETS + OTHERS
        known = scored.filter("quality is not null and log_weight > double('-infinity')").groupBy("doc_id", "quality").agg(F.min("log_weight").alias("log_weight")).toPandas()
        w, good = known["log_weight"].to_numpy(), known["quality"].to_numpy() == 1
        order = np.argsort(w, kind="stable")
        cost = np.r_[0.0, np.cumsum(np.where(good[order], TARGET_COST, -1.0))]  # of a cut before each
        best = np.flatnonzero(cost == cost.min())
        edges = np.r_[w[order][0] - 1.0, w[order], w[order][-1] + 1.0]
        cut = float((edges[best[0]] + edges[best[0] + 1]) / 2)
    else:
        cut = -1e300
    k = scored.filter(F.col("log_weight") >= cut).count()
    keyed = scored.filter(F.col("log_weight") > float("-inf")).select((F.col("log_weight") + F.col("noise")).cast(DoubleType()).alias("key"))
    ratio.least = kth_largest(keyed, "key", k) if k else np.inf
    return ratio, scored.select("doc_id", "log_weight", "noise")


def keep_resampled(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, with all their columns."""
    ratio, _ = fit(spark, docs, labels)
    shared = spark.sparkContext.broadcast(ratio)
    noise, weight = fresh(docs.columns, "noise", "log_weight")
    schema = with_fields(docs.schema, **{noise: DoubleType(), weight: DoubleType()})
    out = map_texts(docs.withColumn(noise, _noise()), lambda batch, texts: {weight: [shared.value.weight(t) for t in texts]}, schema)
    return out.filter(F.col(weight) + F.col(noise) >= ratio.least).drop(noise, weight)


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio, scored = fit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    key = F.col("log_weight") + F.col("noise")
    return scored.select("doc_id", "log_weight", key.alias("gumbel_key"), (key >= ratio.least).alias("kept"))
