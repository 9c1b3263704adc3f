"""References of files whose lines keep arriving, with state for the open epoch only.

A line ``###`` says that all references before it are resolved. Files are dealt to ``lots`` and
the ids of each lot to ``buckets``; a bucket's state holds, for all files of its lot, the definitions
and references since the last ``###``. Files of a lot are settled together, so a micro-batch costs
by its rows and not by its files. When the next ``###`` comes, references that found their definition in the epoch are dropped,
and everything else leaves the state: definitions, and references that found none. These
rows go to a table (the sink), so nothing is lost and the state falls to what follows the
``###``. ``findings`` joins that table, and the open epochs read from the checkpoint,
whenever it is asked: a reference without any
definition is GFF-STR-004 or GFF-STR-005, and one whose definition came only in a later
epoch, however late, is GFF-DIR-003.

Rows may leave the state early without harm, since the joins compare line numbers and not
times of arrival. So a bucket with more than ``most`` rows is emptied to the table, and so
is what it holds of a file that has been idle for ``idle_ms``, if that is given: it needs timers, with which a
query looks at the clock for ever and must be stopped. Lines of an epoch that was closed before they
came go straight to the table. Only ``###`` lines and the begin of a FASTA section must not
come after lines of later epochs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.annotation import COLUMNS, is_resolution, named_ids, own_id, starts_fasta
from ..sources.lines import running_count

BUCKETS, MOST, LOTS = 16, 200_000, 64
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OPEN = "file string, kind string, id string, line_no long"
#: Of each file of a lot: its last ``###``, where FASTA begins, and when the bucket last had lines of it.
_MARKS = "file string, closed long, cut long, seen long"
_NEVER = np.iinfo(np.int64).max
#: What leaves the state: definitions with the first parent reference before them in their
#: epoch, references, marks of the file, and how many rows a bucket holds after a batch.
_LEFT = "file string, bucket int, kind string, id string, line_no long, before long"


def events(lines: DataFrame, buckets: int) -> DataFrame:
    """(file, bucket, kind, id, line_no) of each definition, reference, ``###`` and FASTA begin; marks go to every bucket."""
    raw = F.regexp_replace("text", "\r$", "")
    text = F.when((F.col("line_no") == 1) & raw.startswith("﻿"), F.substring(raw, 2, 1 << 30)).otherwise(raw)
    df = lines.select("file", "line_no", text.alias("text"))
    x, t = F.split("text", "\t", -1), F.col("text")
    mark = F.when(is_resolution(t), "###").when(starts_fasta(t), F.when(t.startswith(">"), ">").otherwise("##FASTA"))
    df = df.select("file", "line_no", mark.alias("mark"), F.when(~t.startswith("#") & (F.size(x) == 9), x).alias("x"))
    df = df.select("file", "line_no", "mark", *[F.get("x", F.lit(k)).alias(c) for k, c in enumerate(COLUMNS)])
    dealt = lambda v: F.pmod(F.hash(v), F.lit(buckets)).alias("bucket")
    one = lambda kind, v: F.struct(dealt(v), F.lit(kind).alias("kind"), v.alias("id"))
    none = F.array().cast("array<struct<bucket:int,kind:string,id:string>>")
    marks = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.struct(b.alias("bucket"), F.col("mark").alias("kind"), F.lit("").alias("id")))
    parts = [
        F.when(F.col("mark").isNotNull(), marks).otherwise(none),
        F.when(own_id().isNotNull(), F.array(one("def", own_id()))).otherwise(none),
        *[F.coalesce(F.transform(named_ids(tag), lambda v: one(k, v)), none) for k, tag in (("P", "Parent"), ("D", "Derives_from"))],  # noqa: B023
    ]
    return df.select("file", "line_no", F.explode(F.concat(*parts)).alias("e")).select("file", "e.*", "line_no")


def settle_epochs(rows: pd.DataFrame, ends: np.ndarray, after: int | np.ndarray, last: np.ndarray | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(left, open): of rows (kind, id, line_no) before the last of ``ends`` those that must be kept, and the rows behind it.

    ``after``: the last ``###`` of earlier batches; rows before it are left as they are. Rows of
    several files may come at once, if their line numbers don't meet: then ``after`` and ``last``,
    the last of a file's ends, are given for each row.
    """
    line = rows.line_no.to_numpy()
    last = (ends[-1] if len(ends) else after) if last is None else last
    late, still = rows[line <= after], rows[(line > after) & (line > last)]
    now = rows[(line > after) & (line <= last)]
    now = now.assign(epoch=np.searchsorted(ends, now.line_no))
    first = now[now.kind == "def"].groupby(["epoch", "id"], as_index=False).line_no.min().rename(columns={"line_no": "at"})
    refs = now[now.kind != "def"].merge(first, on=["epoch", "id"], how="left")
    early = refs[(refs.kind == "P") & (refs.line_no <= refs["at"])].groupby(["epoch", "id"], as_index=False).line_no.min().rename(columns={"line_no": "before"}).astype({"before": "Int64"})
    told = first.merge(early, on=["epoch", "id"], how="left").rename(columns={"at": "line_no"}).assign(kind="def")
    # a reference to what its own epoch defines is settled
    left = pd.concat([told, refs[refs["at"].isna()], late])[["kind", "id", "line_no"] + ["before"] * (len(told) > 0)]
    return left.reindex(columns=["kind", "id", "line_no", "before"]), still[["kind", "id", "line_no"]]


def settle_files(rows: pd.DataFrame, ends: pd.DataFrame, marks: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The same for rows (file, kind, id, line_no) and ends (file, line_no) of several files; ``marks``: by file, closed (the last ``###`` of earlier batches)."""
    # the files' lines are laid end to end
    span = int(max(rows.line_no.max() if len(rows) else 0, ends.line_no.max() if len(ends) else 0, marks.closed.max())) + 1
    of = lambda df: marks.index.get_indexer(df.file) * span
    after = of(rows) + marks.closed.to_numpy()[marks.index.get_indexer(rows.file)]
    last = np.maximum(after, of(rows) + ends.groupby("file").line_no.max().reindex(rows.file).fillna(0).to_numpy(dtype="int64"))
    parts = settle_epochs(rows.assign(line_no=of(rows) + rows.line_no), np.sort(of(ends) + ends.line_no.to_numpy()), after, last)
    out = []
    for part in parts:
        at = part.line_no.to_numpy() // span
        part = part.assign(file=marks.index.to_numpy()[at], line_no=part.line_no - at * span)
        out.append(part.assign(before=part.before.astype("Int64") - at * span) if "before" in part else part)
    return out[0][["file", "kind", "id", "line_no", "before"]], out[1][["file", "kind", "id", "line_no"]]


class Epochs(StatefulProcessor):
    """The open epochs of one bucket of a lot of files."""

    def __init__(self, most: int, idle_ms: int | None):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)
        self.marks = handle.getListState("marks", _MARKS)

    @staticmethod
    def _rows(state, columns: list[str]) -> pd.DataFrame:
        rows = pd.DataFrame(list(state.get()) if state.exists() else [], columns=columns)
        return rows.astype({c: "int64" for c in columns if c not in ("file", "kind", "id")})

    def _held(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        return self._rows(self.open, ["file", "kind", "id", "line_no"]), self._rows(self.marks, ["file", "closed", "cut", "seen"]).set_index("file")

    def _keep(self, rows: pd.DataFrame, marks: pd.DataFrame) -> None:
        if len(rows):
            self.open.put(list(zip(rows.file, rows.kind, rows.id, rows.line_no.tolist())))
        else:
            self.open.clear()
        self.marks.put(list(zip(marks.index, marks.closed.tolist(), marks.cut.tolist(), marks.seen.tolist())))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if len(rows):
                self.handle.registerTimer(int(marks.seen[rows.file.unique()].min()) + self.idle_ms)

    @staticmethod
    def _sent(key, rows: pd.DataFrame, held: pd.Series) -> pd.DataFrame:
        """The rows, and how many each file of ``held`` still has."""
        told = pd.DataFrame({"file": held.index, "kind": "state", "id": "", "line_no": held.to_numpy()})
        out = pd.concat([rows, told]).reindex(columns=["file", "kind", "id", "line_no", "before"])
        out.insert(1, "bucket", np.int32(key[1]))
        return out.astype({"line_no": "int64", "before": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([x[["file", "kind", "id", "line_no"]] for x in rows], ignore_index=True)
        held, known = self._held()
        came = pd.Index(new.file.unique(), name="file")
        begins, ends = new.kind.isin([">", "##FASTA"]), new.kind == "###"
        marks = known.reindex(known.index.union(came), fill_value=0)
        marks["cut"] = pd.concat([known.cut, new[begins].groupby("file").line_no.min()]).groupby(level=0).min().reindex(marks.index, fill_value=_NEVER)
        if self.idle_ms is not None:
            marks.loc[came, "seen"] = timerValues.getCurrentProcessingTimeInMs()
        real = pd.concat([held, new[~begins & ~ends]], ignore_index=True)
        before = lambda df: df[df.line_no.to_numpy() < marks.cut.to_numpy()[marks.index.get_indexer(df.file)]]
        closing = before(new[ends])
        left, still = settle_files(before(real), closing, marks)
        if len(still) > self.most:  # more than one state should hold: the joins settle it
            left, still, came = pd.concat([left, still]), still[:0], came.union(pd.Index(held.file.unique()))
        marks["closed"] = np.maximum(marks.closed, closing.groupby("file").line_no.max().reindex(marks.index).fillna(0).astype("int64"))
        self._keep(still, marks)
        if key[1] == 0:  # marks are told once
            left = pd.concat([left, new[ends | begins]])
        yield self._sent(key, left, still.groupby("file").size().reindex(came, fill_value=0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, marks = self._held()
        idle = held.file.map(marks.seen).to_numpy(dtype="int64") + self.idle_ms <= timerValues.getCurrentProcessingTimeInMs()
        self._keep(held[~idle], marks)
        yield self._sent(key, held[idle], pd.Series(0, index=held[idle].file.unique()))


def watch_references(lines: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS, most: int = MOST, idle_ms: int | None = None, trigger: dict | None = None, lots: int = LOTS) -> StreamingQuery:
    """Start a query over a stream of (file, line_no, text) that writes what leaves the state to ``out``.

    A micro-batch that runs again replaces its own rows. State needs the RocksDB store, which
    is set for the session.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    left = events(lines, buckets).withColumn("lot", F.pmod(F.hash("file"), F.lit(lots))).groupBy("lot", "bucket").transformWithStateInPandas(Epochs(most, idle_ms), outputStructType=_LEFT, outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime")
    return left.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def still_open(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(file, kind, id, line_no) of the rows that the state holds after the last micro-batch."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    return held.select("list_element.*")


def findings(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """(rule, file, line, n) of what arrived so far, from the table of a stream and what its state still holds."""
    rows = spark.read.schema(f"{_LEFT}, batch int").parquet(out).filter("kind <> 'state'").select("file", "kind", "id", "line_no", "before")
    rows = rows.unionByName(still_open(spark, checkpoint).withColumn("before", F.lit(None).cast("long")))
    fasta = rows.filter("kind in ('>', '##FASTA')").groupBy("file").agg(F.min("line_no").alias("cut"))
    marks = rows.filter("kind = '###'").select("file", F.lit("###").alias("kind"), F.lit("").alias("id"), "line_no", F.lit(None).cast("long").alias("before"))
    rest = rows.filter("kind in ('def', 'P', 'D')").select("file", "kind", "id", "line_no", "before").unionByName(marks)
    rest = rest.join(fasta, "file", "left").filter("cut is null or line_no < cut").drop("cut")
    placed = running_count(rest, F.col("kind") == "###", "gen")
    first = placed.filter("kind = 'def'").groupBy("file", "id").agg(F.min_by(F.struct("line_no", "gen", "before"), "line_no").alias("x"))
    first = first.select("file", "id", F.col("x.line_no").alias("at"), F.col("x.gen").alias("defined"), F.col("x.before").alias("before"))
    refs = placed.filter("kind in ('P', 'D')").select("file", "id", "kind", "line_no", "gen").join(first, ["file", "id"], "left")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("line_no")))
    lost = refs.filter("at is null").groupBy("file", "id", "kind").agg(F.min("line_no").alias("line"), F.count(F.lit(1)).alias("n"))
    lost = lost.select(F.when(F.col("kind") == "P", "GFF-STR-004").otherwise("GFF-STR-005").alias("rule"), "file", "line", "n")
    late = refs.filter("line_no <= at").groupBy("file", "id").agg(F.least(least("P"), F.min("before")).alias("p"), least("D").alias("q"), F.min("gen").alias("g"), F.first("defined").alias("defined"))
    late = late.filter("g < defined").select(F.lit("GFF-DIR-003").alias("rule"), "file", F.coalesce("p", "q").alias("line"), F.lit(1).cast("long").alias("n"))
    return lost.unionByName(late)


def states(spark: SparkSession, out: str) -> DataFrame:
    """(batch, file, rows): how many rows of each file the state holds after each micro-batch that touched it."""
    rows = spark.read.schema(f"{_LEFT}, batch int").parquet(out).filter("kind = 'state'")
    return rows.groupBy("batch", "file").agg(F.sum("line_no").alias("rows"))


class Progress(StreamingQueryListener):
    """A row for each micro-batch of the queries of a session: lines read, rows sent, rows in the state."""

    def __init__(self) -> None:
        self.rows: dict[tuple[str, int], tuple] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        held = sum(s.numRowsTotal for s in p.stateOperators)
        self.rows[str(p.id), p.batchId] = (str(p.id), p.batchId, p.numInputRows, held, float(p.batchDuration))

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """(query, batch, n_lines, n_held, ms, n_so_far) of the micro-batches that have ended."""
        made = spark.createDataFrame(list(self.rows.values()), "query string, batch long, n_lines long, n_held long, ms double")
        return made.withColumn("n_so_far", F.sum("n_lines").over(Window.partitionBy("query").orderBy("batch")))
