"""Lines of annotation files with exact numbers, whatever the splits."""

from __future__ import annotations

import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .gzips import GZIP, can_open, gzip_lines, opened
from .scratch import folder

#: Lines that one task of a running count takes; longer files are dealt over several.
RUN_BLOCK = 1 << 16


def running_count(df: DataFrame, flag: Column, name: str, file: str = "file", line: str = "line_no") -> DataFrame:
    """How many lines up to and including this one have ``flag``, per file.

    Counted inside blocks of lines, whose totals are then added up, so no task sorts a file.
    """
    block = F.floor(F.col(line) / RUN_BLOCK)
    dealt = df.withColumn("_block", block).withColumn("_flag", flag.cast("long"))
    within = Window.partitionBy(file, "_block").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(file).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(file, "_block").agg(F.sum("_flag").alias("_total"))
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    counted = dealt.withColumn("_here", F.sum("_flag").over(within)).join(offsets, [file, "_block"])
    return counted.withColumn(name, F.col("_here") + F.col("_before")).drop("_block", "_flag", "_here", "_before")


def read_lines(spark: SparkSession, paths: str | list[str], ends: str | None = None) -> DataFrame:
    """(file, line_no, text, valid_utf8) of plain or gzip files; LF, CRLF and CR end lines, or ``ends`` alone.

    Gzip is known by its first bytes, not by the name; ``-`` is standard input. Line numbers
    are the rank inside an input block plus the lines of the file's earlier blocks; a blocked
    gzip file has many. A truncated or corrupt file fails the job: nothing is skipped.
    """
    paths, named, zipped = readable(spark, [paths] if isinstance(paths, str) else list(paths))
    parts = []
    if zipped:
        parts.append(gzip_lines(spark, zipped, ends).select("file", "start", "nth", F.col("value").cast("string").alias("value")))
    if paths or not zipped:
        raw = spark.read.text(paths, lineSep=ends)
        raw = raw.select(
            _shown(F.col("_metadata.file_path"), named).alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("_at"),
            F.col("value"),
        )
        rank = F.row_number().over(Window.partitionBy("file", "start").orderBy("_at"))
        parts.append(raw.select("file", "start", rank.cast("long").alias("nth"), "value"))
    numbered = reduce(DataFrame.unionByName, parts)
    sizes = numbered.groupBy("file", "start").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = numbered.join(offsets, ["file", "start"])
    valid = F.is_valid_utf8("value")
    text = F.when(valid, F.col("value")).otherwise(F.make_valid_utf8("value"))
    return numbered.select("file", (F.col("nth") + F.col("_before")).alias("line_no"), text.alias("text"), valid.alias("valid_utf8"))


def _shown(path: Column, named: dict[str, str]) -> Column:
    """The path, or the name of the input that was copied to it."""
    found = F.lit(None).cast("string")
    for copy, name in named.items():
        found = F.when(path.endswith(copy), F.lit(name)).otherwise(found)
    return F.coalesce(found, path) if named else path


def _begins(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whether each path begins as gzip files do."""
    for part in rows:
        found = []
        for path in part["path"]:
            with opened(path) as f:
                found.append(f.read(2) == GZIP)
        yield part.assign(zipped=found)


def readable(spark: SparkSession, paths: list[str]) -> tuple[list[str], dict[str, str], list[tuple[str, int]]]:
    """Paths that Spark reads as text, the input behind each one that was copied, and (path, bytes) of gzip files.

    The first bytes are looked at by tasks, and gzip files are read where they lie. Only what
    tasks cannot open is copied to the shared folder under a name that tells what it is: standard
    input, and gzip files of file systems that the JVM alone knows.
    """
    context = spark.sparkContext
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
    out, named, sizes = [], {}, {}

    def copied(name: str, zipped: bool) -> str:
        copy = f"{uuid.uuid4().hex}{'.gz' if zipped else '.txt'}"
        named[copy] = name
        out.append(f"{folder(spark)}/inputs/{copy}")
        return out[-1]

    for path in paths:
        if path == "-":
            with tempfile.NamedTemporaryFile() as spool:
                shutil.copyfileobj(sys.stdin.buffer, spool)
                spool.flush()
                spool.seek(0)
                to = hadoop.Path(copied("-", spool.read(2) == GZIP))
                to.getFileSystem(conf).copyFromLocalFile(False, True, hadoop.Path(spool.name), to)
            continue
        at = hadoop.Path(path)
        fs = at.getFileSystem(conf)
        found = list(fs.globStatus(at) or ())
        if not found:
            out.append(path)  # Spark says what is wrong with it
        for status in [y for x in found for y in (fs.listStatus(x.getPath()) if x.isDirectory() else [x])]:
            name, full = status.getPath().getName(), status.getPath().toString()
            if status.isDirectory():
                out.append(full)
            elif name[0] in "._" and name != at.getName():
                continue  # of a directory's files Spark leaves these out too
            elif can_open(full):
                sizes[full] = status.getLen()
            elif name.endswith(".gz"):
                out.append(full)
            else:
                stream = fs.open(status.getPath())
                try:
                    zipped = bytes([max(0, stream.read()), max(0, stream.read())]) == GZIP
                finally:
                    stream.close()
                if zipped:
                    to = hadoop.Path(copied(full, True))
                    hadoop.FileUtil.copy(fs, status.getPath(), to.getFileSystem(conf), to, False, conf)
                else:
                    out.append(full)
    gzips = []
    if sizes:
        listed = spark.createDataFrame([(x,) for x in sizes], "path string")
        for row in listed.mapInPandas(_begins, "path string, zipped boolean").collect():
            if row.zipped or row.path.endswith(".gz"):  # Spark would unpack by the name
                gzips.append((row.path, sizes[row.path]))
            else:
                out.append(row.path)
    return out, named, gzips
