"""Findings of annotation files as they arrive in a directory.

Every micro-batch holds whole files, and all rules are per file, so the findings of a stream
are those of a batch over the same files. Findings of a batch are written under its number:
a batch that is run again replaces its own output.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import engine
from ..sources.annotation import Annotation
from ..sources.lines import read_lines
from ..sources.scratch import written


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: Iterable[str] | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Validate each new file of ``folder`` once and append its findings to ``out``; ends when all present files are done."""
    chosen = list(rules) if rules is not None else None

    def judge(batch: DataFrame, number: int) -> None:
        paths = [r[0] for r in batch.select("path").distinct().collect()]  # at most files_per_batch
        if paths:
            found = engine.findings(spark, Annotation(read_lines(spark, paths), keep=written), chosen)
            found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    schema = "path string, modificationTime timestamp, length long, content binary"
    names = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")
    return names.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
