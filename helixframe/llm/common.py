"""What the operators of this subpackage share: reading, scratch tables, batching of texts."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of text that one numpy step works on; bounds the memory of a Python worker.
STEP_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The sessions' own folders under the shared one, by application.
_FOLDERS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This session's own folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session has none and runs in one process (tests) is a folder under the
    warehouse used instead; a cluster without it is refused. The folder is deleted when the
    driver's process ends.
    """
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        top = context.getConf().get("spark.checkpoint.dir", None)
        if not top:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        _FOLDERS[context.applicationId] = f"{top.rstrip('/')}/{context.applicationId}"
        atexit.register(_discard_last, spark, _FOLDERS[context.applicationId])
    return _FOLDERS[context.applicationId]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders that no later plan reads."""
    jvm, context = spark._jvm, spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _discard_last(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        discard(spark, path)


class Scratch:
    """Tables written to the shared folder; ``drop`` deletes one as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self._at = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for x in tables:
            discard(self.spark, self._at.pop(id(x))[0])


def settle(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    return Scratch(spark).write(df, name)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, with underscores added until none of them is one of ``columns`` in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_fields(schema: StructType, **kinds: DataType) -> StructType:
    """``schema`` with more fields."""
    return StructType([*schema.fields, *(StructField(name, kind) for name, kind in kinds.items())])


def slices(batch: pa.RecordBatch, text: str, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``step_bytes`` of text each; a longer text is alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    step = np.cumsum(size, dtype=np.int64) // step_bytes
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def map_texts(
    df: DataFrame,
    work: Callable[[pa.RecordBatch, list[str]], dict],
    schema: str | StructType,
    text: str = "text",
    step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """Apply ``work(batch, texts)`` to batches of rows; null texts arrive as ''.

    ``work`` returns a dict of columns; the columns of the Spark ``schema`` are taken from
    it, or else from the batch. Rows stay where they are: no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = _parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(wanted)
        for whole in batches:
            for batch in slices(whole, text, step_bytes):
                texts = [x or "" for x in batch.column(text).to_pylist()]
                made = work(batch, texts)
                columns = []
                for f in arrow:
                    x = made[f.name] if f.name in made else batch.column(f.name)
                    columns.append(x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, type=f.type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, wanted)


def join_bytes(parts: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All parts in one byte array, ``pad`` zero bytes before each; starts and lengths of the parts."""
    zero = b"\0" * pad
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths + pad) - lengths
    return np.frombuffer(zero + zero.join(parts) if parts else b"", np.uint8), starts, lengths


def translated(texts: pa.Array, by: bytes) -> pa.Array:
    """The texts, null ones empty, with each byte put through a table that keeps bytes from 128 on."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = data.to_pybytes()[at[0] : at[-1]] if data is not None else b""
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(held.translate(by))])


def sums_by(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each [start, start + length); 0 for empty ranges."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[starts + lengths] - total[starts]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ChunkIds:
    """Token ids of texts given as lists of chunks, where a chunk's ids don't depend on its neighbours.

    Distinct chunks of a step are looked up once; ``learn`` gets those not yet known, all in
    one call, and returns their little-endian unsigned 32-bit ids. Past ``most`` remembered
    chunks the memory is emptied, so it stays bounded.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], most: int = 600_000):
        self.learn, self.most, self.known = learn, most, {}

    def encode(self, texts: list[list[str]]) -> list[np.ndarray]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        number: dict = defaultdict(itertools.count().__next__)
        of = [np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks)) for chunks in texts]
        chunks = list(number)
        missing = [c for c in chunks if c not in known]
        if missing:
            known.update(zip(missing, self.learn(missing)))
        parts = list(map(known.__getitem__, chunks))
        size = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        flat, start = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        at = np.concatenate(of) if of else np.zeros(0, np.int64)
        n = size[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum([len(x) for x in of], dtype=np.int64)]]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
