"""Ranked lexical search with Block-Max WAND over an index of compressed posting blocks.

``build_index`` deals the documents into segments (consecutive rows of a partition, at most
``SEGMENT_DOCS`` rows and about ``SEGMENT_BYTES``) and writes, for each segment and term, its postings in
blocks of ``BLOCK``: last document, greatest impact, and the documents' gaps and impacts' term
counts in the fewest whole bytes. An impact is the score that a term adds to a document but
for the term's weight, so block maxima are exact bounds for any query.

``search`` takes the queries in blocks of at most ``QUERY_TERMS`` terms, which are broadcast,
and brings the posting rows of these terms together per segment. There the shallow pointers
of a query's terms (block ends and maxima) bound every stretch of documents between two
block ends; stretches whose bound is below the threshold are skipped, their blocks never
decompressed. The best-bounded stretches are scored first, which gives the threshold, then
those that still reach it. A segment's best ``k`` of each query are merged by a window.

Number of documents, total length and document frequencies are counted over all documents.
Null and empty texts hold no terms and are never found. Repeated rows are ranked each;
equal scores are ordered by document id, null ids last, and repeated ones by any order.
Queries without terms give no rows; repeated query rows are answered each. Empty tables give
no rows. Columns beside id and text are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, fresh, table, translated

BLOCK = 128
SEGMENT_DOCS, SEGMENT_BYTES = 8_192, 16 << 20
#: Terms of the queries that are answered in one pass over the index.
QUERY_TERMS = 200_000
#: Documents that the stretches scored first should hold for each wanted row.
FIRST = 8
#: Ids of rows whose id is null.
NO_ID = np.iinfo(np.int64).max

#: What terms are made of, before A-Z are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of each term, and the terms, of an array of texts."""
    parts = pc.ascii_split_whitespace(translated(texts, _TABLE))
    flat = parts.flatten()
    row = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    return (row, flat) if some.all() else (row[some], flat.filter(pa.array(some)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _bytes_for(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.int64)


def pack(values: np.ndarray, first: np.ndarray, width: np.ndarray, count: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
    """Write each block's values in its width (1, 2 or 4 bytes, little-endian) into ``out`` from ``at`` on."""
    of = np.repeat(np.arange(len(count)), count)
    place = at[of] + (np.arange(len(values)) - first[of]) * width[of]
    for j in range(4):
        mask = width[of] > j
        out[place[mask] + j] = (values[mask] >> (8 * j)) & 255


def posting_blocks(terms: np.ndarray, docs: np.ndarray, tf: np.ndarray, impact: np.ndarray) -> dict[str, np.ndarray | list]:
    """Blocks of the postings, which are ordered by (term, document).

    A payload is: width of gaps, width of counts, the gaps from the block's first document
    on (0 for itself), the counts.
    """
    n = len(terms)
    new = np.r_[True, terms[1:] != terms[:-1]] if n else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    within = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    first = np.flatnonzero(within % BLOCK == 0)
    count = np.diff(np.r_[first, n])
    gaps = np.r_[0, np.diff(docs)] if n else docs
    gaps[first] = 0
    wide = _bytes_for(np.maximum.reduceat(gaps, first)) if n else first
    tall = _bytes_for(np.maximum.reduceat(tf, first)) if n else first
    size = 2 + count * (wide + tall)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    at = ends - size
    out[at], out[at + 1] = wide, tall
    pack(gaps, first, wide, count, out, at + 2)
    pack(tf, first, tall, count, out, at + 2 + count * wide)
    return {
        "term": terms[first], "block_no": within[first] // BLOCK, "first_doc": docs[first], "last_doc": docs[np.r_[first[1:], n] - 1] if n else docs,
        "n": count, "top": np.maximum.reduceat(impact, first) if n else impact, "payload": out, "ends": ends,
    }


def unpack(payload: bytes, first_doc: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and term counts of a block."""
    wide, tall = payload[0], payload[1]
    gaps = np.frombuffer(payload, f"<u{wide}", n, 2)
    return first_doc + np.cumsum(gaps, dtype=np.int64), np.frombuffer(payload, f"<u{tall}", n, 2 + n * wide).astype(np.int64)


@dataclass
class Index:
    """Tables of an index: ``postings`` (segment, term, blocks) and ``segments`` (segment, ids and norms of its documents)."""

    postings: DataFrame
    segments: DataFrame
    n_docs: int
    n_terms: int


_ROWS = "segment string, term string, block_no int, first_doc int, last_doc int, n int, top long, payload binary, ids binary, norms binary"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_docs: int = SEGMENT_DOCS) -> Index:
    """An index of every row of ``docs``, in the session's shared folder."""
    spark = docs.sparkSession
    length = F.regexp_count(F.col(text), F.lit(TERM)).cast("long")
    n_docs, n_terms = docs.select(length.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    id_, text_ = fresh([], "id", "text")
    rows = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("long"), F.lit(int(NO_ID))).alias(id_), F.col(text).alias(text_))

    def segment(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches).combine_chunks()
        texts = whole.column(text_).chunk(0)
        row, terms = tokens(texts)
        if not len(row):
            return
        length = np.bincount(row, minlength=len(texts))
        kept = np.flatnonzero(length)  # documents with a term, numbered anew
        number = np.zeros(len(texts), np.int64)
        number[kept] = np.arange(len(kept))
        norm = 100 - 25 + (25 * length[kept].astype(np.int64) * n_docs) // n_terms
        ids = whole.column(id_).chunk(0).to_numpy(zero_copy_only=False)[kept]
        coded = terms.dictionary_encode()
        pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(kept) + number[row], return_counts=True)
        code, doc = pair // len(kept), pair % len(kept)
        b = posting_blocks(code, doc, tf, impacts(tf, norm[doc]))
        name, size = uuid.uuid4().hex, len(b["ends"])
        out = {
            "segment": pa.array([name]).take(pa.array(np.zeros(size, np.int32))), "term": coded.dictionary.cast(pa.string()).take(pa.array(b["term"])),
            **{c: pa.array(b[c].astype(np.int32)) for c in ("block_no", "first_doc", "last_doc", "n")}, "top": pa.array(b["top"]),
            "payload": pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(np.r_[0, b["ends"]].astype(np.int32).tobytes()), pa.py_buffer(b["payload"].tobytes())]),
            "ids": pa.nulls(size, pa.binary()), "norms": pa.nulls(size, pa.binary()),
        }
        yield from pa.table(out).to_batches(max_chunksize=50_000)
        head = {"segment": [name], "term": [None], **{c: [None] for c in ("block_no", "first_doc", "last_doc", "n", "top", "payload")}, "ids": [ids.astype("<i8").tobytes()], "norms": [norm.astype("<i8").tobytes()]}
        yield pa.RecordBatch.from_pydict(head, schema=pa.table(out).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_rows, n_bytes, step = [], 0, 0, min(512, segment_docs)
        for whole in batches:
            for batch in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                held.append(batch)
                n_rows, n_bytes = n_rows + batch.num_rows, n_bytes + (pc.sum(pc.binary_length(batch.column(text_))).as_py() or 0)
                if n_rows >= segment_docs or n_bytes >= SEGMENT_BYTES:
                    yield from segment(held)
                    held, n_rows, n_bytes = [], 0, 0
        if held:
            yield from segment(held)

    made = Scratch(spark).write(rows.mapInArrow(run, _ROWS), "index") if n_terms else spark.createDataFrame([], _ROWS)
    return Index(made.filter("term is not null").drop("ids", "norms"), made.filter("term is null").select("segment", "ids", "norms"), n_docs, n_terms)


class Postings:
    """Shallow pointers over the blocks of one term in a segment; payloads are decompressed on demand and kept."""

    def __init__(self, first: np.ndarray, last: np.ndarray, n: np.ndarray, top: np.ndarray, payload: list[bytes]):
        self.first, self.last, self.n, self.top, self.payload = first, last, n, top, payload
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            self.open[k] = unpack(self.payload[k], int(self.first[k]), int(self.n[k]))
        return self.open[k]


def best(query: list[tuple[Postings, int]], norms: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a segment with the ``k`` highest scores above 0, and the scores; equal ones by id, then place."""
    ends = np.unique(np.concatenate([np.r_[p.first - 1, p.last] for p, _ in query]))
    ends = np.r_[ends[ends >= 0], len(norms) - 1] if ends[-1] < len(norms) - 1 else ends[ends >= 0]
    begins = np.r_[0, ends[:-1] + 1]
    bound = np.zeros(len(ends), np.int64)  # the greatest score in each stretch (begins, ends)
    at = []  # the block of each term that a stretch lies in, or -1
    for p, w in query:
        b = np.minimum(np.searchsorted(p.last, begins), len(p.last) - 1)
        inside = (p.first[b] <= begins) & (begins <= p.last[b])
        at.append(np.where(inside, b, -1))
        bound += np.where(inside, p.top[b] * w, 0)
    scores = np.zeros(len(norms), np.int64)
    found_ids, found, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    size = ends - begins + 1
    order = np.argsort(-bound, kind="stable")
    cut = int(np.searchsorted(np.cumsum(size[order]), FIRST * k)) + 1
    todo = order[:cut][bound[order[:cut]] >= threshold]
    rest = order[cut:]
    for _ in range(2):
        if len(todo):
            live = np.zeros(len(norms) + 1, np.int8)
            np.add.at(live, begins[todo], 1)
            np.add.at(live, ends[todo] + 1, -1)
            live = np.cumsum(live[:-1]) > 0
            for (p, w), block in zip(query, at):
                wanted = np.unique(block[todo])
                for x in wanted[wanted >= 0]:
                    docs, tf = p.block(int(x))
                    on = live[docs]
                    docs, tf = docs[on], tf[on]
                    scores[docs] += w * impacts(tf, norms[docs])
            docs = np.flatnonzero(live & (scores >= threshold))
            both, value = np.r_[found_ids, docs], np.r_[found, scores[docs]]
            first = np.lexsort((both, ids[both], -value))[:k]
            found_ids, found = both[first], value[first]
            if len(found) == k:
                threshold = int(found[-1])  # equal scores may still win by their id
        todo = rest[bound[rest] >= threshold]
    return found_ids, found


def search(index: Index, queries: DataFrame, item: str = "item_id", text: str = "text", k: int = 20, query_terms: int = QUERY_TERMS) -> DataFrame:
    """``item``, rank, doc_id, score: the ``k`` best documents of each row of ``queries``."""
    spark = queries.sparkSession
    kind = dict(queries.dtypes)[item]
    schema = f"q long, `{item}` {kind}, doc_id long, score long"
    asked = queries.select(F.col(item), F.col(text).alias("text_")).filter("text_ is not null")
    scratch, parts, block, held = Scratch(spark), [], [], 0
    number = 0
    for r in asked.toLocalIterator():
        terms = tokens(pa.array([r[1]]))[1].to_pylist()
        if terms:
            block.append((number, r[0], terms))
            number, held = number + 1, held + len(terms)
        if held >= query_terms:
            parts.append(scratch.write(_search_block(index, block, schema, item, k), "found"))
            block, held = [], 0
    if block:
        parts.append(_search_block(index, block, schema, item, k))
    if not parts or not index.n_terms:
        return spark.createDataFrame([], f"`{item}` {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(item, "rank", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "score")


def _search_block(index: Index, block: list[tuple], schema: str, item: str, k: int) -> DataFrame:
    """(q, item, doc_id, score): the best of each segment for a bounded block of queries."""
    spark = index.postings.sparkSession
    vocabulary = spark.createDataFrame([(t,) for t in sorted({t for _, _, terms in block for t in terms})], "term string")
    rows = index.postings.join(F.broadcast(vocabulary), "term", "left_semi")
    n_docs = index.n_docs
    weights = {r[0]: weight(n_docs, r[1]) for r in rows.groupBy("term").agg(F.sum("n")).toLocalIterator()}  # bounded by the block's terms
    sent = spark.sparkContext.broadcast(([(q, name, {t: weights[t] * terms.count(t) for t in set(terms) if weights.get(t)}) for q, name, terms in block]))
    kind = schema.split("`")[2].split(",")[0].strip()

    def answer(group: pa.Table) -> pa.Table:
        head = group.filter(pc.is_null(group.column("term")))
        ids, norms = (np.frombuffer(head.column(c)[0].as_py(), "<i8") for c in ("ids", "norms"))
        body = group.filter(pc.is_valid(group.column("term"))).sort_by([("term", "ascending"), ("block_no", "ascending")]).combine_chunks()
        terms = body.column("term").to_pylist()
        cuts = [i for i in range(len(terms)) if not i or terms[i] != terms[i - 1]] + [len(terms)]
        column = {c: body.column(c).to_numpy() for c in ("first_doc", "last_doc", "n", "top")}
        payload = body.column("payload").to_pylist()
        lists = {terms[a]: Postings(column["first_doc"][a:b], column["last_doc"][a:b], column["n"][a:b], column["top"][a:b], payload[a:b]) for a, b in zip(cuts, cuts[1:])}
        out: dict[str, list] = {"q": [], item: [], "doc_id": [], "score": []}
        for q, name, wanted in sent.value:
            query = [(lists[t], w) for t, w in wanted.items() if t in lists]
            if query:
                docs, scores = best(query, norms, ids, k)
                out["q"] += [q] * len(docs)
                out[item] += [name] * len(docs)
                out["doc_id"] += ids[docs].tolist()
                out["score"] += scores.tolist()
        return pa.table(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(f"q long, `{item}` {kind}, doc_id long, score long"))
    heads = index.segments.select("segment", *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != "segment"], "ids", "norms")
    both = rows.withColumns({c: F.lit(None).cast("binary") for c in ("ids", "norms")}).unionByName(heads)
    return both.groupBy("segment").applyInArrow(answer, schema)


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"))
    return search(index, table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Every score of every item and document, read from the contract.
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w)) AS total FROM d WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) x GROUP BY r, t),
df AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY t, n_docs),
q AS MATERIALIZED (SELECT k, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS k, item_id, unnest({_TERMS}) AS t FROM benchmark) x GROUP BY k, item_id, t),
m AS (SELECT r, doc_id, 75 + (25 * CAST(len(w) AS BIGINT) * n_docs) // total AS m FROM d, s WHERE len(w) > 0),
scored AS (SELECT k, item_id, doc_id, m.r, CAST(sum(times * weight * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.t = q.t JOIN df ON df.t = q.t JOIN m ON m.r = tf.r GROUP BY k, item_id, doc_id, m.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id, r) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 20"""
