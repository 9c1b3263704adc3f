"""Best-fit packing with large-item matching.

Documents become token ids of a public byte-level vocabulary plus one end id; only those
longer than the capacity are cut (a shorter piece first, then full ones). Pieces above one
third of the capacity can share a sequence with at most one other such piece, so they are
paired greedily, each largest with the largest that still fits. Smaller pieces then go, in
falling length, to the smallest gap that holds them, or open new sequences.

The plan depends only on how many pieces there are of each length, so it is made from a
histogram of at most ``capacity`` counts: whole runs of equal lengths are placed at once in
runs of equal sequences. The plan is a list of (length, first rank, first sequence, offset);
each piece finds its place by its rank among the pieces of its length. Which of two pieces
of one length comes first is of no account, so ranks come from sub-buckets to which pieces
are dealt by a number written with them: a length, or one text, that makes up a third of
all pieces is spread over many tasks.

Ids are those of the tokenizers library as the vocabulary file sets it up: a text that spells
out a special token gets that token's id. Null and empty texts are one piece of one id (the
end id). Repeated rows are packed one by one. An empty table gives an empty result. Columns
beside key and text are ignored.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType

from .common import ChunkIds, fresh, map_texts, settle, table, with_fields

CAPACITY, END_ID = 2048, 0
#: Pieces of one length that one sub-bucket holds at about this many; it is ranked in one task.
BUCKET_PIECES = 250_000


class Encoder:
    """Ids of texts exactly as the tokenizer file gives them, remembering the ids of chunks.

    The vocabulary's pattern never joins a blank to what stands before it, so a text whose
    blanks stand alone between other characters can be cut before each blank. Other texts,
    and those that spell out a special token, go to the tokenizer whole. The rank file holds the same vocabulary; chunks not yet
    known are encoded together in one call.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        special = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)).search if special else lambda t: None
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.length = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            self.length[i] = len(token)
        self.crowded = re.compile(r" (?<=\s )\s").search
        self.chunks = ChunkIds(self._learn)

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that each follow a blank and hold none."""
        joined = " " + " ".join(chunks)
        ids = np.array(self.words.encode_ordinary(joined), "<u4")
        raw = joined.encode()
        ends = np.r_[np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)[1:], len(raw)]
        stops = (4 * (np.searchsorted(np.cumsum(self.length[ids]), ends) + 1)).tolist()
        out = ids.tobytes()
        return [out[a:b] for a, b in zip([0, *stops], stops)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.split(" ") for t in texts]
        whole = ["" in words or self.crowded(t) or self.special(t) for t, words in zip(texts, split)]
        rest = self.chunks.encode([[] if w else words[1:] for words, w in zip(split, whole)])
        out = []
        for t, words, w, ids in zip(texts, split, whole, rest):
            if w:
                out.append(np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(np.array(self.words.encode_ordinary(words[0]), "<u4").tobytes() + ids.tobytes())
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(tokenizer: str, ranks: str, pattern: str) -> Encoder:
    key = (tokenizer, ranks, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def public_encoder_args() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, (head if head and s == 0 else capacity)) for s in starts]


def pieces(df: DataFrame, args: tuple[str, str, str], capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length and the checksum of its ids."""

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        encode, end = encoder(*args).encode, np.array([END_ID], "<u4").tobytes()
        lists = []
        for ids in encode(texts):
            ids += end
            lists.append([(k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))])
        return {"pieces": [[dict(zip(("piece", "start", "length", "ids_crc32"), p)) for p in x] for x in lists]}

    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, pieces array<struct<piece: int, start: long, length: long, ids_crc32: long>>"
    return map_texts(df.select(key, text), work, schema, text).selectExpr(f"`{key}`", "inline(pieces)")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Where the pieces go: (length, first rank, first sequence, offset) runs, and the number of sequences.

    ``counts``: pieces of each length from 1 to ``capacity``. Gaps of equal size form runs
    [first, end) of sequences; a run is split where a length's pieces end within it.
    """
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # of gaps that have runs, rising
    made = 0

    def leave(gap: int, first: int, end: int) -> None:
        if gap and end > first:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, end))

    def take(gap: int, most: int) -> tuple[int, int]:
        first, end = gaps[gap].pop()
        if end - first > most:
            gaps[gap].append((first + most, end))
            end = first + most
        if not gaps[gap]:
            del gaps[gap]
            sizes.remove(gap)
        return first, end

    def put(length: int, rank: int, first: int, end: int, gap: int) -> int:
        runs.append((length, rank, first, capacity - gap))
        leave(gap - length, first, end)
        return rank + end - first

    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a)
        if at and large[at - 1] == a and left[a] == 1:
            at -= 1  # its only partner of this length would be itself
        partner = large[at - 1] if at else 0
        n = left[a] if not partner else left[a] // 2 if a == partner else min(left[a], left[partner])
        b = partner
        first, end, made = made, made + n, made + n
        runs.append((a, rank[a], first, 0))
        rank[a] += n
        left[a] -= n
        gap = capacity - a
        if partner:
            runs.append((b, rank[b], first, a))
            rank[b] += n
            left[b] -= n
            gap -= b
        leave(gap, first, end)
        large = [x for x in large if left[x]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c, r = left[n], 0
        while r < c:
            at = bisect.bisect_left(sizes, n)
            if at < len(sizes):
                gap = sizes[at]
                first, end = take(gap, c - r)
                r = put(n, r, first, end, gap)
            else:  # each new sequence takes as many as it holds before another is opened
                each = capacity // n
                new = (c - r) // each
                if new:
                    for k in range(each):
                        runs.append((n, r, made, k * n))
                        r += new
                    leave(capacity - each * n, made, made + new)
                    made += new
                else:
                    leave(capacity, made, made + 1)
                    made += 1
    return runs, made


def pack(spark: SparkSession, items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with a column ``length``, 1 to ``capacity``) with sequence_id and offset.

    Items are written once, each with a number that deals it to a sub-bucket of its length.
    At most ``capacity`` counts and, beyond those, one for ``BUCKET_PIECES`` items come to
    the driver.
    """
    names = items.columns
    deal, bucket, rank = fresh(names, "deal", "bucket", "rank")
    # a number per row, not a hash of it, so that equal rows part
    items = settle(spark, items.withColumn(deal, F.xxhash64(F.monotonically_increasing_id())), "pieces")
    counts = {n: c for n, c in items.groupBy("length").count().collect()}
    sizes = spark.createDataFrame([(n, max(1, -(-c // BUCKET_PIECES))) for n, c in counts.items()], f"length {dict(items.dtypes)['length']}, {bucket} long")
    dealt = items.join(F.broadcast(sizes), "length").withColumn(bucket, F.pmod(F.col(deal), F.col(bucket)))
    base = np.zeros(capacity + 2, np.int64)  # where a length's sub-buckets begin
    for n, c in counts.items():
        base[n + 1] = max(1, -(-c // BUCKET_PIECES))
    base = np.cumsum(base)
    before = np.zeros(base[-1], np.int64)
    seen: dict[int, int] = {}
    for n, b, c in sorted(map(tuple, dealt.groupBy("length", bucket).count().collect())):
        before[base[n] + b] = seen.get(n, 0)
        seen[n] = seen.get(n, 0) + c
    runs, _ = plan(counts, capacity)
    runs.sort()
    lengths, ranks, firsts, offsets = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 4
    keys = (lengths << 48) | ranks
    shared = spark.sparkContext.broadcast((base, before, keys, ranks, firsts, offsets))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy("length", bucket).orderBy(deal)).cast("long") - 1)
    schema = with_fields(items.select(*names).schema, sequence_id=LongType(), offset=LongType())

    def place(batches):
        base, before, keys, ranks, firsts, offsets = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("length").to_numpy()
            at_rank = batch.column(rank).to_numpy() + before[base[n] + batch.column(bucket).to_numpy()]
            at = np.searchsorted(keys, (n << 48) | at_rank, side="right") - 1
            columns = [batch.column(c) for c in names]
            columns += [pa.array(firsts[at] + at_rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, bucket, rank).mapInArrow(place, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, args: tuple[str, str, str] | None = None) -> DataFrame:
    return pack(spark, pieces(docs, args or public_encoder_args(), capacity), capacity)


def op7_large_item_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))


