"""SentencePiece encoding and decoding that keeps byte offsets.

Normalisation walks a text with the model's compiled character map (a double-array trie):
the longest prefix that the map holds is replaced, else one character is copied, and every
normalised byte remembers the source byte it came from. Only bytes that begin an entry of
the map are looked up, and stretches between them are copied at once; a model whose map is
empty copies all of a text. Blanks become the mark U+2581 and one mark is put before a text,
which has no source byte; models that say so also drop outer blanks and join inner ones.
The normalised bytes are what is encoded. The pieces' lengths cut them, and the alignment
projects each cut to the source: piece k covers source bytes [start, end), gapless.

Where no piece of a model joins a mark to a character before it (checked when it is loaded),
the normalised text is cut before its marks, and chunks are encoded apart and remembered;
other models encode whole texts. Null and empty texts give the begin and end ids alone;
repeated rows equal results; an empty table an empty one.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ChunkIds, map_texts, table

MARK = "▁"


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a serialised message: (number, integer or bytes)."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, raw[i : i + n]
        i += n


class CharacterMap:
    """The compiled map: 4 bytes of trie size, the trie's units, then zero-ended replacements."""

    def __init__(self, compiled: bytes):
        self.units: list[int] = []
        self.values = b""
        if compiled:
            (n,) = struct.unpack_from("<I", compiled)
            self.units = list(struct.unpack_from(f"<{n // 4}I", compiled, 4))
            self.values = compiled[4 + n :]
        #: Whether an entry begins with this byte.
        self.begins = np.array([b > 0 and self.units != [] and self._first(b) for b in range(256)], bool)

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _first(self, byte: int) -> bool:
        node = self._step(self.units[0]) ^ byte
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``raw[at:]`` in the map, and its replacement."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._step(units[0])
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != raw[k]:
                break
            node ^= self._step(unit)
            if unit & 0x100:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.values.index(b"\0", found[1])
        return found[0], self.values[found[1] : end]


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        spec = dict(_fields(next(v for k, v in fields if k == 3)))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix, self.collapse, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        surfaces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.separable = self.dummy_prefix and self.escape and not self.collapse and not self.map.units
        self.separable &= all(self.library.piece_to_id(f"<0x{b:02X}>") != self.library.unk_id() for b in range(256))
        self.separable &= not any(re.search(f"[^{MARK}]{MARK}", s) for s in surfaces)
        #: Normalised bytes of each piece; those of an unknown piece are known from the text alone.
        self.length = np.array([1 if self.library.is_byte(i) else 0 if self.library.is_control(i) else len(s.encode()) for i, s in enumerate(surfaces)])
        self.chunks = ChunkIds(self._learn)
        self.mark_id = np.array([self.library.piece_to_id(MARK)], "<u4").tobytes()
        self.ends = (self.library.bos_id(), self.library.eos_id())
        self.led = re.compile(f"{MARK}+[^{MARK}]*").findall

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of normalised chunks that begin with a mark, which the library puts there itself."""
        made = self.library.encode([c[1:] for c in chunks])
        return [np.array(ids, "<u4").tobytes() if len(c) > 1 else self.mark_id for c, ids in zip(chunks, made)]

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes; for each, and for the end, the source byte it came from."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return b"", np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8)
        parts: list[bytes] = []
        places: list[np.ndarray] = []
        at = 0
        for k in np.flatnonzero(self.map.begins[data]).tolist() if self.map.units else ():
            if k < at or not (hit := self.map.longest(raw, k)):
                continue
            parts += [raw[at:k], hit[1]]
            places += [np.arange(at, k), np.full(len(hit[1]), k)]
            at = k + hit[0]
        parts.append(raw[at:])
        places.append(np.arange(at, len(raw)))
        out, source = b"".join(parts), np.concatenate(places)
        if self.collapse:
            letters = np.frombuffer(out, np.uint8)
            keep = (letters != 32) | np.r_[False, letters[:-1] != 32]
            last = np.flatnonzero(letters != 32)
            keep &= np.arange(len(out)) <= (last[-1] if len(last) else -1)
            out, source = letters[keep].tobytes(), source[keep]
            if not out:
                return b"", np.array([len(raw)], np.int64)
        if self.dummy_prefix:
            out, source = b" " + out, np.r_[0, source]
        if self.escape:
            width = np.where(np.frombuffer(out, np.uint8) == 32, len(MARK.encode()), 1)
            out, source = out.replace(b" ", MARK.encode()), np.repeat(source, width)
        return out, np.r_[source, len(raw)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, begin and end ids included, and their source byte spans, one row (start, end)."""
        b, e = self.ends
        normal = [self.normalise(t) for t in texts]
        if self.separable:
            chunks = []
            for raw, _ in normal:
                t = raw.decode("utf-8", "surrogatepass")
                words = t.split(MARK)[1:]
                chunks.append(self.led(t) if "" in words else [MARK + w for w in words])
            ids = [np.concatenate(([b], x, [e])).astype("<u4") for x in self.chunks.encode(chunks)]
            sizes = [self.length[x] for x in ids]
        else:
            ids, sizes = [], []
            for made, surfaces in zip(self.library.encode(texts), self.library.encode(texts, out_type=str)):
                ids.append(np.array([b, *made, e], "<u4"))
                n = [1 if self.library.is_byte(x) else len(s.encode()) for x, s in zip(made, surfaces)]
                sizes.append(np.array([0, *n, 0], np.int64))
        return [(x, self._spans(n, source)) for x, n, (_, source) in zip(ids, sizes, normal)]

    @staticmethod
    def _spans(sizes: np.ndarray, source: np.ndarray) -> np.ndarray:
        stop = source[np.cumsum(sizes)]
        return np.stack([np.r_[0, stop[:-1]], stop], axis=1)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ids, byte spans of the pieces, and the text that decoding the ids gives."""

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        m = model(path)
        ids, spans = zip(*m.encode(texts))
        return {
            "ids": [x.tolist() for x in ids],
            "starts": [s[:, 0].tolist() for s in spans],
            "ends": [s[:, 1].tolist() for s in spans],
            "decoded": m.library.decode([x.tolist() for x in ids]),
        }

    schema = f"`{key}` {dict(df.dtypes)[key]}, ids array<int>, starts array<long>, ends array<long>, decoded string"
    return map_texts(df.select(key, text), work, schema, text)


def digest_pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``encode_pieces`` gives, as counts and digests made where the ids are."""

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        m = model(path)
        ids, spans = zip(*m.encode(texts))
        decoded = m.library.decode([x.tolist() for x in ids])
        return {
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded],
            "spans_crc32": [zlib.crc32(np.ascontiguousarray(s, "<i8")) for s in spans],
            "n_bytes": [int(s[-1, 1]) for s in spans],
        }

    schema = f"`{key}` {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long, n_bytes long"
    return map_texts(df.select(key, text), work, schema, text)


def op10_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
