"""Gzip files read where they lie: blocks as splits, line ends over block borders, cut and altered files."""

import gzip
import random
import re
import struct
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helixframe.sources import gzips
from helixframe.sources.lines import read_lines

END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")  # fixed value


def blocked(data: bytes, sizes) -> bytes:
    """The data in blocks of the given sizes, in turn, with the empty last one."""
    out, k = [], 0
    while k < len(data):
        raw = data[k : k + next(sizes)]
        k += len(raw)
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(raw) + packer.flush()
        out.append(struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(raw), len(raw)))
    return b"".join(out) + END_BLOCK


def sized(seed: int, most: int):
    rng = random.Random(seed)
    while True:
        yield rng.randint(1, most)


def lines_of(path, size, step, ends=None):
    reader = gzips._Reader({"files": f'[["file:{path}", {size}]]', "range": str(step)} | ({"ends": ends} if ends else {}))
    return [v for part in reader.partitions() for batch in reader.read(part) for v in batch.column("value").to_pylist()]


@pytest.mark.parametrize("seed", range(12))
def test_ranges_give_every_line_once(tmp_path, seed):
    rng = random.Random(seed)
    ends = [b"\n", b"\r\n", b"\r"] if seed % 2 else [b"\n"]
    data = b"".join(bytes(rng.choices(b"abc\xe9\t", k=rng.choice((0, 0, 1, 3, 40, 400)))) + rng.choice(ends) for _ in range(300)) + rng.choice((b"", b"last"))
    packed = blocked(data, sized(seed, (3, 50, 500)[seed % 3]))
    path = tmp_path / "x.gz"
    path.write_bytes(packed)
    want = re.split(rb"\r\n?|\n", data)
    want = want[:-1] if want[-1] == b"" else want
    for step in (1 << 30, 37, 400, 3000):
        assert lines_of(path, len(packed), step) == want
    only = data.split(b"\n")
    assert lines_of(path, len(packed), 400, "\n") == (only[:-1] if only[-1] == b"" else only)


def test_headers_inside_packed_data_are_no_blocks(tmp_path):
    """Stored bytes that look like headers, and whole blocks that are themselves data."""
    inner = blocked(b"inner\n" * 9, sized(1, 20))
    data = b"".join(inner[k : k + 23] + b"\n" + gzips.EXTRA * 3 + b"\n" for k in range(0, len(inner), 23))
    out = []
    for k in range(0, len(data), 60):
        raw = data[k : k + 60]
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(raw) + packer.flush()
        out.append(struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(raw), len(raw)))
    path = tmp_path / "x.gz"
    path.write_bytes(b"".join(out))
    want = re.split(rb"\r\n?|\n", data)[:-1]
    assert lines_of(path, path.stat().st_size, 50) == lines_of(path, path.stat().st_size, 1 << 30) == want


def test_one_blocked_file_is_many_tasks(spark, tmp_path):
    data = "".join(f"line {k}\n" for k in range(1, 200_001)).encode()
    (tmp_path / "a.gff3").write_bytes(blocked(data, sized(3, 60_000)))  # no name that tells gzip
    (tmp_path / "b.gff3.gz").write_bytes(gzip.compress(data[:1_000_000]) + gzip.compress(data[1_000_000:]))
    (tmp_path / "c.gz").write_bytes(b"line 1\rline 2\r\nline 3")  # no gzip, but for its name
    (tmp_path / "d.gff3").write_bytes(data)
    (tmp_path / "e.gz").write_bytes(b"")
    size = (tmp_path / "a.gff3").stat().st_size
    assert gzips.gzip_lines(spark, [(f"file:{tmp_path}/a.gff3", size)], step=50_000).rdd.getNumPartitions() == -(-size // 50_000) > 8
    rows = read_lines(spark, str(tmp_path)).selectExpr("substring_index(file, '/', -1) AS f", "file", "line_no", "text = concat('line ', line_no) AS good")
    got = {r.f: (r.n, r.most, r.good) for r in rows.groupBy("f").agg(*[F.expr(x) for x in ("count(*) AS n", "max(line_no) AS most", "bool_and(good) AS good")]).collect()}
    assert got == {"a.gff3": (200_000, 200_000, True), "b.gff3.gz": (200_000, 200_000, True), "c.gz": (3, 3, True), "d.gff3": (200_000, 200_000, True)}
    assert len({r.file.rsplit("/", 1)[0] for r in rows.select("file").distinct().collect()}) == 1  # named alike, however they are read


def test_cut_and_altered_blocks_fail(spark, tmp_path):
    packed = blocked(b"chr1\tx\n" * 5000, sized(5, 900))
    cut = tmp_path / "cut.gz"
    cut.write_bytes(packed[: len(packed) // 2 + 3])
    bad = bytearray(packed)
    bad[packed.index(gzips.EXTRA, len(bad) // 2) + 22] ^= 0x55  # packed bytes, not a header's date
    (tmp_path / "bad.gz").write_bytes(bad)
    (tmp_path / "mixed.gz").write_bytes(packed + gzip.compress(b"no block\n"))
    for name in ("cut", "bad", "mixed"):
        with pytest.raises(PySparkException):
            read_lines(spark, str(tmp_path / f"{name}.gz")).count()
