"""Each registered query on the smallest tables: its columns, and its contract against plain versions."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixframe.llm import personal, registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, n):
    (name,) = (q for q in registry.QUERIES if q.startswith(f"op{n}_"))
    out = registry.QUERIES[name](spark, DIR)
    return out.columns, out.collect()


def _crc(x):
    return zlib.crc32(str(x).encode())


def test_op1(spark, docs):
    columns, rows = run(spark, 1)
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and Counter(r.doc_id for r in rows) == Counter(docs.keys())
    assert all(r.held_out == (_crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_op2(spark, docs):
    columns, rows = run(spark, 2)
    assert columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key") and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op3(spark, docs):
    columns, rows = run(spark, 3)
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and Counter(r.doc_id for r in rows) == Counter(docs.keys())
    assert all(r.held_out == (_crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    known = [r for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in known) >= 0.95 * len(known)


def test_op4(spark, docs):
    columns, rows = run(spark, 4)
    assert columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] and len(rows) == len(docs)
    for r in rows:
        base = personal.base_spans(docs[r.doc_id] or "")
        said = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in personal.KINDS]


def test_op5(spark, docs):
    columns, rows = run(spark, 5)
    assert columns[:3] == ["doc_id", "class_id", "n_links"] and Counter(r.doc_id for r in rows) == Counter(docs.keys())
    least = {r.class_id: min(x.doc_id for x in rows if x.class_id == r.class_id) for r in rows}
    assert all(k == v for k, v in least.items())


def test_op6(spark):
    columns, rows = run(spark, 6)
    assert columns[:4] == ["query_id", "rank", "vec_id", "score"]
    table = spark.read.parquet(f"{DIR}/embeddings.parquet").filter("embedding is not null").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        assert [r.rank for r in mine] == list(range(1, 11)) and all(abs(r.score - d[ids == r.vec_id][0]) < 1e-12 for r in mine)
        hits, total = hits + len(set(best) & {r.vec_id for r in mine}), total + 10
    assert hits >= 0.9 * total


def test_op7(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    columns, rows = run(spark, 7)
    assert columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    library, pieces, places = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for k, mine in pieces.items():
        ids = np.array([*library.encode(docs[k] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n, r in enumerate(sorted(mine, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and (len(mine) == 1 or len(ids) > 2048)
    for x in places.values():
        x.sort()
        assert x[0][0] == 0 and sum(x[-1]) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:]))


def test_op8(spark, docs):
    columns, rows = run(spark, 8)
    assert columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"] and len(rows) == len(docs)
    for r in rows:
        words = [w.decode() for w in (docs[r.doc_id] or "").encode().split()]
        triples = Counter(zip(words, words[1:], words[2:]))
        hit = {p for k, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for p in range(k, k + 3)}
        lines = [x for x in (docs[r.doc_id] or "").split("\n") if x.strip(" \t\v\f\r")]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(hit), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words)) and not (r.kept and r.base_failed)


def test_op9(spark, docs):
    columns, rows = run(spark, 9)
    assert columns == ["doc_id", "log_weight", "gumbel_key", "kept"] and Counter(r.doc_id for r in rows) == Counter(docs.keys())
    kept, gone = [r.gumbel_key for r in rows if r.kept], [r.gumbel_key for r in rows if not r.kept]
    assert kept and min(kept) >= max(gone, default=-np.inf) and len(kept) >= 0.5 * len(rows)


def test_op10(spark, docs):
    import public_tokenizers
    import sentencepiece

    columns, rows = run(spark, 10)
    assert columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and len(rows) == len(docs)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and r.n_bytes == len((docs[r.doc_id] or "").encode())
