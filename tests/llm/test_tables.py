"""Sharding, packing, nearest neighbours, the similarity join and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import neighbours, packing, sharding, similarity


def test_tree_follows_weights_and_grows_without_other_moves(spark):
    tree = [sharding.Leaf(0, 0, 0, 1.0), sharding.Leaf(1, 0, 0, 3.0), sharding.Leaf(2, 0, 1, 2.0), sharding.Leaf(3, 1, 2, 2.0)]
    more = sharding.grow(tree, 2.0)
    heavier = [*tree[:1], sharding.Leaf(1, 0, 0, 5.0), *tree[2:]]
    rows = spark.range(20000).select(*[sharding.shard_of(F.col("id"), t).alias(n) for t, n in ((tree, "a"), (more, "b"), (heavier, "c"))]).collect()
    share = Counter(r.a for r in rows)
    assert all(abs(share[x.shard] / 20000 - x.weight / 8) < 0.02 for x in tree)
    assert {r.b for r in rows if r.b != r.a} == {4} and abs(sum(r.b == 4 for r in rows) / 20000 - 0.2) < 0.02
    assert all(r.c in (0, 1, 2) for r in rows if r.c != r.a)  # only inside the region whose weight grew


def test_slots_of_odd_rows(spark, odd, nothing, monkeypatch):
    tree = sharding.topology(3)
    rows = odd.select("doc_id", F.lit(1).alias("size"), sharding.shard_of(F.col("doc_id"), tree).alias("shard"))
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 4)
    got = sharding.with_slots(rows, "shard", ["doc_id", "size"], 10).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 10 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.with_slots(rows.filter("doc_id = -1"), "shard", ["doc_id", "size"], 0).count() == 0


def test_slots_of_many_copies_come_in_runs(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 13_000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(0).alias("shard"), F.lit(1).alias("n"))
    got = sharding.with_slots(rows, "shard", ["doc_id"], 20_000)
    assert got.columns == ["doc_id", "shard", "n", "slot"]
    found = got.collect()
    assert sorted(r.slot for r in found) == list(range(20_000)) and sum(r.doc_id == 7 for r in found) == 13_000


def test_draws_are_those_of_a_plain_tree(spark):
    """The hash of a key and a child's name is XXH64 of one seeded by that of the other."""
    import math

    import xxhash

    def shard(key, tree):
        node, level = "", {"": tree}
        for depth, name in enumerate(("region", "rack", "shard")):
            here, best = level[node], None
            kids = defaultdict(list)
            for x in here:
                kids[f"{name} {getattr(x, name)}"].append(x)
            for child, leaves in kids.items():
                h = xxhash.xxh64_intdigest(child.encode(), xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42))
                clock = -math.log(((h >> 11) + 0.5) * 2.0**-53) / sum(x.weight for x in leaves)
                best = min(best or (clock, child), (clock, child))
            node, level = best[1], {best[1]: kids[best[1]]}
        return int(node[6:])

    tree = sharding.topology(24)
    keys = [*range(300), -1, 1 << 62]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: (r.a, r.b) for r in df.select("k", sharding.shard_of(F.col("k"), tree).alias("a"), sharding.shard_of(F.col("k"), sharding.grow(tree)).alias("b")).collect()}
    assert got == {k: (shard(k, tree), shard(k, sharding.grow(tree))) for k in keys}


def _fill(runs, counts, capacity):
    """Contents of every sequence, from the plan's runs."""
    bins = defaultdict(list)
    for n, c in counts.items():
        mine = sorted(r for r in runs if r[0] == n)
        for k, (_, rank, first, offset) in enumerate(mine):
            for r in range(rank, mine[k + 1][1] if k + 1 < len(mine) else c):
                bins[first + r - rank].append((offset, n))
    return bins


def test_plan_packs_all_and_leaves_no_gap_that_a_piece_fits(words):
    r = random.Random(9)
    for capacity in (12, 30, 100):
        counts = Counter(r.randint(1, capacity) for _ in range(300))
        runs, made = packing.plan(dict(counts), capacity)
        bins = _fill(runs, counts, capacity)
        assert len(bins) == made and Counter(n for x in bins.values() for _, n in x) == counts
        for x in bins.values():
            at = 0
            for offset, n in sorted(x):
                assert offset == at
                at += n
            assert at <= capacity and sum(3 * n > capacity for _, n in x) <= 2
        assert made <= 1.1 * -(-sum(n * c for n, c in counts.items()) // capacity) + sum(c for n, c in counts.items() if 2 * n > capacity) * 0.2


def test_cuts():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


def test_odd_large_pieces_find_a_partner():
    assert packing.plan({1000: 1, 700: 1}, 2048)[1] == 1
    r = random.Random(3)
    for _ in range(200):
        sizes = [r.randint(683, 2048) for _ in range(r.randint(1, 40))]
        bins, left = 0, sorted(sizes)  # piece by piece: the largest with the largest that fits
        while left:
            a = left.pop()
            fits = [x for x in left if x <= 2048 - a]
            if fits:
                left.remove(fits[-1])
            bins += 1
        counts = Counter(sizes)
        runs, made = packing.plan(dict(counts), 2048)
        assert made == bins and Counter(n for x in _fill(runs, counts, 2048).values() for _, n in x) == counts


def test_ids_are_the_tokenizer_s(words):
    from tokenizers import Tokenizer

    e = packing.encoder(*packing.public_encoder_args())
    library = Tokenizer.from_file(packing.public_encoder_args()[0])
    texts = ["", " a", "a  b", "a \n b", "x\n\n y ", "it's I'll", "<|endoftext|> z", "a<|endoftext|>b c", "é 漢字 ٣", "a\tb c d", "w " * 30, " ".join(words)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want == [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]


def test_packing_of_odd_rows(spark, odd, nothing):
    got = packing.pack_documents(spark, odd, capacity=256).collect()
    e = packing.encoder(*packing.public_encoder_args())
    seen = defaultdict(list)
    for r in got:
        seen[r.sequence_id].append((r.offset, r.length))
    for x in seen.values():
        x.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[0][0] == 0 and sum(x[-1]) <= 256
    text = odd.filter("doc_id = 8").first().text
    ids = np.r_[np.frombuffer(e.encode([text])[0], "<u4"), 0].astype("<u4")
    mine = sorted((r for r in got if r.doc_id == 8), key=lambda r: r.piece)
    assert sum(r.length for r in mine) == len(ids) and all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    assert Counter(r.doc_id for r in got if r.piece == 0)[3] == 2 and {r.length for r in got if r.doc_id in (1, 2)} == {1}
    assert packing.pack_documents(spark, nothing).count() == 0


def test_bounds_hold_and_search_matches_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((600, 24)) + 1
    centre, turn = x.mean(axis=0), neighbours.rotation(24)
    low, high = neighbours.Codes(x, centre, turn).bounds(x[:20], centre, turn)
    true = ((x[None] - x[:20, None]) ** 2).sum(axis=2)
    assert ((low <= true + 1e-6) & (true <= high + 1e-6)).mean() > 0.99
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(700, None), (701, [0.0] * 24), (702, [float("nan")] * 24), (703, [None] * 24), (704, [1.0]), (None, x[0].tolist()), (800, x[5].tolist()), (800, x[5].tolist())]
    df = spark.createDataFrame([(*a, "c") for a in rows], "vec_id long, embedding array<double>, score string")
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    ids = np.array([*range(600), 800, 800])
    every = np.r_[x, x[5:6], x[5:6]]
    hits = total = 0
    for q in range(0, 600, 50):
        d = np.sqrt(((every - every[q]) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)
        assert [g.rank for g in mine] == list(range(1, 11))
        hits, total = hits + len({g.vec_id for g in mine} & {int(ids[k]) for k in best}), total + len({int(ids[k]) for k in best})
    assert hits / total >= 0.9
    assert neighbours.search(df.filter("vec_id = -1"), F.col("vec_id") % 50 == 0).count() == 0
    few = neighbours.search(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(g.vec_id for g in few) == [1, 2]


def test_hot_cells_are_split_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 50)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    r = np.random.default_rng(8)
    x = np.concatenate([r.standard_normal((300, 10)) * 0.1 + c * 5 for c in range(5)] + [np.ones((400, 10))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for g in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect():
        got[g.query_id].append((g.vec_id, g.score))
    hits = 0
    for q in range(0, 1900, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((np.arange(1900), d)) if k != q][:10]
        assert len(got[q]) == 10 and np.allclose([s for _, s in got[q]], d[[k for k, _ in got[q]]], rtol=0, atol=1e-12)
        hits += len(set(best) & {k for k, _ in got[q]})
    assert hits >= 0.98 * 190 and [k for k, _ in got[1500]] == list(range(1501, 1511))
    clustered = neighbours.Cells(np.arange(1500), x[:1500], 10)
    assert clustered.probes < len(clustered.centres) / 2


def _plain_classes(ids, sets):
    parent, links = list(range(len(ids))), Counter()

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            c = len(np.intersect1d(sets[a], sets[b]))
            if len(sets[a]) and len(sets[b]) and c >= 0.8 * (len(sets[a]) + len(sets[b]) - c):
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k in range(len(ids)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return {ids[k]: (least[find(k)], links[k]) for k in range(len(ids))}


def test_similarity_join_matches_brute_force(spark, words, monkeypatch):
    r = random.Random(6)
    base = [[r.choice(words) for _ in range(n)] for n in (12, 40, 90, 400)]
    texts = [" ".join(b) for b in base]
    for b in base:  # near copies: one or a few words changed, case and signs too
        for _ in range(9):
            w = list(b)
            for _ in range(r.randint(0, max(1, len(b) // 45))):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(", ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    texts += [" ".join(r.choice(words) for _ in range(60)) for _ in range(20)] + [texts[0], texts[1], "one two", "one two", "...", ""]
    monkeypatch.setattr(similarity, "SMALL", 4)  # so that buckets split
    ids = list(range(10, 10 + len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, ["c"] * len(ids))), "doc_id long, text string, member string")
    got = {x.doc_id: (x.class_id, x.n_links) for x in similarity.join_similar(spark, docs).collect()}
    assert got == _plain_classes(ids, similarity.shingles(texts))


def test_sketches_agree_across_set_sizes(spark, words):
    r = np.random.default_rng(3)
    for n in (1, 40, 255, 256, 257, 511, 512, 513, 3000):
        found = r.integers(0, 1 << 63, n, dtype=np.uint64)
        plain = [min(int(x) >> 32 for x in similarity.mix64(found ^ salt)) for salt in similarity._SALTS]
        assert similarity.sketch(found).tolist() == plain
    pick, texts = random.Random(8), []
    for n in range(250, 263):  # shingles of the original; its copy has an inserted sentence
        w = [pick.choice(words) + str(n) for _ in range(n + 4)]
        at = pick.randrange(20, n - 20)
        texts += [" ".join(w), " ".join([*w[:at], *(pick.choice(words) for _ in range(pick.randint(1, 20))), *w[at:]])]
    sizes = [len(x) for x in similarity.shingles(texts)]
    assert sum(a <= 256 < b for a, b in zip(sizes[::2], sizes[1::2])) >= 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.class_id, x.n_links) for x in similarity.join_similar(spark, docs).collect()}
    assert got == _plain_classes(list(range(len(texts))), similarity.shingles(texts))
    assert sum(n for _, n in got.values()) == len(texts)


def test_blocks_count_each_pair_once(monkeypatch):
    sets = [np.unique(np.r_[np.arange(50), 100 + k]).astype(np.uint64) for k in range(6)]
    (_, ok), = similarity.compare(sets)
    assert ok.sum() == 30 and not ok.diagonal().any()
    assert similarity.runs_for(0.8, 0.995) >= similarity.runs_for(0.9, 0.995)


def test_sets_of_rows_without_ids_are_compared(spark, words):
    r = random.Random(12)
    w = [r.choice(words) + str(k) for k in range(80)]
    text, near = " ".join(w), " ".join([*w[:-1], "other"])
    docs = spark.createDataFrame([(None, text), (7, near), (None, text), (None, "a b c d e f g"), (None, "a b c d e f g"), (3, "x")], "doc_id long, text string")
    got = Counter(map(tuple, similarity.join_similar(spark, docs).select("doc_id", "class_id", "n_links").collect()))
    assert got == {(None, 7, 2): 2, (7, 7, 2): 1, (None, None, 1): 2, (3, 3, 0): 1}
    kept = similarity.keep_one(spark, docs).collect()
    assert Counter(map(tuple, kept)) == {(7, near): 1, (None, "a b c d e f g"): 1, (3, "x"): 1}


@pytest.mark.parametrize("share", [0.8, 0.9, 0.99])
def test_links_of_sets_of_all_sizes(spark, words, share):
    """Pairs at or just above the similarity, from 1 to 2,000 shingles, across every size in between."""
    r = random.Random(int(share * 100))
    texts = []
    for n in [*range(1, 40), *range(40, 300, 7), *range(240, 272), 500, 800, 1200, 1600, 2000]:
        w = [r.choice(words) + str(n) for _ in range(n + 4)]
        more = int(n / share) - n  # shingles that only the longer text has
        texts += [" ".join(w), " ".join([*w, *(f"{r.choice(words)}x{k}" for k in range(more))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.class_id, x.n_links) for x in similarity.join_similar(spark, docs).collect()}
    want = _plain_classes(list(range(len(texts))), similarity.shingles(texts))
    assert sum(n for _, n in want.values()) >= 0.9 * len(texts) and all(got[k][1] <= n for k, (_, n) in want.items())
    assert sum(got[k] == v for k, v in want.items()) >= 0.98 * len(want)


def test_blocks_are_bounded_in_members_and_shingles(spark, words, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 5)
    monkeypatch.setattr(similarity, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(similarity, "SMALL", 4)
    r = random.Random(2)
    w = [r.choice(words) + str(k) for k in range(120)]
    texts = [" ".join([*w[:k], "changed", *w[k + 1 :]]) for k in range(0, 60, 2)] + [" ".join(w)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.class_id, x.n_links) for x in similarity.join_similar(spark, docs).collect()}
    assert got == _plain_classes(list(range(len(texts))), similarity.shingles(texts))


def test_one_of_each_class_stays(spark, odd, nothing):
    kept = similarity.keep_one(spark, odd)
    assert kept.columns == odd.columns
    ids = sorted(x.doc_id or 0 for x in kept.collect())
    assert ids == [1, 2, 3, 4, 5, 6, 8]
    assert similarity.keep_one(spark, nothing).count() == 0


def test_rows_without_words_all_stay(spark):
    rows = [(1, "..."), (1, "!!!"), (1, "!!!"), (None, "- -"), (None, "+"), (None, None), (2, "one two three four five six"), (2, "one two three four five six"), (3, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert Counter(map(tuple, similarity.keep_one(spark, docs).collect())) == Counter(rows[:7])


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_pipeline(spark, sf_dir, tmp_path):
    import os

    if not os.path.isdir(sf_dir):
        pytest.skip("the driver's tables are not here")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == columns and 0.5 * before < docs.count() <= before
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= packing.CAPACITY
