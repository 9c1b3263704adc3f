"""Decontamination, ranked search and phrases against their contracts in plain SQL, on made-up and odd tables."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from helixframe.llm import collocation, ranking, winnowing


def plain(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).fetchdf()


def same(got, want):
    rows = lambda f: sorted(tuple("-" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def mixed(spark):
    """Texts over few words, so that windows, phrases and scores repeat; passages in many texts, copies, nulls."""
    r = random.Random(7)
    few = ["a", "B", "été", "9x", "naıve", "DE", "zz", "Ö"]
    text = lambda n: "".join(r.choice(few) + r.choice([" ", " ", "  ", ", ", ".\n", "\t", "\x00"]) for _ in range(n))
    passage = text(14)
    rows = [(k, text(r.choice([0, 1, 3, 9, 10, 11, 40])) + (passage if k % 5 == 0 else ""), r.choice(["en", "de", None]), "s", 1) for k in range(120)]
    rows += [(200, passage * 30, "en", None, None)] * 3 + [(None, passage, None, "s", 2), (201, None, "en", "s", 0), (202, "", "en", "s", 0), (203, " ".join(["a"] * 60), "en", "s", 0), (204, passage.upper(), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    items = [(k, text(n)) for k, n in enumerate([1, 2, 4, 5, 6, 9, 10, 11, 25, 25])] + [(50, passage), (50, "a a a"), (51, passage), (None, passage), (52, None), (53, ""), (54, "?!"), (55, "a " * 12), (56, "nowhere at all")]
    return docs, spark.createDataFrame(items, "item_id long, text string")


def test_windows_of_items_in_documents(spark, mixed):
    docs, items = mixed
    got = winnowing.decontaminate(docs, items).selectExpr("doc_id", "n_words", "n_hit", "n_items", "sha2(array_join(items, ','), 256) as items_sha256", "contaminated").toPandas()
    same(got, plain(winnowing.OP11_SQL, documents=docs.toArrow(), benchmark=items.toArrow()))
    assert got.n_hit.sum() > 0 and len(got) == docs.count()


def test_windows_of_long_items_alone_and_shuffled(spark, mixed, monkeypatch):
    docs, items = mixed
    long = items.filter("length(text) > 60")
    want = plain(winnowing.OP11_SQL, documents=docs.toArrow(), benchmark=long.toArrow())[["doc_id", "n_words", "n_hit", "n_items"]]
    for most in (10**6, 0):  # both ways of the join
        monkeypatch.setattr(winnowing, "BROADCAST_WINDOWS", most)
        same(winnowing.decontaminate(docs, long).select("doc_id", "n_words", "n_hit", "n_items").toPandas(), want)


def test_no_python_on_the_way(spark, mixed):
    docs, items = mixed
    plan = winnowing.decontaminate(docs, items)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_decontamination_of_odd_tables(spark, odd, nothing):
    items = odd.selectExpr("doc_id as item_id", "text", "source", "n_chars as n_hit")
    got = winnowing.decontaminate(odd.withColumn("n_hit", odd["n_chars"]).withColumn("w", odd["lang"]), items)
    assert got.count() == odd.count()
    assert got.filter("n_words > 0 and n_hit <> n_words").count() == 0  # every text is an item
    assert winnowing.decontaminate(nothing, items).count() == 0
    assert winnowing.decontaminate(odd, items.limit(0)).filter("contaminated or n_items > 0").count() == 0


def test_every_shared_window_shares_a_fingerprint(spark):
    r = random.Random(3)
    text = " ".join(r.choice("abc") for _ in range(400))
    kept = {p for (p,) in winnowing.fingerprints(spark.createDataFrame([(text,)], "text string"), "text", [(10, 5)]).select("p").collect()}
    assert all(any(s <= p < s + winnowing.GRAMS for p in kept) for s in range(391))
    assert len(kept) < 0.5 * 396


def test_the_best_documents(spark, mixed):
    docs, items = mixed
    want = plain(ranking.OP12_SQL, documents=docs.toArrow(), benchmark=items.toArrow())
    for segment, terms in ((8192, 10**6), (16, 60)):
        got = ranking.search(ranking.build_index(docs, segment_docs=segment), items, query_terms=terms).toPandas()
        same(got[["item_id", "rank", "score"]], want[["item_id", "rank", "score"]])
        if segment == 8192:
            fine = ~got.item_id.isna()
            same(got[fine & got.doc_id.notna()], want[~want.item_id.isna() & want.doc_id.notna()])


def test_search_of_odd_tables(spark, odd, nothing):
    queries = odd.selectExpr("doc_id as item_id", "text", "n_chars as rank")
    index = ranking.build_index(odd.withColumn("segment", odd["lang"]).withColumn("term", odd["lang"]))
    got = ranking.search(index, queries, k=3)
    assert got.filter("score <= 0 or rank > 3").count() == 0 and got.filter("item_id = 4 and rank = 1 and doc_id = 4").count() == 1
    assert ranking.search(ranking.build_index(nothing), queries).count() == 0
    assert ranking.search(index, queries.limit(0)).count() == 0


def test_blocks_unpack_and_bound(spark):
    r = np.random.default_rng(5)
    docs = np.sort(r.choice(200_000, 1000, replace=False))
    tf = np.where(r.random(1000) < 0.02, 70_000, r.integers(1, 400, 1000))
    norms = r.integers(75, 3000, 200_000)
    b = ranking.posting_blocks(np.zeros(1000, np.int64), docs, tf, ranking.impacts(tf, norms[docs]))
    ends, data = np.r_[0, b["ends"]], b["payload"].tobytes()
    back = [ranking.unpack(data[x:y], int(f), int(n)) for x, y, f, n in zip(ends, ends[1:], b["first_doc"], b["n"])]
    assert np.array_equal(np.concatenate([d for d, _ in back]), docs) and np.array_equal(np.concatenate([t for _, t in back]), tf)
    assert all(ranking.impacts(t, norms[d]).max() == top for (d, t), top in zip(back, b["top"]))


def test_blocks_below_the_threshold_stay_packed():
    n = 128 * 200
    norms, ids = np.full(n, 100), np.arange(n)
    tf = np.where(np.arange(n) < 128, 9, 1)
    b = ranking.posting_blocks(np.zeros(n, np.int64), np.arange(n), tf, ranking.impacts(tf, norms))
    ends, data = np.r_[0, b["ends"]], b["payload"].tobytes()
    p = ranking.Postings(b["first_doc"], b["last_doc"], b["n"], b["top"], [data[x:y] for x, y in zip(ends, ends[1:])])
    docs, _ = ranking.best([(p, 5)], norms, ids, 20)
    assert docs.tolist() == list(range(20)) and len(p.open) <= 3


def test_terms_are_those_of_the_pattern():
    text = "É. Ab9-x\x00\x7fß q _z [W]"
    assert ranking.tokens(pa.array([None, text, ""]))[1].to_pylist() == ["É", "ab9", "x", "ß q", "z", "w"]


@pytest.mark.parametrize("least", [2, 30])
def test_phrases(spark, mixed, least):
    docs, _ = mixed
    got = collocation.collocations(docs, least=least, most=50).toPandas()
    same(got, plain(collocation.plain_sql(least, 50), documents=docs.toArrow()))
    assert len(got)


def test_phrases_in_small_steps_and_full_filter(spark, mixed):
    docs, _ = mixed
    same(collocation.collocations(docs, least=3, most=20, step=50, bits=1 << 15).toPandas(), plain(collocation.plain_sql(3, 20), documents=docs.toArrow()))


def test_phrases_of_odd_tables(spark, odd, nothing):
    clashing = odd.withColumn("phrase", odd["lang"]).withColumn("m", odd["n_chars"])
    short = "text is null or length(text) < 5000"
    same(collocation.collocations(clashing.filter(short), least=2).toPandas(), plain(collocation.plain_sql(2), documents=odd.filter(short).toArrow()))
    long = collocation.collocations(clashing, least=2).filter("lang = 'de'")  # one piece of 30,000 words
    text = odd.filter("doc_id = 4").first().text
    assert all(r.n == 30_000 and r.a == len(re.findall(rf"(?= {r.phrase} )", f" {text} ")) for r in long.limit(20).collect())
    assert collocation.collocations(nothing, least=1).count() == 0


def test_scores_beyond_64_bits(spark):
    big = spark.range(1).selectExpr("9000000000000L as a", "10000000000000L as n", "9000000000001L as l", "9000000000003L as r")
    exact = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    got = big.selectExpr(f"(1000 * {exact('a')} * {exact('n')}) DIV ({exact('l')} * {exact('r')}) AS s").first()[0]
    assert got == 1000 * 9000000000000 * 10000000000000 // (9000000000001 * 9000000000003)
