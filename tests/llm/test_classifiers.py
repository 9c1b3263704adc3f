"""Toxicity, language identification and importance resampling."""

import math
import random

import numpy as np

from helixframe.llm import language, resampling, toxicity


def test_subsequence_kernel_is_a_dot_product_of_gapped_subsequences():
    def feature_map(word):
        s, out = [0, *[ord(c) - 96 for c in word], 0], {}
        for i in range(len(s)):
            for offsets, weight in toxicity.PATTERNS:
                if i + offsets[-1] < len(s):
                    u = tuple(s[i + k] for k in offsets)
                    out[u] = out.get(u, 0) + weight
        n = math.sqrt(sum(w * w * max(0, len(s) - o[-1]) for o, w in toxicity.PATTERNS))
        return {u: v / n for u, v in out.items()}

    words = ["idiot", "idxiot", "banana", "abc", "scum"]
    rows, codes, values = toxicity.word_features([bytes(ord(c) - 96 for c in w) for w in words])
    for k, w in enumerate(words):
        got = {}
        for c, v in zip(codes[rows == k], values[rows == k]):
            u = tuple(int(c) >> s & 31 for s in (15, 10, 5, 0))
            got[u] = got.get(u, 0) + float(v)
        want = feature_map(w)
        assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-5 for u in want)


def test_norm_of_a_word_of_any_length():
    lengths = [1, 2, 3, toxicity.SPAN - 1, toxicity.SPAN, 100, 4095, 4096, 50_000]
    for n in lengths:
        want = math.sqrt(max(1e-12, sum(w * w * max(0, n + 2 - o[-1]) for o, w in toxicity.PATTERNS)))
        assert abs(float(toxicity._norm(np.array([n]))[0]) / want - 1) < 1e-12
    table = np.ones(1 << 20, np.float32)
    values = [float(toxicity.word_scores(["ab" * n], table)[0][0]) / math.sqrt(n) for n in (1000, 2000, 20_000)]
    assert max(values) / min(values) < 1.01  # grows with the root of the length


def test_signs_are_the_same_in_learning_and_scoring():
    texts = ["Idiot, ID-IOT! i d i o t", "дурак Дурак", "笨蛋 한국", "a½b ² 😀", "", "x. y"]
    signs, at, text, sentence = toxicity.stream(texts)
    words = toxicity.spell(signs)
    assert len(words) == len(at) == len(text) and words[0] == words[1] == words[2] == bytes(ord(c) - 96 for c in "idiot")
    assert words[3] == words[4] and len(words[3]) == 5 and len(set(words[3])) > 3 and len(words[5]) == len(words[6]) == 4
    assert sentence.tolist() == [0, 0, 1, 2, 2, 3, 3, 4, 5, 6] and text.tolist() == [0, 0, 0, 1, 1, 2, 2, 3, 5, 5]
    again, *_ = toxicity.stream([" ".join(texts)])
    assert toxicity.spell(again)[3] == words[3]
    rows, codes, _ = toxicity.word_features(words[5:7])
    assert all(codes > 0) and not set(codes[rows == 0]) & set(codes[rows == 1])


def test_sentence_scores_are_sums_over_distinct_words():
    r = np.random.default_rng(2)
    table = r.standard_normal(1 << 20).astype(np.float32)
    table[0] = 0
    value, _, _ = toxicity.word_scores(["idiot banana scum"], table)
    got, text = toxicity.sentence_scores(["idiot banana idiot. scum", "banana " * (toxicity.WORDS + 1)], table, 0.5)
    assert np.allclose(got, [value[:2].sum() + 0.5, value[2] + 0.5, value[1] + 0.5, value[1] + 0.5], atol=1e-5) and text.tolist() == [0, 0, 1, 1]


def test_insults_of_other_scripts_are_learned_and_found():
    r = random.Random(4)
    for letters, insults in (("абвгдежзиклмнопрст", ["дурак", "болван"]), ("的一是不了在人有我他这中大来上国", ["笨蛋傻瓜", "白痴废物"])):
        plain = ["".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(300)]
        text = lambda bad: " ".join(r.choice(insults) if bad and k % 20 == 7 else r.choice(plain) for k in range(60))
        machine = toxicity.train([text(k % 2) for k in range(240)], [bool(k % 2) for k in range(240)])
        fresh = [text(k % 2) for k in range(60)]
        assert ((machine.scores(fresh) >= 0.7) == np.array([bool(k % 2) for k in range(60)])).all()
        planted = [" ".join([*plain[:5], insults[0][:2] + letters[0] + insults[0][2:], *plain[5:9]])]  # a sign put in
        assert machine.scores(planted)[0] > machine.scores([" ".join(plain[:9])])[0]


def _insulting(n, seed):
    r = random.Random(seed)
    plain = ["".join(r.choice("aeiounrst") for _ in range(r.randint(3, 8))) for _ in range(300)]
    texts, toxic = [], []
    for k in range(n):
        w = [r.choice(plain) for _ in range(60)]
        if k % 2:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["blockhead", "dimwit", "klutz", "fizzbug"])
        texts.append(" ".join(w) + ".")
        toxic.append(bool(k % 2))
    return texts, toxic


def test_toxicity_is_learned_and_tolerates_gaps_and_insertions():
    machine = toxicity.train(*_insulting(240, 1))
    texts, toxic = _insulting(80, 1)
    assert ((machine.scores(texts) >= 0.7) == np.array(toxic)).all()
    of = lambda t: toxicity.sentence_scores([t], machine.table, machine.bias)[0].max()
    assert min(of("b l o c k h e a d"), of("d-i-m-w-i-t"), of("blockxhead"), of("BLOCKHEAD")) > of("nearest")
    assert machine.scores(["", "..."]).tolist() == [0.0, 0.0] and toxicity.Machine().scores(["x"]).tolist() == [0.0]


def test_toxicity_of_odd_rows(spark, odd, nothing):
    machine = toxicity.train(*_insulting(60, 1))
    got = toxicity.score_toxicity(odd, machine).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert toxicity.score_toxicity(nothing, machine).count() == 0
    labels = spark.createDataFrame([(3, 1), (None, 0), (8, None)], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(odd, labels).table is None  # one label only


def test_code_lengths_are_those_of_a_plain_context_tree():
    texts = {"x": ["abracadabra", "abba"], "y": ["xyzzy"]}
    trees = language.ContextTrees(texts, order=2)

    def bits(lang, text):
        counts = {}
        for t in texts[lang]:
            b = b"\0\0" + t.encode()
            for i in range(2, len(b)):
                for k in range(3):
                    counts.setdefault(b[i - k : i], {}).setdefault(b[i], 0)
                    counts[b[i - k : i]][b[i]] += 1
        b, total = b"\0\0" + text.encode(), 0.0
        for i in range(2, len(b)):
            p = 1.0
            for k in (2, 1, 0):
                seen = counts.get(b[i - k : i])
                if seen is None:
                    continue
                n, d = sum(seen.values()), len(seen)
                if b[i] in seen:
                    p *= seen[b[i]] / (n + d)
                    break
                p *= d / (n + d)
            else:
                p /= 256
            total -= math.log2(p)
        return total

    for t in ("abra", "zebra", "", "xyzz abb"):
        got = trees.code_lengths([t])[0]
        assert np.allclose(got, [bits("x", t), bits("y", t)])


def test_languages_of_odd_rows(spark, odd, nothing):
    trees = language.fit_languages(odd)
    got = {(r.doc_id, r.lang_pred): r.score for r in language.identify(odd, trees).collect()}
    assert got[1, "und"] == got[2, "und"] == got[5, "und"] == 0.0
    assert all(0 < s <= 1 for (_, lang), s in got.items() if lang != "und")
    assert {r.lang_pred for r in language.identify(odd, language.fit_languages(nothing)).collect()} == {"und"}
    assert language.identify(nothing, trees).count() == 0


def test_nothing_learned_and_signs_that_are_no_letters(spark):
    trees = language.ContextTrees({"x": ["", ""], "y": []})
    assert trees.predict(["abc", ""]) [0] == ["und", "und"]
    assert language.ContextTrees({"x": ["ab"], "y": [""]}).languages == ["x"]
    known = language.ContextTrees({"x": ["abc"]})
    assert known.predict(["½", "²", "1_2", "a", "é"])[0] == ["und", "und", "und", "x", "x"]
    assert language.ContextTrees({"x": ["a"]}).code_lengths(["a", "zz"]).shape == (2, 1)
    rows = [(1, "same text", "a")] * 300 + [(k, f"other {k}", "b") for k in range(300)] + [(9, "", "c"), (None, "eine", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert language.fit_languages(docs, per_language=5).languages == ["a", "b", "d"]  # copies neither vanish nor pile up
    assert language.fit_languages(docs, per_language=5, languages=2).languages == ["a", "b"]


def test_kth_largest_is_exact(spark):
    r = random.Random(2)
    values = [r.gauss(0, 1) for _ in range(500)] + [0.25] * 50
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 17, 300, 550):
        assert resampling.kth_largest(df, "x", k, collect=10, bins=7) == sorted(values, reverse=True)[k - 1]


def test_weights_are_log_ratios_of_hashed_counts():
    target, raw = ["the cat", "the dog"], ["the cat", "the dog", "%%% %%%", "@@ @@"]
    ratio = resampling.Ratio.of(sum(map(resampling.counts, target)), sum(map(resampling.counts, raw)))
    assert ratio.weight("the cat") > 0 > ratio.weight("%%% %%%") and ratio.weight("") == -np.inf
    c = resampling.counts("the cat")
    assert abs(ratio.weight("the cat") - (c * ratio.log).sum()) < 1e-9


def test_resampling_keeps_clean_and_drops_junk(spark, words):
    r = random.Random(3)
    clean = [(k, " ".join(r.choice(words) for _ in range(60)), 1) for k in range(60)]
    junk = [(100 + k, "### ".join(r.choice(words).upper() for _ in range(60)), 0) for k in range(12)]
    docs = spark.createDataFrame([x[:2] for x in clean + junk], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in clean[::2] + junk[::2]], "doc_id long, quality int")
    assert {x.doc_id for x in resampling.keep_resampled(spark, docs, labels).collect()} == set(range(60))


def test_resampling_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (8, None)], "doc_id long, quality int")
    for given in (labels, labels.filter("doc_id = -1")):
        kept = resampling.keep_resampled(spark, odd, given)
        assert kept.columns == odd.columns and kept.filter("text is null or text = ''").count() == 0
    assert resampling.keep_resampled(spark, odd, labels.filter("doc_id = -1")).count() == 8
    assert resampling.keep_resampled(spark, nothing, labels).count() == 0
