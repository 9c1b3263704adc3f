"""Toxicity by a support vector machine over a subsequence string kernel.

The strings are sentences, those of more than ``WORDS`` words in runs of that many, each word
counted once: letters lowered and stripped of accents, other
signs inside a word dropped, digits read as the letters they imitate, and three or more
letters that stand alone joined. Every letter of any script is a sign of one alphabet, in
learning and in scoring alike: Latin letters are 1 to 26, letters of other alphabets a sign
by code point, and characters of scripts with thousands of them two signs each.

The kernel of two sentences counts common subsequences of ``LENGTH`` signs (word borders are
signs) that lie in one word each and span at most ``SPAN``, each gap costing a factor
``DECAY``, a word's part scaled by its own norm - so an insult with letters inserted or set
apart still shares most of its subsequences, and a long sentence does not water it down.
Nystroem features against landmark strings (sentences of one word) make the machine linear:
trained in the primal on squared hinge loss over sentences. As the kernel is a dot product
over subsequences, the machine's landmarks and weights fold exactly into one weight per
subsequence, and scoring a text is a table look-up per subsequence.

Labels are of whole texts, so a text's sentences are a bag: in each round the sentences that
hold the highest words of toxic texts stand for them, and the highest sentences of clean
texts stand against. A text's score is the logistic of its highest sentence and the sum of
positive ones, fitted on sampled texts that the machine was not trained on.

Learning uses at most ``TOXIC`` toxic and ``CLEAN`` other labelled texts, one an id, by hash
of the id, and of them at most ``STAND`` standing words, ``AGAINST`` frequent clean words
and ``SENTENCES`` sentences of either kind. Null and empty texts, and all texts when either
label is missing, score 0. Repeated rows get equal scores; an empty table gives an empty
result.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

LENGTH, SPAN, DECAY, WORDS = 4, 6, 0.5, 8
LANDMARKS, TOXIC, CLEAN, ROUNDS = 360, 1_400, 2_000, 4
STAND, AGAINST, SENTENCES = 3_000, 2_500, 4_000
#: Digits read as letters (fixed values).
IMITATED = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
#: Weight of a made-up spelling beside the word itself.
SPREAD = 0.3
_DROP, _POINTS = 255, 0x110000
#: Signs that end a sentence (fixed values).
_ENDS = np.array([ord(c) for c in ".!?\n\u2026\u3002\uff01\uff1f"], np.uint32)
#: Code points of scripts with a character a word or syllable: [first, last].
_WIDE = ((0x3040, 0xD7FF), (0xF900, 0xFAFF), (0x20000, 0x323AF))


def _signs() -> tuple[np.ndarray, np.ndarray]:
    """First and second sign of each code point: 0 blank (no second sign), 1 to 31 letters, _DROP the rest."""
    first, second = np.full(_POINTS, _DROP, np.uint8), np.zeros(_POINTS, np.uint8)
    for low, high in _WIDE:
        c = np.arange(low, high + 1)
        first[c], second[c] = 1 + c % 31, 1 + c // 31 % 31
    for c in (*range(0x3040), *range(0xFF00, 0xFFF0)):
        ch = chr(c)
        if ch.isspace():
            first[c] = 0
            continue
        base = IMITATED.get(ch) or unicodedata.normalize("NFKD", ch.lower())[:1]
        base = {"ß": "s", "ø": "o", "æ": "a", "œ": "o", "ł": "l", "đ": "d"}.get(base, base)
        if "a" <= base <= "z":
            first[c] = ord(base) - 96
        elif ch.isalpha():
            first[c] = 1 + ord(base) % 31
    return first, second


_FIRST, _SECOND = _signs()
#: Offsets of a subsequence's signs, and its weight.
PATTERNS = [((0, *rest), DECAY ** (rest[-1] - LENGTH + 1)) for rest in itertools.combinations(range(1, SPAN), LENGTH - 1)]
#: Squared norms of words shorter than ``SPAN``; from there on the norm is linear under the root.
_SQUARES = np.array([sum(w * w * max(0, n + 2 - o[-1]) for o, w in PATTERNS) for n in range(SPAN)])
_SLOPE, _START = sum(w * w for _, w in PATTERNS), sum(w * w * (2 - o[-1]) for o, w in PATTERNS)


def _norm(length: np.ndarray) -> np.ndarray:
    """The kernel norm of words of so many signs."""
    return np.sqrt(np.where(length < SPAN, _SQUARES[np.minimum(length, SPAN - 1)], _SLOPE * length + _START).clip(1e-12))


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signs of all texts, 0 before each word and at the end; position of the 0 before each word; its text and sentence.

    Sentences are numbered through all texts; a word that was joined of several is in the sentence of its first.
    """
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sign, second = _FIRST[points], _SECOND[points]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    ended = np.cumsum(np.isin(points, _ENDS))
    kept = np.repeat(np.arange(len(points)), np.where(sign == _DROP, 0, 1 + (second > 0)))
    sign = np.where(np.r_[False, kept[1:] == kept[:-1]], second[kept], sign[kept])
    blank = np.flatnonzero(sign == 0)
    # words between blanks, empty ones left out
    start, stop = np.r_[0, blank[:-1] + 1], blank
    full = stop > start
    start, stop = start[full], stop[full]
    if not len(start):
        return np.zeros(1, np.uint8), *(np.zeros(0, np.int64),) * 3
    text = np.searchsorted(bounds, kept[start], side="right")
    alone = (stop - start) == 1
    run = np.cumsum(np.r_[True, ~(alone[1:] & alone[:-1] & (text[1:] == text[:-1]))]) - 1
    size = np.bincount(run)
    first = np.r_[True, (run[1:] != run[:-1]) | (size[run[1:]] < 3)]  # words that begin a word after joining
    head = np.flatnonzero(first)
    length = np.add.reduceat(stop - start, head)
    at = np.cumsum(length + 1) - length - 1
    out = np.zeros(int(length.sum()) + len(length) + 1, np.uint8)
    letters = np.ones(len(out), bool)
    letters[at] = False
    letters[-1] = False
    out[letters] = sign[sign != 0]
    text, ended = text[head], ended[kept[start[head]]]
    begins = np.r_[True, (text[1:] != text[:-1]) | (ended[1:] != ended[:-1])]
    place = np.arange(len(head)) - np.maximum.accumulate(np.where(begins, np.arange(len(head)), 0))
    return out, at, text, np.cumsum(place % WORDS == 0) - 1


def spell(signs: np.ndarray) -> list[bytes]:
    """The words of a stream, as strings of signs."""
    return [w for w in signs.tobytes().split(b"\0") if w]


def _codes(signs: np.ndarray, at: np.ndarray):
    """For each pattern: codes of the subsequences that begin at each position, 0 where they leave the word."""
    n = len(signs)
    pad = np.zeros(n + SPAN, np.int32)
    pad[:n] = signs
    room = np.full(n, SPAN, np.int8)  # signs up to the blank after the word, SPAN at most
    room[-1] = 0
    ends = np.r_[at[1:], n - 1] if len(at) else at
    for k in range(SPAN, 0, -1):
        p = ends - k
        room[p[p >= at]] = k
    for offsets, weight in PATTERNS:
        code = pad[:n] << 15
        for j, k in enumerate(offsets[1:]):
            code = code | pad[k : k + n] << (10 - 5 * j)
        yield np.where(room >= offsets[-1], code, 0), weight


def word_scores(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The machine's value of each word without the bias, its text and its sentence."""
    signs, at, text, sentence = stream(texts)
    if not len(at):
        return np.zeros(0), text, sentence
    total = np.zeros(len(signs), np.float32)
    for code, weight in _codes(signs, at):
        total += np.float32(weight) * table[code]
    length = np.diff(np.r_[at, len(signs) - 1]) - 1
    return np.add.reduceat(total, at)[: len(at)] / _norm(length), text, sentence


def sentence_scores(texts: list[str], table: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value of each sentence, and its text."""
    value, text, sentence = word_scores(texts, table)
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(sentence) else sentence
    # equal words have equal values: each once a sentence
    value = value.astype(np.float32)
    once = np.unique(sentence << 32 | value.view(np.uint32), return_index=True)[1]
    return np.bincount(sentence[once], weights=value[once], minlength=len(first)) + bias, text[first]


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences of words of signs: number of the word, code, scaled weight."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    signs = np.frombuffer(b"\0" + b"".join(w + b"\0" for w in words), np.uint8)
    at = np.cumsum(length + 1) - length - 1
    of = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(signs)]))
    scale = 1 / _norm(length)
    rows, codes, values = [], [], []
    for code, weight in _codes(signs, at):
        hit = np.flatnonzero(code)
        rows.append(of[hit])
        codes.append(code[hit])
        values.append((weight * scale[of[hit]]).astype(np.float32))
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(values)


def _in_steps(words: list[bytes], step: int = 4000):
    for a in range(0, len(words), step):
        yield a, word_features(words[a : a + step])


def _values(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """Sum of the table over each word's subsequences."""
    out = np.zeros(len(words))
    for a, (row, code, value) in _in_steps(words):
        n = min(4000, len(words) - a)
        out[a : a + n] = np.bincount(row, weights=value * table[code], minlength=n)
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of least |w|^2 / 2 + sum cost * max(0, 1 - y f)^2, by Newton steps."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3
    for _ in range(steps):
        near = y * (x1 @ w) < 1
        a, c = x1[near], cost[near]
        new = np.linalg.solve(np.diag(ridge) + 2 * (a * c[:, None]).T @ a, 2 * a.T @ (c * y[near]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def nystroem(words: list[bytes], strings: tuple[np.ndarray, np.ndarray], y: np.ndarray, share: np.ndarray, landmarks: list[bytes]) -> tuple[np.ndarray, float]:
    """The trained machine folded to a weight per subsequence code, and its bias.

    ``strings``: for each word of a training sentence, the number of the sentence and of the
    word. ``y`` and ``share``: label and weight of each sentence.
    """
    lr, lc, lv = word_features(landmarks)
    codes, inverse = np.unique(lc, return_inverse=True)
    marks = np.zeros((len(landmarks), len(codes)), np.float32)
    np.add.at(marks, (lr, inverse), lv)
    rows, c, v = word_features(words)
    hit = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
    ok = codes[hit] == c
    of_word = np.zeros((len(words), len(landmarks)))
    for a in range(0, len(words), 500):  # dense over the landmarks' codes, some words at a time
        part = ok & (rows >= a) & (rows < a + 500)
        dense = np.zeros((min(500, len(words) - a), len(codes)), np.float32)
        np.add.at(dense, (rows[part] - a, hit[part]), v[part])
        of_word[a : a + 500] = dense @ marks.T
    sentence, word = strings
    order = np.argsort(sentence, kind="stable")
    kernel = np.zeros((len(y), len(landmarks)))
    for s in range(0, len(order), 20_000):  # a sentence's kernel is the sum of its words'
        some = order[s : s + 20_000]
        np.add.at(kernel, sentence[some], of_word[word[some]])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    half = vector[:, good] / np.sqrt(value[good])
    both = np.where(y > 0, share[y > 0].sum(), share[y < 0].sum())
    w, bias = svm(kernel @ half, y, 5.0 * len(y) * share / (2 * both))
    out = np.zeros(1 << 20, np.float32)
    out[codes] = (half @ w) @ marks
    out[0] = 0
    return out, bias


def _gathered(score: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text: highest sentence (-3 without any), log of one plus the sum of positive ones."""
    top, some = np.full(n, -3.0), np.zeros(n)
    np.maximum.at(top, text, score.clip(-3, 6))
    np.add.at(some, text, np.maximum(score - 0.5, 0))
    return np.stack([top, np.minimum(np.log1p(some), 2.0)], axis=1)


class Machine:
    def __init__(self, table: np.ndarray | None = None, bias: float = 0.0, link: np.ndarray | None = None):
        self.table, self.bias, self.link = table, bias, link

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.table is None:
            return np.zeros(len(texts))
        found, text = sentence_scores(texts, self.table, self.bias)
        x = np.c_[_gathered(found, text, len(texts)), np.ones(len(texts))]
        words = np.bincount(text, minlength=len(texts)) > 0
        return np.where(words, 1 / (1 + np.exp(-(x @ self.link).clip(-30, 30))), 0.0)


def train(texts: list[str], toxic: list[bool], rounds: int = ROUNDS, landmarks: int = LANDMARKS) -> Machine:
    """Even-numbered texts of each label train the machine, odd ones the logistic link."""
    label = np.array(toxic, bool)
    order = np.r_[np.flatnonzero(label), np.flatnonzero(~label)]
    own = np.r_[np.arange(label.sum()) % 2 == 0, np.arange((~label).sum()) % 2 == 0]
    if not label.any() or label.all():
        return Machine()
    use, rest = order[own], order[~own] if (~own).any() else order[own]
    y = label[use]
    number: dict = defaultdict(itertools.count().__next__)
    pairs, made = [], 0
    for k, i in enumerate(use):
        signs, at, _, sentence = stream([texts[i]])
        of = np.fromiter(map(number.__getitem__, spell(signs)), np.int64, len(at))
        pairs.append(np.unique(np.stack([np.full(len(of), k), sentence + made, of]), axis=1))
        made += int(sentence[-1]) + 1 if len(sentence) else 0
    words = list(number)
    if not words:
        return Machine()
    text_of, sentence_of, word_of = np.concatenate(pairs, axis=1)
    first = np.unique(sentence_of, return_index=True)[1]
    text_of_sentence = text_of[first]
    text, word = np.unique(np.stack([text_of, word_of]), axis=1)  # each word once a text
    in_toxic = np.bincount(word[y[text]], minlength=len(words))
    in_clean = np.bincount(word[~y[text]], minlength=len(words))
    # first guess: log odds of plain subsequences by the words that hold them
    share = lambda n, total: np.log((n + 0.5) / (total + 1.0))
    holds = np.zeros((2, 1 << 20))
    for a, (row, code, _) in _in_steps(words):
        for k, seen in enumerate((in_toxic, in_clean)):
            holds[k] += np.bincount(code, weights=seen[a + row] > 0, minlength=1 << 20)
    odds = (share(holds[0], (in_toxic > 0).sum()) - share(holds[1], (in_clean > 0).sum())).astype(np.float32)
    guess = _values(words, odds)
    guess += 0.5 * (share(in_toxic, y.sum()) - share(in_clean, (~y).sum())) * (in_toxic > 1)
    rng = np.random.default_rng(3)
    against = np.flatnonzero(in_clean > 0)
    # most frequent clean words and some others; the highest of each round stay
    no = np.r_[against[np.argsort(-in_clean[against], kind="stable")[:AGAINST]], rng.choice(against, min(len(against), AGAINST * 3 // 5), replace=False)] if len(against) else against
    clean_sentences = np.flatnonzero(~y[text_of_sentence])
    machine, bias = np.zeros(1 << 20, np.float32), 0.0
    for turn in range(rounds):
        value_of = guess[word]
        # the highest words of each toxic text, those of one text at most as many as stand out
        o = np.lexsort((-value_of, text))
        place = np.arange(len(o)) - np.searchsorted(text[o], text[o])
        pick = o[(place < 3) & y[text[o]] & (in_clean[word[o]] == 0)]
        standing = np.bincount(word[pick], minlength=len(words))
        for_ = np.flatnonzero(standing > 0)
        if not len(for_) or not len(no):
            return Machine()
        least = next(n for n in (8, 5, 3, 2, 1) if n == 1 or (in_toxic[for_] >= n).sum() >= 10)
        for_ = for_[in_toxic[for_] >= least]  # words of few texts stand out by chance
        no = np.unique(np.r_[no, against[np.argsort(-guess[against], kind="stable")[: AGAINST * 3 // 5]]])
        if len(for_) > STAND:
            for_ = for_[np.argsort(-in_toxic[for_], kind="stable")[:STAND]]
        # sentences of toxic texts that hold such a word; of clean ones the highest, and some others
        stands = np.zeros(len(words), bool)
        stands[for_] = True
        total = np.bincount(sentence_of, weights=guess[word_of] - bias, minlength=made)
        yes = np.unique(sentence_of[stands[word_of] & y[text_of]])
        yes = np.sort(yes[np.argsort(-total[yes], kind="stable")[:SENTENCES]])
        low = clean_sentences[np.argsort(-total[clean_sentences], kind="stable")[: SENTENCES // 2]]
        low = np.unique(np.r_[low, rng.choice(clean_sentences, min(len(clean_sentences), SENTENCES // 2), replace=False)])
        # words as sentences of one word: those that stand out, and clean ones
        share_of = np.sqrt(np.r_[in_toxic[for_], in_clean[no]])
        # landmarks: frequent toxic words, the clean words that the last round took for toxic, some others
        near = no[np.argsort(-guess[no] * np.sqrt(in_clean[no]) * (guess[no] > -0.5), kind="stable")[: landmarks // 3]]
        marks = np.unique(np.r_[for_[np.argsort(-in_toxic[for_], kind="stable")[: landmarks // 2]], near, rng.choice(no, min(len(no), landmarks // 6), replace=False)])
        # an insult with a letter put in is one too
        spread = [(w[:k] + bytes([rng.integers(1, 27)]) + w[k:], s) for w, s in zip((words[i] for i in for_), share_of) if len(w) > 4 for k in (len(w) // 2, len(w) // 2 - 1)]
        spread = [(w, s) for w, s in spread if w not in number]
        inside = np.isin(sentence_of, np.r_[yes, low])
        named = np.unique(np.r_[word_of[inside], for_, no])
        place_of = np.zeros(len(words), np.int64)
        place_of[named] = np.arange(len(named))
        whole = np.r_[yes, low]
        row_of = np.zeros(made, np.int64)
        row_of[whole] = np.arange(len(whole))
        singles = len(whole) + np.arange(len(for_) + len(no) + len(spread))
        rows = np.r_[row_of[sentence_of[inside]], singles]
        columns = np.r_[place_of[word_of[inside]], place_of[for_], place_of[no], len(named) + np.arange(len(spread))]
        sign = np.r_[np.ones(len(yes)), -np.ones(len(low)), np.ones(len(for_)), -np.ones(len(no)), np.ones(len(spread))]
        weight = np.r_[np.ones(len(whole)), share_of, [SPREAD * s for _, s in spread]]
        machine, bias = nystroem([words[i] for i in named] + [w for w, _ in spread], (rows, columns), sign, weight, [words[i] for i in marks])
        guess = _values(words, machine) + bias
    x = np.concatenate([_gathered(*sentence_scores([texts[i]], machine, bias), 1) for i in rest])
    z = label[rest].astype(float)
    link = logistic(x, z)
    if link[0] < 0:  # a higher highest sentence never makes a text less toxic
        link = np.r_[0.0, logistic(x[:, 1:], z)]
    return Machine(machine, bias, link)


def logistic(x: np.ndarray, z: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x1, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x1 @ w).clip(-30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w)), x1.T @ (z - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Machine:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) of the rows that may be learned from."""
    one = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("doc_id", F.lit("toxicity"))
    some = one.filter("toxic = 1").orderBy(draw).limit(TOXIC).union(one.filter("toxic <> 1").orderBy(draw).limit(CLEAN))
    # one text an id: the least; at most TOXIC + CLEAN rows
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    return train([r[1] for r in rows], [r[2] == 1 for r in rows])


def score_toxicity(df: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(machine)
    schema = f"`{key}` {dict(df.dtypes)[key]}, score double"
    return map_texts(df.select(key, text), lambda batch, texts: {"score": shared.value.scores(texts)}, schema, text)


def op1_subsequence_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lambda: F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    machine = fit_toxicity(docs.filter(~held()), table(spark, sf_dir, "labels").filter(~held()))
    return score_toxicity(docs, machine).select("doc_id", held().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
