"""Repetition rules, personal data and piece encoding against plain versions."""

import hashlib
import random
import time
import re

import numpy as np
import public_tokenizers
import pytest

from helixframe.llm import personal, pieces, repetition

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _plain_repeats(words):
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_longest_repeats_and_counts():
    r = random.Random(1)
    texts = [" ".join(r.choice("abc") for _ in range(n)) for n in (0, 1, 2, 9, 40, 61)] + ["x y z " * 30, "a b c d e f g h\na b c d e f g h\n\n \nq"]
    m = repetition.measure(texts, min_words=4)
    for k, t in enumerate(texts):
        w = t.split()
        longest = _plain_repeats(w)
        cover = lambda least, fixed: {p for i, n in enumerate(longest) if n >= least for p in range(i, i + (fixed or n))}
        assert (m["n_words"][k], m["longest_repeat"][k]) == (len(w), max(longest, default=0))
        assert (m["n_covered_words"][k], m["n_repeat_words"][k]) == (len(cover(4, 0)), len(cover(3, 3)))
    assert m["n_dup_lines"][-1] == 1 and m["word_chars"][-1] == 17


def test_words_are_cut_at_ascii_blanks_only():
    m = repetition.measure(["é a\x1cb c\v#|d", ""])
    assert m["n_words"].tolist() == [4, 0] and m["n_symbols"].tolist() == [2, 0] and m["word_chars"].tolist() == [8, 0]


def test_repetition_of_odd_rows(odd, nothing):
    got = repetition.score_repetition(odd).collect()
    assert len(got) == 10 and {r.doc_id for r in got if r.n_words == 0} == {1, 2} and all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    kept = repetition.filter_repetition(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 3, 4, 7, 8]
    assert repetition.filter_repetition(nothing).count() == 0


def _plain_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or personal.luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], personal.KINDS.index(s[0])))


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(7)
    for _ in range(4000):
        t = "".join(r.choice("ab1234@.+- ()%é0") for _ in range(r.randint(0, 60)))
        assert personal.base_spans(t) == _plain_base(t)
    for t in ("+1 (136) 555-7479 4111 1111 1111 1111 1.2.3.4.5.6.7.8 a@b.c@d.e.f", "a@b@c.d", "9" * 3000, "x" * 5000 + "@"):
        assert personal.base_spans(t) == _plain_base(t)


def test_parts_of_any_length():
    assert personal.base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)] and personal.base_spans("9" * 5000 + ".2.3.4") == []
    assert personal.find("[.]".join(["9" * 5000, "1", "2", "3"]), personal.trained()) == ([], [])


def test_segment_marginals_match_enumeration():
    text = "call 4111111111111111 4111111111111111 now"
    field = personal.Field({"card: bias": 0.3, "phone: bias": -0.2, "card: checksum holds": 0.7})
    (a, b), = personal.islands(text)
    tokens, segments = personal.candidates(text, a, b)
    scores = [field.score(s[3]) for s in segments]

    def walks(at):
        if at == len(tokens):
            yield 0.0, ()
            return
        for x, used in walks(at + 1):
            yield x, used
        for k, (i, j, _, _) in enumerate(segments):
            if i == at:
                for x, used in walks(j):
                    yield x + scores[k], (k, *used)

    every = list(walks(0))
    z = sum(np.exp(x) for x, _ in every)
    for k, p in enumerate(field.marginals(len(tokens), segments)):
        assert abs(p - sum(np.exp(x) for x, used in every if k in used) / z) < 1e-9
    assert max(every)[0] == sum(scores[k] for k in field.decode(len(tokens), segments))


def test_field_on_held_out_sentences():
    field, hit, found, true = personal.trained(), 0, 0, 0
    for text, spans in personal.examples(200, 77):
        got = set(personal.find(text, field)[1])
        hit, found, true = hit + len(got & set(spans)), found + len(got), true + len(spans)
    assert hit / found > 0.9 and hit / true > 0.9
    plain = "A clean text of 2019, version 3.0.1, with 12 items at 4.50 each and page 117."
    assert personal.find(plain, field) == ([], [])


def test_written_out_addresses_do_not_depend_on_far_text():
    field, r = personal.trained(), random.Random(9)
    for t in ("write to john at example[.]com", "mail john at example.com", "john aT example dOt com", "john [aT] example.com", "john <At> example(.)com"):
        found = personal.find(t, field)[1]
        assert [k for k, _, _ in found] == ["email"] and t[found[0][1] : found[0][2]].startswith("john")
        assert [s for s in personal.find(t + "; an anecdote. @", field)[1]] == found
    for t in ("12 items at 4.50 each", "they met at 9.30pm", "held at U.S. ports", "we stayed at home.Then we left", "look at this. Dot by dot", "40 at 10.0.0.1 or so"):
        assert not any(k == "email" for k, _, _ in personal.find(t, field)[1])
    for _ in range(4000):
        t = "".join(r.choice(["a", "b1", " ", " at ", "\tAT\n", "[aT]", "@", ".", "[.]", " dOt ", "(DOT)", "; "]) for _ in range(r.randint(0, 14)))
        every = [m.span() for m in personal._ADDRESS.finditer(t)]
        assert all(any(a <= s and e <= b for a, b in personal.islands(t)) for s, e in every)


def test_personal_data_of_odd_rows(odd, nothing):
    got = personal.find_personal(odd).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 10 and all(r.base_sha256 == empty and r.spans == "" for r in got)
    masked = personal.mask_personal(odd)
    assert masked.columns == odd.columns and masked.filter("text is null").count() == 1
    assert personal.find_personal(nothing).count() == 0
    text = "mail a@b.com or +1 (136) 555-7479."
    assert personal.masked(text, personal.find(text, personal.trained())[1]) == "mail <EMAIL> or <PHONE>."


def _walked(text):
    """Normalised bytes and their source bytes, one character after another, for a model with an empty map."""
    out, source, at = bytearray(), [], 0
    for c in " " + text if text else "":
        put, n = (pieces.MARK if c == " " else c).encode(), len(c.encode())
        out += put
        first = at == 0 and len(source) == 0
        source += [at] * len(put) if c == " " else range(at, at + n)
        at += 0 if first else n
    return bytes(out), [*source, len(text.encode())]


def test_pieces_are_the_library_s_with_exact_spans(odd, nothing):
    m = pieces.model(PIECES)
    texts = ["", " ", "  a  b ", "a", "é ñ 漢字", "tab\there\n\nline ", "▁x▁▁ y", "a b  c   d", "\x00", "ﬁ Ａ", "word " * 50]
    for t, (ids, spans) in zip(texts, m.encode(texts)):
        assert ids.tolist() == m.library.encode(t, add_bos=True, add_eos=True)
        raw, source = m.normalise(t)
        assert (raw, source.tolist()) == _walked(t)
        assert spans[:, 1].tolist() == source[np.cumsum(m.length[ids])].tolist()
        assert spans[0, 0] == 0 and spans[-1, 1] == len(t.encode()) and (spans[1:, 0] == spans[:-1, 1]).all()
    got = pieces.digest_pieces(odd, PIECES).collect()
    assert len(got) == 10 and {r.doc_id for r in got if r.n_tokens == 2} == {1, 2}
    assert pieces.encode_pieces(odd, PIECES).filter("doc_id = 7").first().decoded == odd.filter("doc_id = 7").first().text
    assert pieces.digest_pieces(nothing, PIECES).count() == 0


def test_chunks_and_whole_texts_give_the_same_pieces(monkeypatch):
    m, r = pieces.model(PIECES), random.Random(10)
    texts = ["".join(r.choice(["a", "the", " ", "  ", "é", "漢", "\n", "\x00", "😀", "word", "ﬁ", ".", "▁"]) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    assert m.separable and not m.map.units
    apart = m.encode(texts)
    monkeypatch.setattr(m, "separable", False)
    for (ids, spans), (want, spans2), library in zip(apart, m.encode(texts), m.library.encode(texts, add_bos=True, add_eos=True)):
        assert ids.tolist() == want.tolist() == library and (spans == spans2).all()


def test_normalisation_with_a_map_and_joined_blanks():
    m = pieces.PieceModel(PIECES)
    m.map = pieces.CharacterMap(_compiled({b"a": b"1", b"abc": b"two words", "é".encode(): b"e", b"x": b""}))
    raw, source = m.normalise("abcd éax")
    assert raw.decode() == "▁two▁wordsd▁e1" and source[-1] == len("abcd éax".encode())
    assert source.tolist()[:3] == [0, 0, 0] and source.tolist()[3:18] == [0] * 11 + [3, 4, 4, 4] and source.tolist()[-3:] == [5, 7, 9]
    m.map, m.collapse = pieces.CharacterMap(b""), True
    raw, source = m.normalise("  a   b ")
    assert raw.decode() == "▁a▁b" and source.tolist() == [0, 0, 0, 2, 3, 3, 3, 6, 8]
    assert m.normalise("   ")[0] == b""


def _compiled(pairs):
    """A double array with one unit a state, offsets chosen by first fit."""
    import struct

    values, at = b"", {}
    for k, v in pairs.items():
        at[k] = len(values)
        values += v + b"\0"
    units, taken, bases = {0: 0}, {0}, set()

    def place(prefix, node):
        nxt = sorted({k[len(prefix)] for k in pairs if k.startswith(prefix) and len(k) > len(prefix)})
        labels = ([0] if prefix in pairs else []) + nxt
        base = next(b for b in range(1, 4096) if node ^ b not in bases and all((node ^ b ^ c) not in taken for c in labels))
        bases.add(node ^ base)
        taken.update(node ^ base ^ c for c in labels)
        units[node] |= base << 10 | (0x100 if prefix in pairs else 0)
        if prefix in pairs:
            units[node ^ base] = 1 << 31 | at[prefix]
        for c in nxt:
            units[node ^ base ^ c] = c
            place(prefix + bytes([c]), node ^ base ^ c)

    place(b"", 0)
    flat = [units.get(k, 0) for k in range(max(units) + 1)]
    return struct.pack("<I", 4 * len(flat)) + struct.pack(f"<{len(flat)}I", *flat) + values


def test_character_map_takes_the_longest_prefix():
    made = pieces.CharacterMap(_compiled({b"a": b"1", b"abc": b"2", "é".encode(): b"e"}))
    assert made.longest(b"abd", 0) == (1, b"1") and made.longest(b"xabcd", 1) == (3, b"2")
    assert made.longest("é".encode(), 0) == (2, b"e") and made.longest(b"z", 0) is None
    assert np.flatnonzero(made.begins).tolist() == [ord("a"), "é".encode()[0]]


@pytest.mark.parametrize("unit", ["1.", "1 ", "(1)", "a@b.c1 ", "1.1.1.1 "])
def test_personal_time_grows_with_the_text(unit):
    field = personal.trained()
    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        base, both = personal.find(unit * (n // len(unit)), field)
        took.append(time.process_time() - began)
        assert set(base) <= set(both)
    assert took[1] < 20 * took[0] + 1  # eight times the text


def test_spans_touch_only_what_they_share_a_sign_with():
    r = random.Random(8)
    for _ in range(200):
        spans = sorted((("ip", a, a + r.randint(1, 6)) for a in (r.randint(0, 40) for _ in range(r.randint(0, 6)))), key=lambda s: s[1])
        taken = personal.Taken(spans)
        for a in range(45):
            for b in range(a + 1, 47):
                assert taken.touches(a, b) == any(a < e and s < b for _, s, e in spans)
