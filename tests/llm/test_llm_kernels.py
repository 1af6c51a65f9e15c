"""The operators' kernels against plain versions, without Spark."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import decontaminate, language_id, packing, quality_classifier, secrets_scan
from helixframe.llm.tokenizers import tokenizer_path
from helixframe.llm.wordhash import shingle_sets

TEXTS = ["", " \n", "a", "a b", "A b c a B c d", "é\x0bÉ x\ty", "one  two\r\nthree" * 3, "x" * 5000 + " y z", None, "a b c d e f g h"]


def test_shingles_count_like_sets():
    for size in (1, 3, 5):
        for text, found in zip(TEXTS, shingle_sets(pa.array(TEXTS), size), strict=True):
            w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
            want = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
            assert len(found) == len(want)
    a, b = shingle_sets(pa.array(["p q r s", "P q R s"]), 3)
    assert (a == b).all()


def test_windows_against_a_loop():
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "dé", "7"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 4, 14, 20])).encode()) for k in range(12)] + [(50, b"..."), (51, b"")]
    for window in (3, 5, 13):
        finder = decontaminate.WindowSearch(items, window=window)
        for _ in range(60):
            doc = decontaminate.words((text(rng.randint(0, 40)) + "; A-B").encode())
            spans, ids = finder.hits(doc)
            hit, owners = set(), set()
            for k, t in items:
                w = decontaminate.words(t)
                size = min(window, len(w))
                for p in {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if size else ():
                    for at in range(len(doc) - size + 1):
                        if tuple(doc[at : at + size]) == p:
                            hit.update(range(at, at + size))
                            owners.add(k)
            assert {p for a, b in decontaminate.covered(spans) for p in range(a, b)} == hit and ids == owners


def test_words_are_the_contract_s():
    text = "Ab-C 9x é z _q/ \x7f\x00w"
    want = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))]
    assert decontaminate.words(text.encode()) == want


def test_sum_of_squares_places_each_once():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(600)]
    placed, offsets = packing.sum_of_squares(lengths, 100)
    fill = {}
    for s, b, o in zip(lengths, placed, offsets, strict=True):
        assert fill.get(b, 0) == o
        fill[b] = o + s
    assert max(fill.values()) <= 100
    assert len(fill) <= 1.1 * -(-sum(lengths) // 100)
    counts, bins = {}, {}
    for s, b in zip(lengths, placed, strict=True):  # each choice is a least sum of squares
        gap = bins.get(b, 100)

        def total(g, counts=counts, s=s):
            c = dict(counts)
            if g < 100:
                c[g] -= 1
            if g > s:
                c[g - s] = c.get(g - s, 0) + 1
            return sum(v * v for v in c.values())

        options = [g for g, v in counts.items() if v and g >= s] + [100]
        assert total(gap) == min(map(total, options))
        if gap < 100:
            counts[gap] -= 1
        bins[b] = gap - s
        if gap > s:
            counts[gap - s] = counts.get(gap - s, 0) + 1


def test_memo_gives_the_tokenizer_s_ids():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["", " ", "Hello, WORLD!! it's a b2b été İx \x0b tab\tend.", "x" * 300, "a b  c", "don't. 'll 'S ... 12,5 ñandú"]
    tokens = packing.WordTokens(path)
    for _ in range(2):
        for text, got in zip(texts, tokens.ids([t.encode() for t in texts]), strict=True):
            assert got == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_memo_on_random_strings():
    """10,000 strings of letters that change in lower case, marks, digits, scripts and control strings."""
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain, tokens = Tokenizer.from_file(path), packing.WordTokens(path)
    rng = random.Random(6)
    bits = [*"aBéÉİıǅǆßẞſΣςσЖжÅΩ中あ가ª²½\u0301\u0307\u0308\u200d\u00a0\u3000\x1c\x85", "'s", "'LL", *".,;:!?&%$*#|<>'\"", *"0123", " ", " ", "\t", "\n", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "hello", "WORLD"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(10_000)]
    got = tokens.ids([t.encode() for t in texts])
    wrong = [t for t, g, m in zip(texts, got, plain.encode_batch(texts, add_special_tokens=False), strict=True) if g != np.array(m.ids, "<u4").tobytes()]
    assert not wrong, wrong[:5]
    assert np.frombuffer(tokens.ids([b"a <|endoftext|> b"])[0], "<u4").tolist() == [320, 49407, 321]


def test_ids_of_a_column_are_the_tokenizer_s(monkeypatch):
    """Random texts, nulls and slices of columns, with a memo that forgets words all the time."""
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(8)
    bits = [*"aBéÉİıǅßſΣЖ中ª²\u0301\u0307\u00a0\u3000\x1c\x85", "'s", *".,;:!?&%$*#|<>'", "7", " ", "  ", "\t", "\n", "\x0b", "\0", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "hello", "WORLD"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 20))) for _ in range(3000)]
    texts[::50] = [None] * 60
    want = [np.array(m.ids, "<u4").tobytes() for m in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for size in (60, packing.MEMO_WORDS):
        monkeypatch.setattr(packing, "MEMO_WORDS", size)
        tokens = packing.WordTokens(path)
        for kind in (pa.string(), pa.large_string()):
            column, got = pa.array([*texts, "left out"], kind)[:-1], []
            for first, part in packing._slices(column, 300):
                assert first == len(got)
                data, bounds = tokens.column_ids(part)
                got += [bytes(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            assert got == want
    for column in (pa.array([], pa.string()), pa.array([None, "", " \n"], pa.string())):
        assert tokens.column_ids(column)[1].tolist() == [0] * (len(column) + 1)


def test_letters_are_spelled_once_whatever_marks_follow():
    tokens, asked = packing.WordTokens(tokenizer_path("word_bpe_49k.json")), []
    learn = tokens._learn
    tokens._learn = lambda new: (asked.extend(new), learn(new))
    for text in ("one two, One. TWO!! été", "ÉTÉ one,%%% été? two. three,"):
        tokens.column_ids(pa.array([text, text]))
    assert sorted(asked) == sorted(w.encode() for w in ["", "one", "two", ",", ".", "!!", "été", "ÉtÉ", ",%%%", "?", "three"])


def test_suffix_automaton_holds_all_substrings_and_no_other():
    rng = random.Random(3)
    text = [rng.randint(1, 3) for _ in range(60)]
    table = language_id.suffix_automaton(text, 4).reshape(-1, 4)
    held = {tuple(text[a:b]) for a in range(60) for b in range(a, 61)}
    for _ in range(2000):
        word = tuple(rng.randint(1, 3) for _ in range(rng.randint(1, 7)))
        state = 0
        for c in word:
            state = table[state, c] if state >= 0 else -1
        assert (state >= 0) == (word in held)


def test_phrases_against_a_greedy_parse():
    rng = random.Random(4)
    make = lambda letters, n: np.array([ord(rng.choice(letters)) for _ in range(n)], np.uint32)
    samples = {"x": [make("abc", 80)], "y": [make("acd", 80)]}
    parser = language_id.CrossParser(samples, {})
    for _ in range(30):
        text = make("abcdq", rng.randint(1, 600))
        rate, size = next(parser.rates([text]))
        for k, name in enumerate(parser.languages):
            sample = "".join(map(chr, samples[name][0])) + " "
            count = 0
            for at in range(0, size, language_id.BLOCK):
                part = "".join(map(chr, text[at : at + language_id.BLOCK]))
                held = ""
                for c in part:
                    if held + c in sample:
                        held += c
                    else:
                        count += 1
                        held = c if c in sample else ""
                count += 1
            assert rate[k] == pytest.approx(count / size / parser.base[k])


def test_languages_of_letterless_texts():
    parser = language_id.CrossParser({"x": [language_id.folded("hello there my friend")]}, {})
    assert list(parser.judged([language_id.folded("12 .;"), language_id.folded("")])) == [("und", 0.0)] * 2


def test_secret_spans_against_the_patterns():
    efficiency = secrets_scan.TokenEfficiency(tokenizer_path("byte_bpe_50k.tiktoken"))
    key = "aB3dE5gH7jK9mN2pQ4rS6tU8"
    text = f'é PASSWORD = "hunter2x9" token:short AKIA{"A1" * 8} {"0f" * 20} {key} {"word" * 8} 123e4567-e89b-12d3-a456-426614174000'
    kinds = [secrets_scan.KINDS[k] for _, k, _ in secrets_scan.spans(text, efficiency)]
    assert kinds == ["assign", "access", "hex", "token"]
    a, k, b = secrets_scan.spans(text, efficiency)[3]
    assert text[a:b] == key
    assert secrets_scan.spans("", efficiency) == []
    rng = random.Random(5)
    plain = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    bits = ["token", "Secret", "apikey", "api_key", "=", ": ", " ", '"', "AKIA", "A1B2C3", "0123abcd", "f" * 9, "word-", "ſecret", "\n"]
    for _ in range(400):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        want = []
        for kind, p in plain.items():
            for m in re.finditer(p, t):
                if len(m.group(2)) >= 8 if kind == "assign" and m.group(1).isascii() else len(m.group()) >= {"access": 16, "hex": 32}.get(kind, 10**9):
                    want.append((m.start(), ["assign", "access", "hex"].index(kind), m.end()))
        assert [s for s in secrets_scan.spans(t, efficiency) if s[1] < 3] == sorted(want)


def test_positive_unlabelled_fit():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (3000, quality_classifier.FEATURES)), rng.normal(-1, 1, (3000, quality_classifier.FEATURES))
    unlabelled = np.concatenate([good[1000:], bad[:1000]])
    model = quality_classifier.fitted(good[:1000], unlabelled)
    assert abs(model.prior - 2 / 3) < 0.08
    assert (model.scores(good[2000:]) >= 0.5).mean() > 0.97 and (model.scores(bad[2000:]) < 0.5).mean() > 0.97
    assert quality_classifier.fitted(good[:0], unlabelled) is None
    assert quality_classifier.features(pa.array(["", None, "a b\n" * 9])).shape == (3, quality_classifier.FEATURES)


def test_digest_of_nothing_is_known():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
