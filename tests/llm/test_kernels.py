"""Kernels and file formats without Spark, against plain versions."""

from __future__ import annotations

import io
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from screenlake.llm import kernels, language_id, ngram_join, pieces, repeats, token_files, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉ \t\n.!\x0b\x85", max_size=40), max_size=6), st.integers(1, 5))
def test_shingle_sets_equal_plain_sets(texts, k):
    def plain(t):
        w = WORD.findall(t.translate(LOWER))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    got, want = kernels.shingle_sets(texts, k), [plain(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for (a, x), (b, y) in itertools.combinations(zip(got, want), 2):
        assert len(np.intersect1d(a, b)) == len(x & y)


def test_words_across_blocks():
    text = " ".join(f"word{i}" for i in range(5000)) + " " + "x" * 3000
    a, _ = kernels.word_hashes([text], most=64)
    b, _ = kernels.word_hashes([text])
    assert (a == b).all() and len(a) == 5001


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 31), st.integers(0, 400), st.integers(0, 2**31))
def test_bit_packing_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 2**bits, n).astype("<u4")
    assert (token_files.unpack(token_files.pack(ids, bits), n, bits) == ids).all()


def test_token_file_random_access_and_digests():
    rng, out = np.random.default_rng(1), io.BytesIO()
    docs = [rng.integers(0, 50257, int(n)).astype("<u4") for n in rng.integers(0, 300, 60)] + [rng.integers(0, 50257, 5000).astype("<u4"), np.empty(0, "<u4")]
    w = token_files.TokenWriter(out, token_files.bits_for(50257), 128)
    for i, d in enumerate(docs):
        w.add(None if i == 0 else i, d)
    w.close()
    f = token_files.TokenFile(io.BytesIO(out.getvalue()))
    assert f.n_docs == len(docs) and not f.has_id[0] and f.bits == 16
    assert all((f.doc(i) == d).all() for i, d in enumerate(docs))
    assert f.digests().tolist() == [zlib.crc32(d.tobytes()) for d in docs]
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(out.getvalue()[:-3]))


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    plain, mine, rng = Tokenizer.from_file(path), tokens.Encoder(path, 200), random.Random(3)
    parts = ["a", "B", "é", " ", "  ", "\n", ".", "!", "'s", "'ll", "1", "23", "\t", " ", "中", "🙂", "|", "<|endoftext|>", "\r\n", "_", "-", "ß", "\x85", " ", "x" * 60]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(2000)]
    for i in range(0, len(texts), 37):
        for t, raw in zip(texts[i : i + 37], mine.encode(texts[i : i + 37])):
            assert np.frombuffer(raw, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_encoder_of_columns_equals_the_library():
    """Nulls, end ids of either width, white space of every kind before letters, and the encoder's own break in a text."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, rng = tokens.tokenizer_path(), random.Random(5)
    plain = Tokenizer.from_file(path)
    parts = ["ab", "C", "é", "ß", "ŋ", "²", "٣", " ", " ", "  ", "\n", "\n", ".", ",", ";.", "?", "'s", "'", "1", "\t", "\r", "\x1f", "\xa0", "\u3000", "\x01", "\x00", "🙂", "<|endoftext|>"]
    texts = [None if rng.random() < 0.02 else "".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    for end, most in ((None, 50), (1, 400_000), (70_000, 200)):
        mine = tokens.Encoder(path, most, end)
        for i in range(0, len(texts), 211):
            ids, starts = mine.encode_column(pa.array(texts)[i : i + 211])
            got = [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]
            assert got == [plain.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end]) for t in texts[i : i + 211]]
    ids, starts = mine.encode_column(pa.array([], pa.string()))
    assert len(ids) == 0 and starts.tolist() == [0]


def test_encoder_asks_the_library_once_a_word():
    """Words that differ in the mark or the line that follows go to the library once."""
    mine, asked = tokens.Encoder(tokens.tokenizer_path()), []
    words = mine._words
    mine._words = lambda new, *more: asked.extend(new) or words(new, *more)
    names = [f"{a}{b}{c}o" for a in "bdfg" for b in "aeiou" for c in "klmn"]
    mine.encode(["; ".join(names), " ".join(f"{x}{m}\n{y}" for m in (".", ",", "!", "?", "") for x, y in zip(names, names[7:]))])
    assert len(asked) <= 2 * len(names) + 90  # after a space or a line, and "word\\n"


def test_warc_reader_frames_and_verifies():
    rng = random.Random(1)
    payloads = [bytes(rng.choices(b"abc <>", k=n)) for n in (0, 1, 70_000, 200_000, 10)]
    data = b"".join(warc.record(i, "http://x/ y", p, 7, i == 1) for i, p in enumerate(payloads))
    got = list(warc.WarcReader(io.BytesIO(data), keep_payload=True))
    assert [x["type"] for x in got] == ["response", "revisit", "response", "response", "response"]
    assert [x["payload"] for x in got] == [p if i != 1 else b"" for i, p in enumerate(payloads)]
    assert [x["payload_bytes"] for x in got] == [len(p) for p in payloads]
    with pytest.raises(ValueError):
        list(warc.WarcReader(io.BytesIO(data[:-4])))
    import gzip

    bad = gzip.compress(gzip.decompress(warc.record(1, None, b"hello", None, False)).replace(b"hello", b"jello"))
    with pytest.raises(ValueError):
        list(warc.WarcReader(io.BytesIO(bad)))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab▁ c", max_size=8), st.integers(1, 6))
def test_n_best_equals_enumeration(text, n):
    vocab = [("<unk>", 0.0, True)] + [(f"<0x{i:02X}>", -9.0, False) for i in range(256)] + [(p, s, False) for p, s in (("▁", -1.5), ("▁a", -1.25), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("▁ab", -2.75), ("ba", -4.0), ("▁▁", -3.5))]
    lat = pieces.PieceLattice(vocab, n)
    marked = "▁" + text.replace(" ", "▁")

    def every(s):
        if not s:
            return [(0.0, ())]
        first = [(vocab[i][1], (i,), len(p)) for p, (i, _) in lat.vocab.items() if s.startswith(p)]
        if s[0] not in lat.vocab:
            ids = tuple(lat.bytes[b] for b in s[0].encode())
            first.append((-9.0 * len(ids), ids, 1))
        return [(a + b, x + y) for a, x, k in first for b, y in every(s[k:])]

    got = lat.encode(text)
    if not text:
        assert [(s, len(i)) for s, i in got] == [(0.0, 0)]
        return
    want = sorted((-s for s, _ in every(marked)))[:n]
    assert [-s for s, _ in got] == pytest.approx(want)
    assert len({tuple(i) for _, i in got}) == len(got)
    known = dict((ids, s) for s, ids in every(marked))
    assert all(known[tuple(i.tolist())] == pytest.approx(s) for s, i in got)
    assert all(lat.decode(i) == text.replace("▁", " ") for _, i in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=2, max_size=30), st.integers(0, 10**6))
def test_tiles_small_and_large_agree_and_bound_holds(sizes, seed):
    rng = np.random.default_rng(seed)
    sizes = sorted(sizes)
    sets = [np.sort(rng.choice(np.arange(1, 60, dtype=np.uint64), n, replace=False)) for n in sizes]
    bits = [ngram_join.bitmap(s) for s in sets]
    n = len(sizes)
    args = (list(range(n)), sizes, rng.integers(0, 4, n).tolist(), [0] * n, bits, 60)
    few, many = sorted(ngram_join._few(*args)), sorted(ngram_join._many(*args))
    assert few == many
    for i, j in itertools.combinations(range(n), 2):
        both = ngram_join.overlap(sets[i].tobytes(), sets[j].tobytes())
        assert both == len(np.intersect1d(sets[i], sets[j])) <= ngram_join.overlap_bound(sizes[i], bits[i], sizes[j], bits[j])


def test_phrases_hold_every_window_once():
    rng = random.Random(5)
    raws = [bytes(rng.choices(b"ab ", k=n)) for n in (0, 99, 100, 101, 500, 3000)] + [b"x" * 700]
    k, _, _, at, n = repeats.text_phrases(raws, 100)
    for t, raw in enumerate(raws):
        windows = sorted(p for i in np.flatnonzero(k == t) for p in range(at[i], at[i] + n[i]))
        assert windows == list(range(max(0, len(raw) - 99)))


def test_long_texts_are_cut_in_blocks(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 300)
    raw = bytes(random.Random(1).choices(b"abcd", k=2000))
    k, _, _, at, n = repeats.text_phrases([raw], 100)
    assert sorted(p for a, m in zip(at, n) for p in range(a, a + m)) == list(range(1901))


def test_kept_text_keeps_whole_characters():
    raw = "aéé€b".encode()
    for a in range(len(raw) + 1):
        for b in range(a, len(raw) + 1):
            out = repeats.kept_text(raw, [(a, b)])
            assert len(out.encode()) >= len(raw) - (b - a) and out[:1] in ("a", "é", "€", "b", "")


def test_kneser_ney_probabilities_sum_to_one():
    model = language_id.fit({"x": ["abab ba a", "ab b"], "y": ["ccd", "dc cd"]}, order=3)
    scorer = language_id.Scorer(model)
    for before in ("", "a", "ab"):
        # every symbol after a context, the end mark and one unknown symbol: probabilities of x add up to one
        total = 0.0
        for c in "abcd":
            logs, _ = scorer.log_probs([before + c])
            total += np.exp(logs[len(before), 0])
        logs, _ = scorer.log_probs([before]) if before else (None, None)
        if before:
            total += np.exp(logs[len(before), 0])
            logs, _ = scorer.log_probs([before + "z"])
            total += np.exp(logs[len(before), 0])
            assert total == pytest.approx(1.0, abs=1e-9)


def test_fit_holds_distinct_grams_only(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijé", k=rng.randrange(1, 9))) for _ in range(2_000)]
    texts = {la: [" ".join(rng.choices(part, k=2_000)) for _ in range(100)] for la, part in (("x", words), ("y", words[:900]))}
    tracemalloc.start()
    model = language_id.fit(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # one array of a language's symbols has 7 MB, and their n-grams took a dozen at once
    for most in (1, 300, 10**12):  # a word at once, many parts that share n-grams, one part
        monkeypatch.setattr(language_id, "MOST_SYMBOLS", most)
        other = language_id.fit({la: t[:6] for la, t in texts.items()})
        if most == 1:
            first = other
        assert all(np.array_equal(a, b) for x, y in zip(first.tables, other.tables) for a, b in zip(x, y))
        assert (first.base, first.limit, first.slack) == (other.base, other.limit, other.slack)
    assert len(model.tables[0][0]) == 12  # eleven letters and the end mark


def test_scorer_makes_small_arrays(monkeypatch):
    texts = {f"l{k}": [f"some plain words of language {k} " * 3, f"more of {k}"] for k in range(20)}
    model = language_id.fit(texts)
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(60_000))
    tracemalloc.start()
    found = language_id.Scorer(model).predict([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # an array of all symbols by languages has 77 MB, and several are needed
    monkeypatch.setattr(language_id, "MOST_TERMS", 10**12)
    assert language_id.Scorer(model).predict([text]) == found
