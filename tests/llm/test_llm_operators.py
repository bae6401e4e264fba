"""Each operator on small awkward tables, against brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from screenlake.llm import embedding_dedup, exact_dedup, language_id, ngram_join, packing, pieces, repeats, token_files, tokens, url_filter, warc
from screenlake.shipping import ship

RNG = random.Random(11)
WORDS = ["".join(RNG.choices("abcdefgh", k=RNG.randint(2, 7))) for _ in range(60)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


BASE, PASSAGE = prose(120), prose(40)
TEXTS = [
    None, "", "  \t ", "one", "one two", BASE, BASE, BASE.replace(" ", "\n", 3), BASE.replace(" ", "  "), BASE + " tail", BASE.upper(),
    PASSAGE + " " + prose(50), prose(30) + " " + PASSAGE + " " + prose(30), "x" * 400, "y" * 150 + "é" * 90, prose(3000), BASE + " " + BASE,
    *(" ".join(w if RNG.random() > 0.01 else "zz" for w in BASE.split(" ")) for _ in range(8)),
]
ROWS = [(i * 3 + 1, t, i, "other") for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, n long, version string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_exact_dedup(docs, empty, spark):
    got = rows(exact_dedup.exact_dedup(docs))
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in ROWS}
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(same), len(same), i == min(same))
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0
    hot = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(600)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(hot, max_hot=4).collect()
    assert len(got) == 600 and all(r.keep_id == 0 and r.group_size == 200 for r in got if r.doc_id % 3 == 0)
    odd = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "q")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.kept, r.group_size) for r in odd) == [(False, True, 3), (False, True, 3), (True, False, 3), (True, True, 1)]


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "a.example.org", "/")]


def judge(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0].translate(LOWER)
        path = re.split("[?#]", rest[len(host) :])[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_url_filter(spark):
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "b.a.example.org", "xexample.org", "org", "com", "x.com", "example.org.", "", "org.example", "exa mple.org", "café.org", "example.org-x"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/es/", "/es", "/en/12?q=/de/", "/fr/x#y", "/de/", "?a=/es/", "#f")] + [None, "no scheme", "x://", "http://a://b.org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows(url_filter.url_filter(df, url_filter.rules_from(spark, RULES)), "page_id")
    for i, u in enumerate(urls):
        assert tuple(got[i][1:]) == judge(u), u
    assert url_filter.url_filter(df.limit(0), url_filter.rules_from(spark, RULES)).count() == 0
    none = url_filter.url_filter(df, spark.createDataFrame([], "host string, path string, verdict string")).collect()
    assert {r.verdict for r in none} == {"allow"} and {r.rule for r in none} == {None}


def removed(texts, length):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(docs, empty, spark):
    got = rows(repeats.remove_repeats(docs, 100))
    want = removed({i: t for i, t, *_ in ROWS}, 100)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert sum(x[1] for x in want.values()) > 1000
    assert repeats.remove_repeats(empty, 100).count() == 0
    twice = spark.createDataFrame([(5, BASE), (5, BASE), (None, "short")], "doc_id long, text string")
    assert [r.n_removed for r in repeats.remove_repeats(twice, 100).collect()] == [0, 0, 0]
    kept = rows(repeats.without_repeats(docs, 100))
    assert len(kept) == len(ROWS) and kept[1].text is None and kept[ROWS[5][0]].text == BASE and kept[ROWS[6][0]].text == ""
    assert kept[ROWS[5][0]].version == "other"


def test_many_shared_passages(spark):
    texts = {i: f"{prose(12)} {PASSAGE} {prose(12)}" if i % 2 else prose(30) for i in range(120)}
    got = rows(repeats.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5), 100))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == removed(texts, 100)


def test_suffix_ranks():
    rng = np.random.default_rng(3)
    b = np.concatenate([rng.integers(97, 99, 300), np.tile(rng.integers(97, 123, 40), 4)]).astype(np.uint8)
    for length in (8, 13, 64, 100):
        raw = b.tobytes() + bytes(length)
        prefixes = [raw[i : i + length] for i in range(len(b))]
        order = {x: k for k, x in enumerate(sorted(set(prefixes)))}
        assert np.unique(repeats.suffix_ranks(b, length), return_inverse=True)[1].tolist() == [order[x] for x in prefixes]


def test_trigger_over_many_runs(spark):
    """One passage in more texts than a run of the dictionary holds, with other words around it each time."""
    texts = {i: f"{prose(3)} {i} {PASSAGE[:130]} {i * 7} {prose(3)}" for i in range(6_000)}
    got = rows(repeats.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), 100))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == removed(texts, 100)


def links_of(texts, k, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and both:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, empty, spark, k, percent):
    got = rows(ngram_join.ngram_join(docs, k, percent))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == links_of({i: t for i, t, *_ in ROWS}, k, percent)
    assert ngram_join.ngram_join(empty, k, percent).count() == 0


@pytest.mark.parametrize("noise, members", [(0.03, 10**6), (0.045, 700)])
def test_ngram_join_with_large_tiles(spark, monkeypatch, noise, members):
    """Near copies of one text, most pairs linked or most of them just under the threshold, over several blocks and cells."""
    monkeypatch.setattr(ngram_join, "TILE", 8)
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    monkeypatch.setattr(ngram_join, "HEAVY_LEAST", 2)
    texts = {i: " ".join(w if RNG.random() > noise * (1 if i % 3 else 0.4) else RNG.choice(WORDS) for w in BASE.split(" ")) for i in range(70)}
    got = rows(ngram_join.ngram_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), 4, 85))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == links_of(texts, 4, 85)


def test_forest_of_a_tile():
    rng = np.random.default_rng(9)
    sets = [np.unique(np.concatenate([np.arange(50, dtype=np.uint64)[rng.random(50) > 0.08], rng.integers(100, 10**6, 3).astype(np.uint64)])) for _ in range(60)]
    sets.sort(key=len)
    at = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(i)}
    over = ngram_join.Overlaps(sets)
    assert all(over.of(np.array([i]), np.array([j]))[0] == n for (i, j), n in at.items())
    linked = {(i, j) for (i, j), n in at.items() if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n)}
    ids, sizes, same = list(range(60)), [len(s) for s in sets], [0] * 60
    bits, members = [ngram_join.bitmap(s) for s in sets], [s.tobytes() for s in sets]
    a, b = ngram_join.forest(ids, sizes, ids, same, bits, same, [[5]] * 60, members, 85)
    root = ids[:]
    for i, j in linked:
        root = [root[i] if r == root[j] else r for r in root]
    mine = ids[:]
    for i, j in zip(a.tolist(), b.tolist()):
        assert (max(i, j), min(i, j)) in linked
        mine = [mine[i] if r == mine[j] else r for r in mine]
    assert len(a) == 60 - len(set(root)) and len({(x, y) for x, y in zip(root, mine)}) == len(set(root))
    assert not len(ngram_join.forest(ids, sizes, ids, same, bits, [1] * 60, [[3, 5]] * 60, members, 85)[0])  # those are tile 3's


def test_embedding_dedup(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    near = x[:40] + 0.12 * rng.standard_normal((40, 16))
    group = x[0] + 0.05 * rng.standard_normal((60, 16))
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([x, near, group])]
    other = rng.standard_normal((20, 3)).astype(np.float32).tolist()  # a rare length
    data = list(enumerate(vectors)) + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None] * 8), (905, [1.0, 2.0])]
    data += [(906, vectors[3]), (906, vectors[3]), (907, [1.0, 2.0]), (None, vectors[3]), (908, [1e30] * 16), (909, [2e30] * 16)] + [(1000 + i, v) for i, v in enumerate(other)]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in data], "vec_id long, embedding array<float>, `a.b` string, n_links int").repartition(3)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    got = embedding_dedup.embedding_dedup(df, threshold=0.9).collect()
    assert len(got) == len(data)
    fine = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(fine)
    s = np.array([[a != b and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= 0.9 for b in ids] for a in ids])
    at = {r.vec_id: r for r in got}
    true, found = int(s.sum()), sum(at[i].n_links for i in ids)
    assert 0.98 * true <= found <= true
    for k, i in enumerate(ids):
        assert at[i].n_links <= s[k].sum()
        if not s[k].any():
            assert at[i].component_id == i and at[i].n_links == 0
        if i >= 905:
            assert at[i].n_links == s[k].sum()  # equal vectors, and rare lengths, are found always
    assert all(at[i].n_links == 0 and at[i].component_id == i and at[i].kept for i in (900, 901, 902, 903, 904))
    assert at[340].component_id == 0 and not at[340].kept and at[907].component_id == 905 and at[909].component_id == 908
    assert (at[None].n_links, at[None].component_id, at[None].kept) == (0, None, False)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_tables_reach_the_recall():
    x = np.random.default_rng(8).standard_normal((2_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    fresh = np.random.default_rng(9)
    for n in (10**4, 10**9):
        t = embedding_dedup.plan_tables(x, n, 0.9, 0.99)
        a = x[fresh.permutation(2_000)[:1_000]]
        u = fresh.standard_normal(a.shape)
        u -= (u * a).sum(axis=1, keepdims=True) * a
        b = 0.9 * a + math.sqrt(1 - 0.81) * u / np.linalg.norm(u, axis=1, keepdims=True)
        same = (t.codes(t.bits(a)) == t.codes(t.bits(b))).any(axis=1) & (np.bitwise_count(t.short(t.bits(a)) ^ t.short(t.bits(b))).sum(axis=1) <= t.radius)
        assert same.mean() >= 0.98 and t.recall >= 0.99
    with pytest.raises(ValueError):
        embedding_dedup.plan_tables(x, 10**9, 0.9, 0.99, most_tables=96)


@pytest.mark.parametrize("n", [300])
def test_embedding_recall_on_given_vectors(spark, n):
    """Against all pairs of the given vectors, at a threshold that their nearest pairs do reach."""
    from pathlib import Path

    path = Path("/root/testdata/sf0.1/embeddings.parquet")
    if not path.exists():
        pytest.skip("no given vectors here")
    df = spark.read.parquet(str(path)).select("vec_id", "embedding")
    rows_ = df.collect()
    x = np.array([r.embedding for r in rows_], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, 0)
    threshold = float(np.sort(s.ravel())[-2 * n])  # n pairs lie at or over it
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_dedup(df, threshold=threshold).collect()}
    true = (s >= threshold).sum(axis=1)
    assert sum(got.values()) >= 0.95 * true.sum() and all(got[r.vec_id] <= t for r, t in zip(rows_, true))


def test_language_id(spark):
    letters = {"aa": "abcdeii", "bb": "mnoprstu", "cc": "éèçvwxz"}
    text = lambda la, n: " ".join("".join(RNG.choices(letters[la], k=RNG.randint(2, 6))) for _ in range(n))
    data = [(i, text(la, RNG.randint(20, 80)), la) for i, la in enumerate(list(letters) * 60)]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !? 45", None), (1003, text("cc", 5000), None)]
    df = spark.createDataFrame(data + odd, "doc_id long, text string, lang string")
    got = rows(language_id.identify(df, df.where("doc_id % 4 <> 2 and doc_id < 1000")))
    held = [(i, la) for i, _, la in data if i % 4 == 2]
    assert sum(got[i].lang_pred == la for i, la in held) / len(held) > 0.97
    assert not any(got[i].rejected for i, _, _ in data)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "cc"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1001].rejected
    none = language_id.identify(df, df.where("false")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(df.limit(0), df).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    plain, window = Tokenizer.from_file(tokens.tokenizer_path()), 64
    ids = {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t, *_ in ROWS}
    pieces_ = packing.pack_documents(docs, tokens.tokenizer_path(), window, 1, with_ids=True)
    got = sorted(pieces_.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in got:
        assert r.sequence_id * window + r.offset == at and r.offset + r.length <= window
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length].tolist() and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        at += r.length
    assert at == sum(map(len, ids.values()))
    full = packing.sequences(pieces_, window).collect()
    assert {len(r.ids) for r in full} == {window} and len(full) == -(-at // window)
    assert packing.pack_documents(empty, tokens.tokenizer_path()).count() == 0


def test_token_output(docs, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path())
    got = rows(token_files.token_round_trip(docs, tokens.tokenizer_path(), 2))
    at = 0
    for i, t, *_ in sorted(ROWS, key=lambda r: r[0]):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_round_trip(empty, tokens.tokenizer_path(), 2).count() == 0


def test_warc(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "é" * 50_000, "<p>a</p>", "b", ""]
    df = spark.createDataFrame([(i, f"http://h/{i}\r\n x", h) for i, h in enumerate(html)] + [(None, None, "b")], "page_id long, url string, html string")
    got = warc.warc_round_trip(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 9 and {i: r.record_type for i, r in by.items()} == {0: "revisit", 1: "revisit", 2: "revisit", 3: "revisit", 4: "response", 5: "response", 6: "response", 7: "response", None: "revisit"}
    assert (by[0].refers_to, by[1].refers_to, by[2].refers_to, by[5].refers_to, by[None].refers_to) == (7, 7, 5, None, 6)
    for i, h in enumerate(html):
        data = (h or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {r.record_type for r in warc.warc_round_trip(df, least_bytes=10**6).collect()} == {"response"}
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_pieces(docs, empty):
    got = rows(pieces.nbest(docs, tokens.tokenizer_path("piece_bpe_32k.model"), 3, with_ids=True))
    assert all(r.round_trip for r in got.values()) and got[1].n_pieces == 0 and got[1].n_found == 1
    for r in got.values():
        assert r.nbest_scores == sorted(r.nbest_scores, reverse=True) and r.nbest_scores[0] == r.best_score
        assert len({tuple(x) for x in r.nbest_ids}) == r.n_found and len(r.nbest_ids[0]) == r.n_pieces
        assert r.ids_crc32 == zlib.crc32(np.array(r.nbest_ids[0], "<u4").tobytes())
    assert pieces.nbest(empty, tokens.tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    text = lambda i: prose(80 + i % 40)
    data = [(i, text(i), "xx", "s", 1) for i in range(80)]
    data += [(100, data[3][1], "xx", "s", 1), (101, data[3][1].replace(" ", "\t"), "xx", "s", 1), (102, data[5][1] + " more", "xx", "s", 1), (103, None, None, None, None), (104, "123", "xx", "s", 3), (105, PASSAGE + " " + prose(40), "xx", "s", 1), (106, prose(40) + " " + PASSAGE, "xx", "s", 1)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pieces_ = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in pieces_}
    assert kept == {i for i in range(80)} | {105, 106}
    # every piece against the plain tokenizer over what brute force leaves of each text
    from tokenizers import Tokenizer

    plain, seen, left = Tokenizer.from_file(tokens.tokenizer_path()), set(), {}
    for i, t in sorted((i, t) for i, t, *_ in data if i in kept):
        b, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for p in range(len(b) - 99):
            gone[p : p + 100] |= b[p : p + 100] in seen
            seen.add(b[p : p + 100])
        left[i] = np.array(plain.encode(bytes(x for x, g in zip(b, gone) if not g).decode(), add_special_tokens=False).ids + [1], "<u4")
    assert len(left[106]) < len(plain.encode(data[-1][1]).ids)
    assert sum(r.length for r in pieces_) == sum(map(len, left.values()))
    for r in pieces_:
        assert r.doc_tokens == len(left[r.doc_id]) and r.ids_crc32 == zlib.crc32(left[r.doc_id][r.start : r.start + r.length].tobytes())
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_stages_with_clashing_names(spark, tmp_path):
    import corpus_pipeline

    text = lambda i: prose(80 + i % 40)
    data = [(i, text(i), "xx", 0.5, "S", "dot", "k", "v", i, "n") for i in range(30)] + [(30, None, None, None, None, None, None, None, None, None), (31, f"{PASSAGE} {prose(60)}", "xx", 1.0, "S", "dot", "k", "v", 0, "n"), (32, f"{prose(60)} {PASSAGE}", "xx", 1.0, "S", "dot", "k", "v", 0, "n")]
    names = ["doc_id", "text", "lang", "score", "SCORE_2", "a.b", "__id", "version", "rejected", "back`tick"]
    schema = "doc_id long, text string, lang string, score double, SCORE_2 string, `a.b` string, __id string, version string, rejected int, `back``tick` string"
    docs = before = spark.createDataFrame(data, schema)
    for name, step in corpus_pipeline.STAGES[:-1]:
        step(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == names and docs.dtypes == before.dtypes, name
    got = {r[0]: tuple(r) for r in docs.collect()}
    assert set(got) == set(range(30)) | {31, 32}
    assert all(got[i] == data[i] for i in range(30)) and got[32][2:] == data[32][2:]
    assert got[31][1] == data[31][1] and len(got[32][1]) < len(data[32][1]) - 100
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 32


def plain_kneser_ney(texts, order, discount):
    """Interpolated Kneser-Ney by dictionaries: log probability of each symbol of a word after its context in the word."""
    from collections import Counter, defaultdict

    start, end = chr(language_id.START), chr(language_id.END)
    marked = lambda t: [f"{start}{w}{end}" for w in language_id.letter_runs(t)]
    words = [w for t in texts for w in marked(t)]
    counts: list[Counter] = [Counter() for _ in range(order + 1)]
    for w in words:
        for i in range(1, len(w)):
            for k in range(1, min(order, i + 1) + 1):
                gram = w[i - k + 1 : i + 1]
                if k == order or i - k + 1 == 0:  # the highest order, or nothing before it: as often as it occurs
                    counts[k][gram] += 1
    before = defaultdict(set)
    for w in words:
        for i in range(1, len(w)):
            for k in range(1, min(order - 1, i) + 1):
                before[w[i - k + 1 : i + 1]].add(w[i - k])
    for gram, kinds in before.items():
        counts[len(gram)][gram] += len(kinds)
    total, kinds = Counter(), Counter()
    for k in range(1, order + 1):
        for gram, n in counts[k].items():
            total[gram[:-1], k] += n
            kinds[gram[:-1], k] += 1

    def probability(word, i, base):
        p = base
        for k in range(1, min(order, i + 1) + 1):
            gram = word[i - k + 1 : i + 1]
            if total[gram[:-1], k]:
                p = max(counts[k][gram] - discount, 0) / total[gram[:-1], k] + discount * kinds[gram[:-1], k] / total[gram[:-1], k] * p
        return p

    return lambda text, base: [np.log(probability(w, i, base)) for w in marked(text) for i in range(1, len(w))]


def test_kneser_ney_against_dictionaries():
    samples = {"aa": [prose(30) for _ in range(6)], "bb": ["".join(RNG.choices("mnopqr ", k=150)) for _ in range(7)]}
    for order in (1, 2, 4):
        model = language_id.fit(samples, order)
        scorer = language_id.Scorer(model)
        for j, la in enumerate(model.languages):
            plain = plain_kneser_ney([t for i, t in enumerate(samples[la]) if i % 5], order, model.discount)
            for text in (samples["aa"][0], samples["bb"][1], "abc mnx é zzz", "a"):
                got, _ = scorer.log_probs(language_id.letter_runs(text))
                assert np.allclose(got[:, j], plain(text, model.base)), (order, la, text)


LONG = " ".join(f"{w}{i % 97}" for i, w in enumerate(WORDS * 6_000))  # over a megabyte


def test_very_long_texts(spark):
    """A text of over a megabyte through every operator that takes texts, beside a short one and an empty one."""
    from tokenizers import Tokenizer

    assert len(LONG) > 1_500_000
    df = spark.createDataFrame([(1, LONG), (2, "short"), (3, "")], "doc_id long, text string")
    plain = Tokenizer.from_file(tokens.tokenizer_path())
    ids = np.array(plain.encode(LONG, add_special_tokens=False).ids + [2], "<u4")
    got = rows(token_files.token_round_trip(df, tokens.tokenizer_path(), 2))
    assert (got[1].n_tokens, got[1].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    pieces_ = sorted(packing.pack_documents(df, tokens.tokenizer_path(), 2048, 2).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert sum(r.length for r in pieces_ if r.doc_id == 1) == len(ids) and all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces_ if r.doc_id == 1)
    got = rows(exact_dedup.exact_dedup(df))
    assert got[1].text_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and got[1].group_size == 1
    got = rows(pieces.nbest(df, tokens.tokenizer_path("piece_bpe_32k.model"), 2))
    assert got[1].round_trip and got[1].n_found == 2
    pages = df.selectExpr("doc_id as page_id", "'http://x' as url", "text as html")
    assert rows(warc.warc_round_trip(pages), "page_id")[1].payload_bytes == len(LONG.encode())


def test_clashing_columns_and_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.example.org/x", "h", "r", 0)], "page_id long, url string, html string, `a.b` string, rule int")
    rules = spark.createDataFrame([("a.example.org", "/x", "allow"), ("a.example.org", "/x", "block"), ("org", "/", "allow")], "host string, path string, verdict string")
    got = url_filter.url_filter(pages, rules).first()
    assert (got.rule, got.verdict) == ("a.example.org/x", "block")  # of equal rules the one that blocks
    assert warc.warc_round_trip(pages).first().record_type == "response"
    train = spark.createDataFrame([(i, "abc abd", la) for i, la in enumerate(["zz", "yy"] * 10)], "doc_id long, text string, lang string")
    got = language_id.identify(spark.createDataFrame([(1, "abc", 0.5, "x")], "doc_id long, text string, SCORE double, `a.b` string"), train).first()
    assert got.lang_pred == "yy" and got["a.b"] == "x" and got.score == pytest.approx(0.5)  # equal entropies: the first by name


def test_batches_to_workers_have_bounded_bytes(spark):
    ship(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 10000) AS text").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in rows) == 3000 and max(r["size"] for r in rows) < 8_000_000
