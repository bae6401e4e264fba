"""Language ID by interpolated Kneser-Ney character language models.

Each language has an n-gram model of the letters of words (lower-cased, with a start and an end mark; contexts stay inside
a word). All languages' n-grams of an order lie in one sorted array of hashes with a column of discounted probabilities a
language, and contexts likewise with back-off weights, so one binary search serves all languages. A text's score in a
language is its cross-entropy, the negative log probability over the number of symbols; the lowest wins. Texts whose lowest
cross-entropy lies above what was calibrated on labelled texts left out of the counts are marked as rejected.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix
from .staging import free_name, quoted
from .tokens import keep, release, runs_within, slices

START, END = 2, 3
#: Doubles in one array of symbols by languages, unless a single chunk between spaces has more.
MOST_TERMS = 1_000_000
#: Symbols of words whose n-grams are made at once when models are fitted, unless a single word has more.
MOST_SYMBOLS = 1 << 16
#: Characters of texts that calibrate at once, and words remembered meanwhile.
CALIBRATED, CALIBRATED_WORDS = 1 << 17, 20_000
_W = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def letter_runs(text: str) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def grams_of(words: list[str], order: int):
    """Per position to predict: hashes of its n-gram (1 to order) and context, and how many orders its word allows."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    first = np.cumsum(size) - size
    codes = np.frombuffer("".join(f"{chr(START)}{w}{chr(END)}" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(codes)) - first[word]  # place in the word, 0 the start mark
    grams, contexts = [], []
    h = np.zeros(len(codes), np.uint64)
    for k in range(order):
        contexts.append(mix(np.concatenate([[np.uint64(0)], h[:-1]]) + np.uint64(k)))  # the k symbols before
        # the hash of the last k + 1 symbols: the symbol k back joins with a weight of its own
        h = h + np.concatenate([np.zeros(min(k, len(codes)), np.uint64), codes[: max(0, len(codes) - k)]]) * _W[k]
        grams.append(mix(h + np.uint64(k + 1)))
    asked = at > 0
    return [g[asked] for g in grams], [c[asked] for c in contexts], at[asked], word[asked]


class Model:
    """languages, order, and per order: gram hashes, terms [gram, language], context hashes, weights [context, language]."""

    def __init__(self, languages: list[str], order: int, discount: float = 0.75):
        self.languages, self.order, self.discount = languages, order, discount
        self.tables: list[tuple] = []
        self.base, self.limit, self.slack, self.sharpness = 1.0, math.inf, 0.0, 8.0


def _table(grams: np.ndarray, contexts: np.ndarray, shorter: np.ndarray, begins: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct n-grams, each with its context, the n-gram without its first symbol, whether a word begins with it, and its number."""
    g, index, back = np.unique(grams, return_index=True, return_inverse=True)
    return g, contexts[index], shorter[index], begins[index], np.bincount(back, weights=number, minlength=len(g)).astype(np.int64)


def counted_grams(texts: list[str], order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: the n-grams of the texts' words, their contexts, and the numbers that Kneser-Ney smoothing counts.

    Every distinct word is taken once, with the number of times that it occurs, and MOST_SYMBOLS symbols at a time, so that
    beside the texts' words only tables of distinct n-grams are held.
    """
    words: Counter[str] = Counter()
    for t in texts:
        words.update(letter_runs(t))
    each, times = list(words), np.fromiter(words.values(), np.int64, len(words))
    none = np.empty(0, np.uint64)
    tables = [(none, none, none, np.empty(0, bool), np.empty(0, np.int64))] * order
    for a, b in runs_within([len(w) + 2 for w in each], MOST_SYMBOLS):
        grams, contexts, at, word = grams_of(each[a:b], order)
        number = times[a:b][word]
        for k in range(order):  # k + 1 symbols
            whole = at >= k  # the n-gram lies inside the word
            part = _table(grams[k][whole], contexts[k][whole], grams[max(0, k - 1)][whole], at[whole] == k, number[whole])
            tables[k] = _table(*[np.concatenate(x) for x in zip(tables[k], part)])
    out = []
    for k, (g, c, _, begins, number) in enumerate(tables):
        if k + 1 < order:
            # lower orders: one for each distinct symbol before; an n-gram that begins a word counts as it occurs
            before = np.bincount(np.searchsorted(g, tables[k + 1][2]), minlength=len(g))
            number = np.where(begins, number, before)
        out.append((g[number > 0], c[number > 0], number[number > 0]))
    return out


def fit(samples: dict[str, list[str]], order: int = 4, discount: float = 0.75) -> Model:
    """samples: texts by language, counted whole; a fifth of a language's texts (at least one, if it has two) calibrates."""
    languages = sorted(samples)
    model = Model(languages, order, discount)
    left_out = {la: texts[::5] if len(texts) > 1 else [] for la, texts in samples.items()}
    counted = {la: [t for i, t in enumerate(texts) if i % 5 or len(texts) == 1] for la, texts in samples.items()}
    per: list[list] = [[] for _ in range(order)]
    symbols: set = set()
    for la in languages:
        found = counted_grams(counted[la], order)
        symbols.update(found[0][0].tolist())
        for k in range(order):
            per[k].append(found[k])
    for k in range(order):
        all_grams = np.unique(np.concatenate([x[0] for x in per[k]]))
        all_contexts = np.unique(np.concatenate([x[1] for x in per[k]]))
        terms = np.zeros((len(all_grams), len(languages)), np.float64)
        weights = np.ones((len(all_contexts), len(languages)), np.float64)
        for j, (g, c, number) in enumerate(per[k]):
            if len(g):
                uc, back = np.unique(c, return_inverse=True)
                total, kinds = np.bincount(back, weights=number), np.bincount(back)
                terms[np.searchsorted(all_grams, g), j] = (number - discount) / total[back]
                weights[np.searchsorted(all_contexts, uc), j] = discount * kinds / total
        model.tables.append((all_grams, terms, all_contexts, weights))
    model.base = 1.0 / (len(symbols) + 1)
    scorer = Scorer(model, CALIBRATED_WORDS)
    got = [(s, n) for la in languages for a, b in slices(left_out[la], CALIBRATED) for s, n in zip(*scorer.best(left_out[la][a:b])) if n]
    if got:
        # a long text may exceed the worst long one by a tenth; a short one by more, as its mean is less certain
        sure = [s for s, n in got if n >= 200] or [s for s, _ in got]
        model.limit = 1.1 * max(sure)
        model.slack = max(0.0, *((s - model.limit) * math.sqrt(n) for s, n in got)) + 6.0
    return model


class Scorer:
    """Scores texts; remembers at most max_words chunks' sums, then starts anew."""

    def __init__(self, model: Model, max_words: int = 250_000):
        self.model, self.max_words = model, max_words
        self.known: dict[str, int] = {}
        self.sums = np.zeros((0, len(model.languages) + 1))
        self.used = 0

    def log_probs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities [position, language] and the positions' words."""
        m = self.model
        grams, contexts, at, word = grams_of(words, m.order)
        p = np.full((len(at), len(m.languages)), m.base)
        for k, (g, terms, c, weights) in enumerate(m.tables):
            if not len(g):
                continue
            whole = at >= k
            i = np.minimum(np.searchsorted(c, contexts[k]), len(c) - 1)
            weight = np.where(((c[i] == contexts[k]) & whole)[:, None], weights[i], 1.0)
            i = np.minimum(np.searchsorted(g, grams[k]), len(g) - 1)
            term = np.where(((g[i] == grams[k]) & whole)[:, None], terms[i], 0.0)
            p = term + weight * p
        return np.log(p), word

    def _add(self, chunks: list[str]) -> None:
        runs = [letter_runs(c) for c in chunks]
        rows = np.zeros((len(chunks), len(self.model.languages) + 1))
        # a few at a time: each step below makes arrays of [symbol, language]
        sizes = [sum(map(len, r)) + len(r) for r in runs]
        for a, b in runs_within(sizes, max(1, MOST_TERMS // rows.shape[1])):
            words = [w for r in runs[a:b] for w in r]
            if not words:
                continue
            logs, word = self.log_probs(words)
            chunk = np.repeat(np.arange(b - a), [len(r) for r in runs[a:b]])[word]
            for j in range(logs.shape[1]):
                rows[a:b, j] = np.bincount(chunk, weights=logs[:, j], minlength=b - a)
            rows[a:b, -1] = np.bincount(chunk, minlength=b - a)
        need = self.used + len(chunks)
        if need > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((max(need - len(self.sums), len(self.sums), 4096), rows.shape[1]))])
        self.sums[self.used : need] = rows
        self.known.update(zip(chunks, range(self.used, need)))
        self.used = need

    def entropies(self, texts: list[str]) -> np.ndarray:
        """[text, language] cross-entropies and, last, the number of symbols (0: no letters)."""
        cut = [t.split(" ") for t in texts]
        new = {c for parts in cut for c in parts if c not in self.known}
        if self.used + len(new) > self.max_words and self.used:
            self.known.clear()
            self.used = 0
            self.sums = np.zeros((0, self.sums.shape[1]))
            new = {c for parts in cut for c in parts}
        if new:
            self._add(sorted(new))
        get = self.known.__getitem__
        index = [np.fromiter(map(get, parts), np.int64, len(parts)) for parts in cut]
        out = np.array([self.sums[i].sum(axis=0) for i in index]).reshape(len(texts), -1)
        out[:, :-1] /= -np.maximum(out[:, -1:], 1)
        return out

    def best(self, texts: list[str]) -> tuple[list[float], list[int]]:
        if not texts:
            return [], []
        e = self.entropies(texts)
        return e[:, :-1].min(axis=1).tolist(), e[:, -1].astype(int).tolist()

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score (its share of probability among the languages, sharpened, 0 to 1), rejected."""
        m, e = self.model, self.entropies(texts)
        n, e = e[:, -1], e[:, :-1]
        pick = e.argmin(axis=1)
        low = e.min(axis=1)
        score = 1.0 / np.exp(-m.sharpness * (e - low[:, None])).sum(axis=1)
        rejected = (n == 0) | (low > m.limit + m.slack / np.sqrt(np.maximum(n, 1)))
        return [m.languages[k] if x else "und" for k, x in zip(pick, n)], np.where(n > 0, score, 0.0).tolist(), rejected.tolist()


def training_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_language: int, most_bytes: int, most_languages: int = 256) -> dict[str, list[str]]:
    """About docs_per_language labelled texts of a language, chosen by a hash of the id; longer than most_bytes none.

    More than most_languages languages raise an error: the models' size is in proportion to their number.
    """
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).alias("lang")).where("text is not null and lang is not null")
    rows = rows.where(F.octet_length("text") <= most_bytes)
    many = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages + 1).collect()
    if len(many) > most_languages:
        raise ValueError(f"over {most_languages} languages; give a larger most_languages")
    many = df.sparkSession.createDataFrame(many, "lang string, count long")
    share = many.select("lang", (F.lit(float(docs_per_language)) / F.col("count")).alias("share"))
    chosen = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    out: dict[str, list[str]] = {}
    for lang, text in sorted((r["lang"], r["text"]) for r in chosen.select("lang", "text").collect()):
        out.setdefault(lang, []).append(text)
    return out


def language_column(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, docs_per_language: int = 400, most_bytes: int = 65_536, most_languages: int = 256, max_words: int = 250_000):
    """A function of a text column that gives struct<lang_pred: string, score: double, rejected: boolean>.

    train holds labelled rows; the models are fitted on a sample of about docs_per_language whole texts a language, none
    longer than most_bytes, of most_languages languages at most, so its size does not grow with the input. A null text or
    one without letters is ``und``, score 0, rejected. Ties go to the first language in order of name. Without labelled
    rows every text is ``und``. max_words bounds what a worker remembers and changes no result. Predictions use the text alone: only that column reaches Python; whole texts count.
    """
    samples = training_sample(train, id_col, text_col, lang_col, docs_per_language, most_bytes, most_languages)
    model, name = train.sparkSession.sparkContext.broadcast(fit(samples, order)) if samples else None, uuid.uuid4().hex
    samples.clear()
    release()  # the driver keeps what fitting took, else

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = keep(("scorer", name), lambda: Scorer(model.value, max_words)) if model else None
        for column in batches:
            parts = []
            for at in range(0, len(column), 512):
                texts = [t or "" for t in column.slice(at, 512).to_pylist()]
                for a, b in slices(texts):
                    parts.append(scorer.predict(texts[a:b]) if scorer else (["und"] * (b - a), [0.0] * (b - a), [True] * (b - a)))
            found = [sum(map(list, x), []) for x in zip(*parts)] if parts else [[], [], []]
            yield pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.string(), pa.float64(), pa.bool_()))], names=["lang_pred", "score", "rejected"])

    return F.arrow_udf(run, "lang_pred string, score double, rejected boolean")


def identify(df: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """df's rows with lang_pred, score and rejected added, as language_column says; df's own columns of these names go."""
    found = language_column(train, id_col, text_col, lang_col, **bounds)(F.col(quoted(text_col)))
    kept = [c for c in df.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    name = free_name(df, "found")
    rows = df.withColumn(name, found)
    return rows.select(*[F.col(quoted(c)) for c in kept], *[F.col(f"{quoted(name)}.{c}").alias(c) for c in ("lang_pred", "score", "rejected")])


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % 4 == 2, F.lit(False))
