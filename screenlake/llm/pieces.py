"""SentencePiece n-best encoding and decoding over the piece lattice.

Nodes are positions, edges are vocabulary pieces with the model's scores, and a segmentation's score is the sum of its
pieces'. (A BPE model's scores are merge ranks; its best segmentation by total score need not be the merges' own.) A
character that no piece spells alone becomes its UTF-8 bytes' pieces, in one edge. Forward Viterbi gives each position the
best score from the start; that is the exact remaining cost of a backward search, so A-star pops complete segmentations in
order of score and expands no path that isn't among the best. No piece holds a space mark after another character, so the
lattice falls apart before every word, and the n best of a text combine the words' n best by the same search over words.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix, powers
from .tokens import keep, text_slices

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


def lattice(path: str, n: int) -> "PieceLattice":
    def make() -> "PieceLattice":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(sp.id_to_piece(i), sp.get_score(i), sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(sp.get_piece_size())]
        return PieceLattice(pieces, n)

    return keep(("pieces", path, n), make)


def _prefix_columns(codes: np.ndarray) -> np.ndarray:
    """Of words of one length as columns: hashes' running sums over their characters."""
    out = np.zeros((codes.shape[0] + 1, codes.shape[1]), np.uint64)
    np.cumsum(mix(codes + np.uint64(1)) * powers(codes.shape[0])[0][:, None], axis=0, out=out[1:])
    return out


def _range_keys(sums: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hashes of characters a to b - 1 of every word; they depend on the characters alone."""
    return (sums[b] - sums[a]) * powers(a + 1)[1][a]


def _key(text: str) -> int:
    return int(_range_keys(_prefix_columns(np.array([[ord(c)] for c in text], np.uint64)), 0, len(text))[0])


class Memory:
    """Words by place: scores, gaps to the second best (infinite without one) and ids as bytes, in columns."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.scores, self.gaps, self.ids = np.empty(0), np.empty(0), []

    def add(self, words: list[str], scores: np.ndarray, gaps: np.ndarray, ids: list[bytes]) -> None:
        n, need = len(self.ids), len(self.ids) + len(words)
        if need > len(self.scores):
            room = np.empty(max(need, 2 * len(self.scores), 4_096) - n)
            self.scores, self.gaps = np.concatenate([self.scores[:n], room]), np.concatenate([self.gaps[:n], room])
        self.scores[n:need], self.gaps[n:need] = scores, gaps
        self.ids += ids
        self.place.update(zip(words, range(n, need)))


class PieceLattice:
    """pieces: (piece, score, special) by id; byte pieces are named <0x00> to <0xFF>.

    encode(text) -> [(score, ids)], best first, n at most; ties go to the smaller edits of the best, words in order.
    """

    def __init__(self, pieces: list[tuple[str, float, bool]], n: int = 4, max_words: int = 300_000):
        self.n, self.max_words, self.pieces = n, max_words, [p for p, _, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, _) in enumerate(pieces) if re.fullmatch(r"<0x[0-9A-F]{2}>", p)}
        spelled = [(p, i, s) for i, (p, s, special) in enumerate(pieces) if not special and p and i not in set(self.bytes.values())]
        if any(MARK in p.lstrip(MARK) for p, _, _ in spelled):
            raise ValueError("a piece goes on past the end of a word")
        self.vocab = {p: (i, s) for p, i, s in spelled}
        self.scores = [s for _, s, _ in pieces]
        self.longest = max((len(p) for p in self.vocab), default=1)
        spelled = sorted((_key(p), i, s) for p, (i, s) in self.vocab.items())
        self.hashes = np.array([x[0] for x in spelled], np.uint64)
        self.piece_ids, self.piece_scores = np.array([x[1] for x in spelled], np.int64), np.array([x[2] for x in spelled], np.float64)
        self.some = np.zeros(1 << 22, bool)  # which top bits any piece's hash has
        self.some[self.hashes >> np.uint64(42)] = True
        self.known, self.old = Memory(), Memory()
        self.lists: dict[str, list] = {}

    def edges(self, word: str):
        """For each start, (end, ids, score) of the lattice's edges."""
        out, vocab, size = [], self.vocab, len(word)
        for a in range(size):
            here = [(b, (x[0],), x[1]) for b in range(a + 1, min(size, a + self.longest) + 1) if (x := vocab.get(word[a:b]))]
            if word[a] not in vocab:
                ids = tuple(self.bytes[c] for c in word[a].encode())
                here.append((a + 1, ids, sum(self.scores[i] for i in ids)))
            out.append(here)
        return out

    @staticmethod
    def forward(edges) -> tuple[list, list]:
        best, came = [float("-inf")] * (len(edges) + 1), [None] * (len(edges) + 1)
        best[0] = 0.0
        for a, here in enumerate(edges):
            f = best[a]
            for e in here:
                if f + e[2] > best[e[0]]:
                    best[e[0]], came[e[0]] = f + e[2], (a, e)
        return best, came

    def learn(self, words: list[str]) -> None:
        """Remember each word's score, ids and gap to its second best, words of a length together."""
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for size, group in by.items():
            step = max(1, 400_000 // (size * min(size, self.longest)))
            for a in range(0, len(group), step):
                self._learn(group[a : a + step], size)

    def _pieces_at(self, sums: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have a piece from a to b, and which piece, by place in the sorted hashes."""
        keys = _range_keys(sums, a, b)
        rows = np.flatnonzero(self.some[keys >> np.uint64(42)])
        keys = keys[rows]
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        hit = self.hashes[at] == keys
        return rows[hit], at[hit]

    def _learn(self, group: list[str], size: int) -> None:
        """Forward and backward Viterbi over all words at once; the second best leaves the best by one edge at least."""
        m = len(group)
        codes = np.ascontiguousarray(np.frombuffer("".join(group).encode("utf-32-le"), "<u4").reshape(m, size).T).astype(np.uint64)
        sums = _prefix_columns(codes)
        edges: list[list[tuple]] = [[] for _ in range(size)]  # by start: (end, words, ids or -1, scores)
        for a in range(size):
            for b in range(a + 1, min(size, a + self.longest) + 1):
                rows, at = self._pieces_at(sums, a, b)
                if len(rows):
                    edges[a].append((b, rows, self.piece_ids[at], self.piece_scores[at]))
                if b == a + 1 and len(rows) < m:  # spelled by bytes
                    rest = np.ones(m, bool)
                    rest[rows] = False
                    rest = np.flatnonzero(rest)
                    edges[a].append((b, rest, np.full(len(rest), -1), np.array([sum(self.scores[self.bytes[c]] for c in group[k][a].encode()) for k in rest.tolist()])))
        best, came = np.full((size + 1, m), -np.inf), np.zeros((size + 1, m), np.int64)
        best[0] = 0.0
        for a in range(size):
            for b, rows, _, s in edges[a]:
                t = best[a, rows] + s
                better = t > best[b, rows]
                rows = rows[better]
                best[b, rows], came[b, rows] = t[better], a
        after, on = np.full((size, m), -1), np.zeros((size + 1, m), bool)
        on[size] = True
        for b in range(size, 0, -1):
            rows = np.flatnonzero(on[b])
            on[came[b, rows], rows] = True
            after[came[b, rows], rows] = b
        back, total, gap = np.full((size + 1, m), -np.inf), best[size], np.full(m, np.inf)
        back[size] = 0.0
        chosen = np.full((size, m), -2)  # -2: no piece starts here, -1: bytes
        for a in range(size - 1, -1, -1):
            for b, rows, ids, s in edges[a]:
                t = s + back[b, rows]
                back[a, rows] = np.maximum(back[a, rows], t)
                mine = after[a, rows] == b
                chosen[a, rows[mine]] = ids[mine]
                other = rows[~mine]
                gap[other] = np.minimum(gap[other], np.maximum(total[other] - best[a, other] - t[~mine], 0.0))
        chosen = np.ascontiguousarray(chosen.T)
        counts, flat = (chosen != -2).sum(axis=1), chosen[chosen != -2].astype("<u4").tobytes()
        ends = 4 * np.cumsum(counts)
        raw = [flat[x:y] for x, y in zip((ends - 4 * counts).tolist(), ends.tolist())]
        for k in np.flatnonzero((chosen == -1).any(axis=1)).tolist():  # spelled by bytes in part
            out = []
            for a in np.flatnonzero(chosen[k] != -2).tolist():
                out += [chosen[k, a]] if chosen[k, a] >= 0 else [self.bytes[c] for c in group[k][a].encode()]
            raw[k] = np.array(out, "<u4").tobytes()
        self.known.add(group, total, gap, raw)

    def word_list(self, word: str) -> list[tuple[float, tuple]]:
        """The n best of a word by backward A-star: (score, ids)."""
        if (found := self.lists.get(word)) is not None:
            return found
        edges = self.edges(word)
        best, _ = self.forward(edges)
        into: list[list] = [[] for _ in range(len(word) + 1)]
        for a, here in enumerate(edges):
            for b, ids, s in here:
                into[b].append((a, ids, s))
        heap, out, count = [(-best[-1], 0, len(word), 0.0, ())], [], 0
        while heap and len(out) < self.n:
            _, _, at, after, tail = heapq.heappop(heap)
            if not at:
                out.append((after, sum(tail, ()) if tail else ()))
                continue
            for a, ids, s in into[at]:
                count += 1
                heapq.heappush(heap, (-(best[a] + s + after), count, a, s + after, (ids, *tail)))
        if len(self.lists) >= 20_000:
            self.lists.clear()
        self.lists[word] = out
        return out

    def words(self, text: str) -> list[str]:
        """The text's words with their marks; a dummy space comes first, as the model's normalizer does."""
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked or marked[-1] == MARK:
            return _WORDS.findall(marked)
        return [MARK + w for w in marked[1:].split(MARK)]

    def prepare(self, texts: list[list[str]]) -> None:
        """Have all words of these texts in memory: two generations, the young one becoming the old one when it is full."""
        new = set().union(*texts).difference(self.known.place)
        if len(self.known.ids) + len(new) > self.max_words and self.known.ids:
            self.old, self.known = self.known, Memory()
            new = set().union(*texts)
        place = self.old.place
        again = [w for w in new if w in place]
        at = np.array([place[w] for w in again], np.int64)
        self.known.add(again, self.old.scores[at], self.old.gaps[at], [self.old.ids[k] for k in at.tolist()])
        self.learn([w for w in new if w not in place])

    def encode(self, text: str) -> list[tuple[float, np.ndarray]]:
        words = self.words(text) if text else []
        self.prepare([words])
        return self.combine(words)

    def combine(self, words: list[str]) -> list[tuple[float, np.ndarray]]:
        """The n best of a text from its words', all of them prepared."""
        if not words:
            return [(0.0, np.empty(0, "<u4"))]
        at = list(map(self.known.place.__getitem__, words))
        raw, where = list(map(self.known.ids.__getitem__, at)), np.array(at)
        out = [(float(self.known.scores[where].sum()), np.frombuffer(b"".join(raw), "<u4"))]
        # of the words in order of their second best's gap (and place), the first n - 1 are all that the n best can change
        gaps = self.known.gaps[where]
        few = self.n - 1
        near = np.flatnonzero(gaps <= np.partition(gaps, few - 1)[few - 1]) if 0 < few < len(gaps) else np.arange(len(gaps))
        near = near[np.argsort(gaps[near], kind="stable")][:few]
        lists = [(k, [(s, np.array(ids, "<u4").tobytes()) for s, ids in self.word_list(words[k])]) for k in sorted(near[gaps[near] < np.inf].tolist())]
        heap, seen = [(0.0, (0,) * len(lists))], set()
        while heap and lists and len(out) < self.n:
            lost, pick = heapq.heappop(heap)
            if any(pick):
                mine = list(raw)
                for (k, best), j in zip(lists, pick):
                    if j:
                        mine[k] = best[j][1]
                out.append((out[0][0] - lost, np.frombuffer(b"".join(mine), "<u4")))
            for i, (_, best) in enumerate(lists):
                if pick[i] + 1 < len(best):
                    after = pick[:i] + (pick[i] + 1,) + pick[i + 1 :]
                    if after not in seen:
                        seen.add(after)
                        heapq.heappush(heap, (sum(b[0][0] - b[j][0] for (_, b), j in zip(lists, after)), after))
        return out

    def decode(self, ids) -> str:
        """Pieces spelled out, byte pieces as UTF-8, marks as spaces, without the dummy space."""
        named = {i: bytes([b]) for b, i in self.bytes.items()}
        out = b"".join(named[i] if i in named else self.pieces[i].encode() for i in map(int, ids)).decode(errors="replace")
        return out.replace(MARK, " ")[1:] if out[:1] == MARK else out.replace(MARK, " ")


SCHEMA = "id long, n_pieces long, best_score double, ids_crc32 long, n_found int, nbest_scores array<double>, nbest_crc32 array<long>, round_trip boolean"


def nbest(df: DataFrame, model: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: the best segmentation's pieces, score and crc32, and scores and crc32s of the n best.

    round_trip: the best decodes to the text (a space mark in a text decodes to a space, so it does not). with_ids adds
    nbest_ids. Null and empty texts have one segmentation of no pieces and score 0. Whole texts; rows are independent, so
    repeated ids, ties and empty tables need no care. A text may have fewer than n segmentations.
    """

    def run(batches):
        lat = lattice(model, n)
        for batch in batches:
            for at, texts in text_slices(batch, 1):
                words = [lat.words(t) if t else [] for t in texts]
                lat.prepare(words)
                found = [lat.combine(w) for w in words]
                cols = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(x[0][1]) for x in found], pa.int64()),
                    pa.array([x[0][0] for x in found], pa.float64()),
                    pa.array([zlib.crc32(x[0][1]) for x in found], pa.int64()),
                    pa.array([len(x) for x in found], pa.int32()),
                    pa.array([[s for s, _ in x] for x in found], pa.list_(pa.float64())),
                    pa.array([[zlib.crc32(i) for _, i in x] for x in found], pa.list_(pa.int64())),
                    pa.array([decoded(lat, x[0][1]) == t for x, t in zip(found, texts)], pa.bool_()),
                ]
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                if with_ids:
                    cols, names = [*cols, pa.array([[i.astype(np.int32) for _, i in x] for x in found], pa.list_(pa.list_(pa.int32())))], [*names, "nbest_ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    def decoded(lat: PieceLattice, ids: np.ndarray) -> str:
        if not hasattr(lat, "spelled"):
            named = {i: bytes([b]) for b, i in lat.bytes.items()}
            lat.spelled = [named.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(lat.pieces)]
        return b"".join(map(lat.spelled.__getitem__, ids.tolist())).decode(errors="replace")[1:]

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", nbest_ids array<array<int>>" if with_ids else "")).withColumnRenamed("id", id_col)
