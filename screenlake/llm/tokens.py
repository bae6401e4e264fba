"""Whole-text encoding with the tokenizers library, with a memory of text chunks.

A byte-level BPE splits a text before merging, and no split ever joins a character that isn't white space to a space after
it, a letter to a mark after it, or a line feed with no white space before it to a letter after it. So a text can be cut
there, and the ids of the cuts, one after the other, are the ids of the text. A run of texts is cut, and its distinct cuts are found, in
columns; most of those were seen before and are looked up; new ones go to the library many in a row, as one text, whose ids
fall apart again where a token begins with a space. The texts' ids are then gathered from the distinct cuts' at once.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Where a text holds this or a space after white space, it is cut by _CUT alone. (The library's own ``\s`` is ASCII alone.)
_BREAK = "\x01"
_ODD = f"{_BREAK}|[{''.join(filter(str.isspace, map(chr, range(0x3001))))}] "
_CUT = re.compile(r"(?<=\S)(?= )")
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
_KEPT: dict[tuple, object] = {}
#: Chunks in each of the two generations of an encoder's memory.
MOST_CHUNKS = 400_000
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def keep(key: tuple, make):
    """make(), kept in this worker from task to task until another key is asked for: one memory a worker at a time."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Forget what an earlier stage kept in this worker, and give free memory back to the system where that can be asked."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def _strings(column: pa.Array) -> list[str]:
    """As to_pylist(), which makes a scalar of each first."""
    return column.to_numpy(zero_copy_only=False).tolist()


def encoder(path: str, max_chunks: int = MOST_CHUNKS, end_id: int | None = None) -> "Encoder":
    """One encoder a worker, path, size of memory and end id, kept from task to task."""
    return keep(("encoder", path, max_chunks, end_id), lambda: Encoder(path, max_chunks, end_id))


class Encoder:
    """encode() gives each text's ids as little-endian unsigned 32-bit integers, encode_column() those of a column in a row.

    Special tokens' strings are treated as the library does by default. The memory has two generations of at most
    max_chunks chunks of at most 48 characters: when the young one is full it becomes the old one, and what is met again
    moves up, so its size is fixed and frequent chunks stay.
    """

    def __init__(self, path: str, max_chunks: int = MOST_CHUNKS, end_id: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.max_chunks, self.end_id = Tokenizer.from_file(path), max_chunks, end_id
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype, self.code = ("<u2", "H") if max(self.vocab_size, (end_id or 0) + 1) <= 65_536 else ("<u4", "I")
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # its own memory of words only costs, beside this one
        # no cut falls inside an added token
        held = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.marks, self.lines = "".join(c for c in _MARKS if c not in held), "\n" not in held
        # tokens that begin with a space, as byte-level vocabularies spell it
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(self.vocab_size)])
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _words(self, words: list[str], row: int = 200) -> dict[str, bytes]:
        """Each word's ids. Words with one space, which they begin with, and no white space at their end go in rows of
        ``row``, as a text in which only a word's own space begins a token (longer rows take more time a word); the others,
        and those of a row that falls apart otherwise, are encoded one by one."""
        in_rows = [w.rfind(" ") == 0 and not w[-1].isspace() for w in words]
        alone, rest = [w for w, x in zip(words, in_rows) if not x], [w for w, x in zip(words, in_rows) if x]
        out = dict(zip(alone, self._ids(alone)))
        rows = [rest[a : a + row] for a in range(0, len(rest), row)]
        for group, e in zip(rows, self.tokenizer.encode_batch_fast(["".join(g) for g in rows], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(group) or at[0]:
                out.update(zip(group, self._ids(group)))
                continue
            raw, ends = ids.tobytes(), (ids.itemsize * at).tolist()
            out.update(zip(group, [raw[a:b] for a, b in zip(ends, [*ends[1:], len(raw)])]))
        return out

    def _ids(self, chunks: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _known(self, words: list[str]) -> list[bytes]:
        """Distinct words' ids, from the memory or made and remembered."""
        got = list(map(self.known.get, words))
        new = [w for w, v in zip(words, got) if v is None]
        if len(self.known) + len(new) > self.max_chunks:
            self.old, self.known, new = self.known, {}, words
        found = {w: self.old[w] for w in new if w in self.old}
        found |= self._words([w for w in new if w not in found])
        room = max(0, self.max_chunks - len(self.known))
        self.known.update(islice(((w, v) for w, v in found.items() if len(w) <= 48), room))
        return [found[w] if v is None else v for w, v in zip(words, got)]

    def _cut(self, texts: pa.Array) -> pa.Array:
        """Lists of chunks whose ids, one after the other, are the texts'."""
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))
        marked = texts
        if self.marks:
            marked = pc.replace_substring_regex(marked, f"([{_LETTERS}])([{self.marks}])", f"\\1{_BREAK}\\2")
        if self.lines:
            marked = pc.replace_substring_regex(marked, f"([{_LETTERS}{_MARKS}]\n)([{_LETTERS}])", f"\\1{_BREAK}\\2")
        cut = pc.split_pattern(pc.replace_substring(marked, " ", f"{_BREAK} "), _BREAK)
        if not len(odd):
            return cut
        order = np.arange(len(texts))
        order[odd] = len(texts) + np.arange(len(odd))
        return pa.concat_arrays([cut, pa.array([_CUT.split(texts[i].as_py()) for i in odd.tolist()], cut.type)]).take(pa.array(order))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, null as empty, each text's followed by the end id if there is one; and where each text's
        begin (with the end)."""
        cut, end = self._cut(texts.fill_null("").cast(pa.large_string())), np.array([] if self.end_id is None else [self.end_id], self.dtype).tobytes()
        words, n, ends = cut.flatten().dictionary_encode(), len(cut), len(cut) if end else 0
        # chunks and ends of all texts, as places in the list of distinct ones
        starts = np.zeros(n + 1, np.int64)
        np.cumsum(cut.value_lengths().to_numpy().astype(np.int64) + (1 if end else 0), out=starts[1:])
        at, chunk = np.full(len(words) + ends, len(words.dictionary)), np.ones(len(words) + ends, bool)
        if end:
            chunk[starts[1:] - 1] = False
        at[chunk] = words.indices.to_numpy()
        row = pa.array([*self._known(_strings(words.dictionary)), end], pa.large_binary()).take(pa.array(at))
        _, places, data = row.buffers()
        places = np.frombuffer(places, np.int64, len(row) + 1, 8 * row.offset)[starts] // int(self.dtype[2]) if len(row) else starts
        return np.frombuffer(data, self.dtype, places[-1]) if places[-1] else np.empty(0, self.dtype), places

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, starts = self.encode_column(pa.array(texts, pa.large_string()))
        wide = ids.astype("<u4")
        return [wide[a:b].tobytes() for a, b in zip(starts.tolist(), starts[1:].tolist())]


def runs_within(sizes: list, most: int):
    """(from, to) of runs whose sizes add up to at most so much, one at least."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(texts: list, most: int = 1_000_000):
    """(from, to) of runs of texts with at most so many characters together, one text at least."""
    return runs_within([len(t) if t else 0 for t in texts], most)


def text_slices(batch, column: int, most_rows: int = 512):
    """(from, texts) of short runs of a record batch's string column, null as empty; whole texts, few in memory at once."""
    col = batch.column(column)
    for at in range(0, batch.num_rows, most_rows):
        texts = [t or "" for t in col.slice(at, most_rows).to_pylist()]
        for a, b in slices(texts):
            yield at + a, texts[a:b]


def column_slices(column: pa.Array, most: int = 4_000_000):
    """(from, texts) of runs of a string column with at most so many bytes together, one text at least."""
    for a, b in runs_within(pc.binary_length(column).fill_null(0).to_pylist(), most):
        yield a, column.slice(a, b - a)
