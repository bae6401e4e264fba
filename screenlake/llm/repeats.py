"""Removal of repeated passages by prefix-free parsing.

A rolling hash over short strings sets triggers: in every window of ``length`` bytes the string of least hash is the
window's trigger, leftmost on a tie. Windows that follow each other with one trigger make a phrase, so phrases overlap by
less than a window, every window lies in exactly one phrase whole, and equal windows have equal triggers. The parse is
the table of phrases as (trigger, fingerprint, document, place); the dictionary is the distinct phrases.

Of equal phrases all but the first in corpus order are repeats, window for window; copies and long passages end here, a
row a phrase. Only phrases that share a trigger with a different phrase can share single windows: the beginnings and ends
of passages. These enter the dictionary with their bytes, are dealt by trigger, and a suffix array of the dictionary, by
prefix doubling up to the windows' length, orders the suffixes where windows start; equal neighbours are in corpus order, so
all but the first are repeats, told by their bytes.

A phrase that repeats within a task is settled in the task, so a copied text sends few rows to the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import mix, prefix_sums, range_hashes
from .staging import drop_staged, free_name, quoted, shuffle_partitions, stage
from .tokens import release

#: Bytes of the strings whose hashes set triggers; a window has length - TRIGGER + 1 of them.
TRIGGER = 24
BLOCK = 1 << 19
_PLACE = np.uint64((1 << 21) - 1)


def phrases(b: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(trigger hash, fingerprint, first window, last window, trigger place) of the phrases of at most 2 MB of bytes."""
    n = len(b) - length + 1
    if n <= 0:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    sums = prefix_sums(b)
    at = np.arange(len(b) - TRIGGER + 1)
    grams = range_hashes(sums, at, at + TRIGGER)
    least = (grams & ~_PLACE) | at.astype(np.uint64)
    width, span = length - TRIGGER + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: n], least[width - span : width - span + n])
    place = (least[:n] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.diff(place)) + 1
    lo, hi = np.concatenate([[0], new]), np.concatenate([new, [n]]) - 1
    trigger = place[lo]
    marks = mix(range_hashes(sums, lo, hi + length) + (trigger - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return grams[trigger], marks, lo, hi, trigger


def text_phrases(raws: list[bytes], length: int):
    """(text, trigger hash, fingerprint, place, windows) of the phrases of several texts; long ones block by block."""
    out: list[list] = [[], [], [], [], []]

    def put(text: np.ndarray, found, shift: np.ndarray) -> None:
        for k, v in enumerate((text, found[0], found[1], found[2] - shift, found[3] - found[2] + 1)):
            out[k].append(v)

    group, size = [], 0

    def flush() -> None:
        nonlocal group, size
        if not group:
            return
        b = np.frombuffer(b"".join(raws[i] for i in group), np.uint8)
        ends = np.cumsum([len(raws[i]) for i in group])
        starts = ends - np.array([len(raws[i]) for i in group])
        h, c, lo, hi, trigger = phrases(b, length)
        if len(h):
            # only windows inside a text count: cut phrases at the texts' ends
            k = np.searchsorted(ends, lo, "right")
            last = np.searchsorted(ends, hi, "right")
            extra = np.flatnonzero(last > k)
            if len(extra):
                rows = [(h[i], t, max(int(lo[i]), int(starts[t])), int(hi[i]), int(trigger[i])) for i in extra for t in range(int(k[i]), int(last[i]) + 1)]
                keep = np.ones(len(h), bool)
                keep[extra] = False
                h = np.concatenate([h[keep], np.array([r[0] for r in rows], np.uint64)])
                k = np.concatenate([k[keep], np.array([r[1] for r in rows], np.int64)])
                lo = np.concatenate([lo[keep], np.array([r[2] for r in rows], np.int64)])
                hi = np.concatenate([hi[keep], np.array([r[3] for r in rows], np.int64)])
                trigger = np.concatenate([trigger[keep], np.array([r[4] for r in rows], np.int64)])
            hi = np.minimum(hi, ends[k] - length)
            keep = hi >= lo
            h, k, lo, hi, trigger = h[keep], k[keep], lo[keep], hi[keep], trigger[keep]
            sums = prefix_sums(b)
            c = mix(range_hashes(sums, lo, hi + length) + (trigger - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            put(np.array(group, np.int64)[k], (h, c, lo, hi), starts[k])
        group, size = [], 0

    for i, raw in enumerate(raws):
        if len(raw) < length:
            continue
        if len(raw) > BLOCK:
            for a in range(0, len(raw) - length + 1, BLOCK):
                found = phrases(np.frombuffer(raw, np.uint8)[a : a + BLOCK + length - 1], length)
                put(np.full(len(found[0]), i, np.int64), found[:4], -np.full(len(found[0]), a, np.int64))
            continue
        if size + len(raw) > BLOCK:
            flush()
        group.append(i)
        size += len(raw)
    flush()
    kinds = (np.int64, np.uint64, np.uint64, np.int64, np.int64)
    return [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, kinds)]


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("version"), F.encode(text, "UTF-8").alias("raw"))


def _raw_slices(batch, column: int, most: int = 4_000_000):
    col, start, size = batch.column(column), 0, 0
    lengths = pa.compute.binary_length(col).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def _parse(docs: DataFrame, length: int) -> DataFrame:
    """The parse. settled: an equal phrase comes earlier in the same task; such rows are dealt anywhere."""

    def run(batches):
        release()
        waiting, n_waiting = [], 0

        def settle():
            h, c, i, v, p, n = (np.concatenate(x) for x in zip(*waiting))
            order = np.lexsort((p, v, i, c, h))
            same = np.zeros(len(h), bool)
            a, b = order[1:], order[:-1]
            same[a] = (h[a] == h[b]) & (c[a] == c[b]) & ~((i[a] == i[b]) & (v[a] == v[b]) & (p[a] == p[b]))
            h = np.where(same, mix(i.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.uint64)), h)
            for at in range(0, len(h), 100_000):
                z = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h[z].view(np.int64), c[z].view(np.int64), i[z], v[z], p[z].astype(np.int32), n[z].astype(np.int16), same[z])],
                    names=["trigger", "phrase", "id", "version", "at", "n", "settled"],
                )

        for batch in batches:
            ids, versions = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for a, b in _raw_slices(batch, 2):
                k, h, c, p, n = text_phrases(batch.column(2).slice(a, b - a).to_pylist(), length)
                if len(k):
                    waiting.append((h, c, ids[a:b][k], versions[a:b][k], p, n))
                    n_waiting += len(k)
                if n_waiting > 400_000:
                    yield from settle()
                    waiting, n_waiting = [], 0
        if waiting:
            yield from settle()

    return docs.mapInArrow(run, "trigger long, phrase long, id long, version long, at int, n short, settled boolean")


def _dictionary(docs: DataFrame, length: int) -> DataFrame:
    """The bytes of the phrases at (at, n) in column marks."""

    names, kinds = ["trigger", "id", "version", "at", "bytes"], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches):
        release()
        out: list[list] = [[], [], [], [], []]
        for batch in batches:
            ids, versions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                raw, marks = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                out[0] += [x["trigger"] for x in marks]
                out[1] += [ids[k]] * len(marks)
                out[2] += [versions[k]] * len(marks)
                out[3] += [x["at"] for x in marks]
                out[4] += [raw[x["at"] : x["at"] + x["n"] + length - 1] for x in marks]
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
                    out = [[], [], [], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return docs.mapInArrow(run, "trigger long, id long, version long, at int, bytes binary")


def suffix_ranks(b: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix of b by its first ``length`` bytes (8 or more), as if zeros followed the end.

    Prefix doubling: ranks by eight bytes, then by pairs of ranks of half the length; equal ranks are equal bytes.
    """
    padded = np.concatenate([b, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(b) + length, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(word)]
    _, rank = np.unique(word, return_inverse=True)
    have = 8
    while have < length:
        step = min(have, length - have)
        pairs = rank[:-step].astype(np.int64) * (int(rank.max()) + 1) + rank[step:]
        _, rank = np.unique(pairs, return_inverse=True)
        have += step
    return rank[: len(b)]


def _windows_of(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of phrases one after the other: each window's phrase, place in it, and place among all bytes."""
    n, starts = sizes - length + 1, np.cumsum(sizes) - sizes
    phrase = np.repeat(np.arange(len(sizes)), n)
    inner = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
    return phrase, inner, starts[phrase] + inner


def _shared_windows(dictionary: DataFrame, length: int) -> DataFrame:
    """(id, version, at, n): runs of windows that an earlier phrase of the same trigger also has.

    Phrases come sorted by trigger, document and place. The suffix array of a run of phrases, cut at the windows' length,
    puts equal windows next to each other in corpus order, and all but the first are repeats. Of a trigger whose phrases go
    on in the next run only its windows' fingerprints stay in memory.
    """

    def run(batches):
        release()
        seen, of, last = np.empty(0, np.uint64), None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                part = batch.slice(at, 5_000)
                trigger, ids, versions, places = (part.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                raws = part.column(4).to_pylist()
                b = np.frombuffer(b"".join(raws), np.uint8)
                phrase, inner, start = _windows_of(np.array([len(r) for r in raws], np.int64), length)
                ranks = suffix_ranks(b, length)[start]
                order = np.argsort(ranks, kind="stable")  # the suffix array of the windows; equal ones in corpus order
                repeat = np.zeros(len(ranks), bool)
                repeat[order[1:]] = ranks[order[1:]] == ranks[order[:-1]]
                # a row that repeats the row before whole is the same place, not a later one
                same_place = np.zeros(len(raws), bool)
                same_place[1:] = (trigger[1:] == trigger[:-1]) & (ids[1:] == ids[:-1]) & (versions[1:] == versions[:-1]) & (places[1:] == places[:-1])
                same_place[0] = last == (trigger[0], ids[0], versions[0], places[0])
                last = (trigger[-1], ids[-1], versions[-1], places[-1])
                edge = (trigger[phrase] == of) | (trigger[phrase] == trigger[-1])  # of the triggers that other runs may share
                marks = np.zeros(len(ranks), np.uint64)
                if edge.any():
                    marks[edge] = _fingerprints(b, start[edge], length)
                if of == trigger[0] and len(seen):
                    repeat |= (trigger[phrase] == of) & np.isin(marks, seen)
                keep = marks[trigger[phrase] == trigger[-1]]
                seen, of = np.union1d(seen, keep) if of == trigger[-1] else np.unique(keep), trigger[-1]
                hit = np.flatnonzero(repeat & ~same_place[phrase])
                if len(hit):
                    new = np.concatenate([[True], (np.diff(hit) != 1) | (phrase[hit[1:]] != phrase[hit[:-1]])])
                    lo = hit[new]
                    count = np.diff(np.concatenate([np.flatnonzero(new), [len(hit)]]))
                    k = phrase[lo]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(versions[k]), pa.array((places[k] + inner[lo]).astype(np.int32)), pa.array(count.astype(np.int32))], names=["id", "version", "at", "n"])

    return dictionary.mapInArrow(run, "id long, version long, at int, n int")


def _fingerprints(b: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows at ascending places, over about a megabyte at a time."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        e = max(a + 1, int(np.searchsorted(starts, starts[a] + BLOCK)))
        s = starts[a:e] - starts[a]
        out[a:e] = range_hashes(prefix_sums(b[starts[a] : starts[e - 1] + length]), s, s + length)
        a = e
    return out


def _by_document(rows: DataFrame, *what: str) -> DataFrame:
    return rows.groupBy("id", "version").agg(F.collect_list(F.struct(*what)).alias("marks"))


def _covered(n_bytes: int, marks: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of bytes in a marked window."""
    out: list[list[int]] = []
    for at, n in sorted((m["at"], m["n"]) for m in marks):
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], at + n + length - 1)
        else:
            out.append([at, at + n + length - 1])
    return [(a, b) for a, b in out]


def repeat_marks(docs: DataFrame, length: int) -> DataFrame:
    """(id, version, marks): each document's runs of repeated windows."""
    n = shuffle_partitions(docs.sparkSession)
    parse = _parse(docs, length).repartition(n, "trigger")
    place = Window.partitionBy("trigger", "phrase").orderBy("id", "version", "at")
    one = Window.partitionBy("trigger")
    found = parse.withColumn("settled", F.col("settled") | (F.rank().over(place) > 1))
    found = found.withColumn("least", F.min("phrase").over(one)).withColumn("most", F.max("phrase").over(one)).where("settled or least <> most")
    found = stage(found.select("trigger", "id", "version", "at", "n", "settled"), "phrases")
    open_at = _by_document(found.where("not settled").distinct(), "trigger", "at", "n")
    entries = _dictionary(docs.join(open_at, ["id", "version"]), length)
    shared = stage(_shared_windows(entries.repartition(n, "trigger").sortWithinPartitions("trigger", "id", "version", "at"), length), "windows")
    all_of_them = found.where("settled").select("id", "version", "at", F.col("n").cast("int").alias("n")).unionAll(shared)
    return _by_document(all_of_them, "at", "n")


def _with_marks(df: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    docs = _documents(df, id_col, text_col)
    return docs, stage(repeat_marks(docs, length), "marks")


def remove_repeats(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and spans as (from, to) pairs of bytes.

    Every byte covered by a string of ``length`` bytes that also starts earlier (smaller id, or the same text further on)
    is removed; overlaps count, matches end at a text's end, and strings are judged on the input. Null and short texts
    lose nothing beyond overlaps of themselves. Rows without an id come first in order; rows that share an id follow each
    other in the order of a hash of their texts, and rows that repeat an id and text are one place and get equal results.
    Places are ints, so a text may have up to 2 GB. Equal phrases are told by hashes of 128 bits, equal windows by their bytes;
    only a trigger with over 5,000 phrases has later ones compared with earlier runs by 64-bit hashes of their windows.
    """
    docs, marks = _with_marks(df, id_col, text_col, length)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                out: list[list] = [[] for _ in range(6)]
                for doc, raw, found in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                    spans = _covered(len(raw), found or [], length)
                    digest, at = hashlib.sha256(), 0
                    for a, b in spans:
                        digest.update(raw[at:a])
                        at = b
                    digest.update(raw[at:])
                    for col, v in zip(out, (doc, len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"from": a, "to": b} for a, b in spans])):
                        col.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    joined = docs.join(marks, ["id", "version"], "left").select("id", "raw", "marks")
    result = joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from: int, to: int>>")
    return result.withColumn("id", F.expr("nullif(id, -9223372036854775808L)")).withColumnRenamed("id", id_col)


def kept_text(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without its spans; a character that a span cuts stays whole."""
    out, at = [], 0
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:  # begins inside a character
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:  # ends inside one
            b -= 1
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode()


def without_repeats(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with its texts less their repeated passages, all rows and columns kept; texts that lose nothing stay as they are.

    As remove_repeats, but a character whose bytes a removed run cuts stays whole. A null text stays null. A column
    n_chars, if there is one, is the new text's length.
    """
    docs, marks = _with_marks(df, id_col, text_col, length)
    key, version, found = (free_name(df, c) for c in ("id_of_text", "version_of_text", "marks_of_text"))
    text = F.col(quoted(text_col))
    own = df.withColumn(key, F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(-(2**63)))).withColumn(version, F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = own.join(marks.select(F.col("id").alias(key), F.col("version").alias(version), F.col("marks").alias(found)), [key, version], "left")

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, of_texts in batches:
            yield pa.array([t.as_py() if not m.is_valid or not t.is_valid else kept_text(raw := t.as_py().encode(), _covered(len(raw), m.as_py(), length)) for t, m in zip(texts, of_texts)], pa.string())

    new = free_name(df, "kept_of_text")
    # only marked texts go to Python
    cut = F.arrow_udf(run, "string")(F.when(F.col(found).isNotNull(), text), F.col(found))
    out = joined.withColumn(new, F.coalesce(cut, text))
    types = dict(df.dtypes)

    def column(c: str):
        if c == text_col:
            return F.col(new).alias(c)
        if c == "n_chars" and types[c] in ("bigint", "int"):
            return F.length(new).cast(types[c]).alias(c)
        return F.col(quoted(c))

    return out.select(*map(column, df.columns))
