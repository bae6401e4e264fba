"""Token ids in files of fixed-width bit packing.

An id takes the fewest bits that hold the vocabulary's largest id. 64 ids of b bits fill b whole 64-bit words, so packing
and unpacking work on all groups of 64 at once in numpy, lane by lane. Ids lie in blocks of a fixed number; the file's end
holds each block's place and each document's start, so that any document or block can be read alone.

    magic | u32 bits | u32 ids a block | blocks | doc ids i64 | has id u8 | starts u64 (one more than documents) |
    block places u64 (one more than blocks) | u64 index place, documents, ids, blocks | magic
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import made_folder, shuffle_partitions, stage
from .tokens import column_slices, encoder

MAGIC = b"SLTOKEN1"
BLOCK_IDS = 65_536


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    groups = -(-len(ids) // 64)
    lanes = np.zeros(groups * 64, np.uint64)
    lanes[: len(ids)] = ids
    lanes = np.ascontiguousarray(lanes.reshape(groups, 64).T)
    words = np.zeros((bits, groups), np.uint64)
    for i in range(64):
        w, s = divmod(i * bits, 64)
        words[w] |= lanes[i] << np.uint64(s)
        if s + bits > 64:
            words[w + 1] |= lanes[i] >> np.uint64(64 - s)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    words = np.ascontiguousarray(np.frombuffer(data, "<u8").reshape(-1, bits).T)
    lanes, mask = np.empty((64, words.shape[1]), np.uint64), np.uint64((1 << bits) - 1)
    for i in range(64):
        w, s = divmod(i * bits, 64)
        x = words[w] >> np.uint64(s)
        if s + bits > 64:
            x = x | (words[w + 1] << np.uint64(64 - s))
        lanes[i] = x & mask
    return lanes.T.reshape(-1)[:n].astype("<u4")


class TokenWriter:
    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.doc_ids, self.has_id, self.starts, self.places = [], [], [0], []
        self.waiting, self.n_waiting, self.at = [], 0, 16
        out.write(MAGIC + struct.pack("<II", bits, block_ids))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.has_id.append(doc_id is not None)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 8 * self.block_ids:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        end = len(ids) if all_of_it else len(ids) // self.block_ids * self.block_ids
        for a in range(0, end, self.block_ids):
            data = pack(ids[a : min(a + self.block_ids, end)], self.bits)
            self.out.write(data)
            self.places.append(self.at)
            self.at += len(data)
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        index = np.array(self.doc_ids, "<i8").tobytes() + np.array(self.has_id, "u1").tobytes()
        index += np.array(self.starts, "<u8").tobytes() + np.array([*self.places, self.at], "<u8").tobytes()
        self.out.write(index + struct.pack("<QQQQ", self.at, len(self.doc_ids), self.starts[-1], len(self.places)) + MAGIC)


class TokenFile:
    """Random access to a file's documents and blocks; ``source`` has seek and read."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        if size < 56 or self._read(0, 8) != MAGIC or self._read(size - 8, 8) != MAGIC:
            raise ValueError("not a whole token file")
        self.bits, self.block_ids = struct.unpack("<II", self._read(8, 8))
        at, self.n_docs, self.n_ids, n_blocks = struct.unpack("<QQQQ", self._read(size - 40, 32))
        raw, n = self._read(at, size - 40 - at), self.n_docs
        self.doc_ids, self.has_id = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n)
        self.starts = np.frombuffer(raw, "<u8", n + 1, 9 * n).astype(np.int64)
        self.places = np.frombuffer(raw, "<u8", n_blocks + 1, 17 * n + 8).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("token file is cut short")
        return data

    def block(self, k: int) -> np.ndarray:
        a, b = self.places[k : k + 2]
        return unpack(self._read(int(a), int(b - a)), min(self.block_ids, self.n_ids - k * self.block_ids), self.bits)

    def doc(self, i: int) -> np.ndarray:
        a, b = int(self.starts[i]), int(self.starts[i + 1])
        if a == b:
            return np.empty(0, "<u4")
        first = a // self.block_ids
        ids = np.concatenate([self.block(k) for k in range(first, (b - 1) // self.block_ids + 1)])
        return ids[a - first * self.block_ids : b - first * self.block_ids]

    def digests(self):
        """(first document, starts, counts, crc32s) in runs; one block in memory, documents may span blocks."""
        crc, doc = 0, 0
        out: list[int] = []
        starts, n_blocks = self.starts, len(self.places) - 1
        for k in range(n_blocks):
            ids, base = self.block(k), k * self.block_ids
            data, end = memoryview(ids.tobytes()), base + len(ids)
            while doc < self.n_docs and starts[doc] < end:
                a, b = max(int(starts[doc]), base), min(int(starts[doc + 1]), end)
                crc = zlib.crc32(data[4 * (a - base) : 4 * (b - base)], crc)
                if int(starts[doc + 1]) > end:
                    break
                out.append(crc)
                crc, doc = 0, doc + 1
        out += [0] * (self.n_docs - len(out))  # documents without ids at the file's end
        return np.array(out, np.int64)


def _open(path: str, write: bool):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    if not write:
        return store.open_input_file(at)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    return store.open_output_stream(at, compression=None)


MANIFEST = "part int, path string, n_docs long, n_ids long"


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write df's texts as token files in ascending id order, one a partition; returns the staged manifest.

    Rows without an id come first. A file's name is new for each attempt and only the attempt that ends is in the manifest,
    so tasks may be lost or run twice. Texts are dealt by ranges of the id; ids of texts are made after the shuffle.
    """
    n = shuffle_partitions(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id")

    def write(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer, end_id=end_id)
        path, out, to = f"{folder}/{uuid.uuid4().hex}.tok", None, None
        for batch in batches:
            ids = batch.column(0)
            for at, texts in column_slices(batch.column(1)):
                if to is None:
                    out = _open(path, True)
                    to = TokenWriter(out, bits_for(max(enc.vocab_size, (end_id or 0) + 1)))
                row, starts = enc.encode_column(texts)
                for doc_id, a, b in zip(ids.slice(at, len(texts)).to_pylist(), starts.tolist(), starts[1:].tolist()):
                    to.add(doc_id, row[a:b])
        if to is not None:
            to.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "n_docs": [len(to.doc_ids)], "n_ids": [to.starts[-1]]})

    return stage(rows.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(id, start, n_ids, ids_crc32) of every document in the files; start counts over all files in order."""
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))
    files = files.repartition(shuffle_partitions(manifest.sparkSession))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(path, False) as source:
                    f = TokenFile(source)
                    crc = f.digests()
                    for a in range(0, f.n_docs, 20_000):
                        b = min(a + 20_000, f.n_docs)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "id": pa.array(f.doc_ids[a:b], mask=f.has_id[a:b] == 0),
                                "start": f.starts[a:b] + base,
                                "n_ids": f.starts[a + 1 : b + 1] - f.starts[a:b],
                                "ids_crc32": crc[a:b],
                            }
                        )

    return files.mapInArrow(read, "id long, start long, n_ids long, ids_crc32 long")


def token_round_trip(df: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files and read them back: id, start, n_tokens, ids_crc32.

    Null and empty texts hold the end id alone. Rows that repeat an id follow each other in any order. An empty table
    writes no file. Texts are encoded whole.
    """
    folder = made_folder(df.sparkSession, "tokens")
    back = read_token_files(write_token_files(df, folder, tokenizer, end_id, id_col, text_col))
    return back.select(F.col("id").alias(id_col), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")
