"""Packing by concatenate and cut.

Pass one encodes every document where it lies, without a shuffle, and notes its start in its partition. Prefix sums over
the partitions' totals (a row a partition) give each partition's place in one long row of ids, hence each document's. Pass
two cuts at multiples of the window: each document alone knows its pieces, and a boundary record is made wherever a window
ends inside a document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage
from .tokens import MOST_CHUNKS, column_slices, encoder

ENCODED = "id long, part int, local long, n long, ids binary"
PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_in_place(df: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str, max_chunks: int = MOST_CHUNKS) -> DataFrame:
    """(id, part, local, n, ids): staged ids, and each document's start among its partition's ids."""

    def run(batches):
        from pyspark import TaskContext

        enc, part, local = encoder(tokenizer, max_chunks, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, texts in column_slices(batch.column(1)):
                ids, starts = enc.encode_column(texts)
                n, places = np.diff(starts), pa.py_buffer(starts * ids.itemsize)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, places, pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(local + starts[:-1]), pa.array(n), raw],
                    names=["id", "part", "local", "n", "ids"],
                )
                local += int(starts[-1])

    return stage(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, ENCODED), "encoded")


def with_places(encoded: DataFrame) -> DataFrame:
    """Adds ``place``, a document's start in the long row of all ids."""
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return encoded.join(F.broadcast(bases), "part").withColumn("place", F.col("base") + F.col("local"))  # a row a partition


def cut(placed: DataFrame, window: int, with_ids: bool = False) -> DataFrame:
    """One row a piece; with_ids adds the piece's ids as an array."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pydict()
                out: list[list] = [[] for _ in range(8)]
                for doc, place, n, raw in zip(rows["id"], rows["place"], rows["n"], rows["ids"]):
                    ids = np.frombuffer(raw, f"<u{len(raw) // n}") if n else np.empty(0, "<u2")
                    wide = memoryview(ids.astype("<u4").tobytes())
                    start = 0
                    while start < n:
                        sequence, offset = divmod(place + start, window)
                        length = min(window - offset, n - start)
                        row = (doc, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), n, sequence, offset)
                        for k, v in enumerate(row):
                            out[k].append(v)
                        if with_ids:
                            out[7].append(ids[start : start + length].astype(np.int32))
                        start += length
                names = [x.split()[0] for x in PIECES.split(", ")]
                cols = [pa.array(x, pa.int64()) for x in out[:7]]
                if with_ids:
                    cols, names = [*cols, pa.array(out[7], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return placed.select("id", "place", "n", "ids").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def pack_documents(df: DataFrame, tokenizer: str, window: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, max_chunks: int = MOST_CHUNKS) -> DataFrame:
    """Pieces of all documents in windows of ``window`` ids; only the last window is not full.

    Null and empty texts are their end id alone (no piece if there is none). Repeated rows are packed each. An empty table
    gives no pieces. A very long text becomes many pieces and is encoded whole. max_chunks bounds what a worker remembers and
    changes no result.
    """
    pieces = cut(with_places(encode_in_place(df, tokenizer, end_id, id_col, text_col, max_chunks)), window, with_ids)
    return pieces.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids) of ``window`` ids each, from pieces with ids; a sequence gathers ``window`` pieces at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda x: x["ids"]))
    return pieces.groupBy("sequence_id").agg(ids.alias("ids")).withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - F.size("ids"))))
