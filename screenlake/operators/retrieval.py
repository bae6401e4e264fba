"""The nearest rows of stated queries, exactly: blocks of queries meet blocks of rows in one matrix product each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries, and rows, of a block.
QUERIES, ROWS = 256, 2_048


def _packed(df: DataFrame, id_col: str, vec_col: str, size: int, prefix: str) -> DataFrame:
    """(ids, length, unit vectors) in blocks of at most ``size`` of one length, made where the rows lie. Rows without an id,
    and vectors that are null, empty, zero or not finite, are left out: they are near nothing."""

    def block(rows: list):
        x = np.array([v for _, v in rows], np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return pa.RecordBatch.from_arrays([pa.array([[i for i, _ in rows]], pa.list_(pa.int64())), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=[f"{prefix}_ids", f"{prefix}_length", f"{prefix}_data"])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or None in v or not np.isfinite(v).all() or not any(v):
                    continue
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == size:
                    yield block(held.pop(len(v)))
        for rows in held.values():
            yield block(rows)

    return df.select(F.col(id_col).cast("long"), vec_col).mapInArrow(run, f"{prefix}_ids array<long>, {prefix}_length int, {prefix}_data binary")


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): the k rows of largest cosine of every query, itself left out; ties by id.

    Each pair of blocks keeps k rows a query, so what is ranked is in proportion to queries times blocks.
    """
    pairs = _packed(rows, id_col, vec_col, ROWS, "r").crossJoin(_packed(queries, id_col, vec_col, QUERIES, "q")).where("r_length = q_length")  # blocks, not rows

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, n, data, query_ids, _, query_data = (batch.column(j)[at].as_py() for j in range(6))
                ids, query_ids = np.array(ids, np.int64), np.array(query_ids, np.int64)
                s = np.frombuffer(query_data, np.float64).reshape(-1, n) @ np.frombuffer(data, np.float64).reshape(-1, n).T
                s = np.where(query_ids[:, None] == ids[None, :], -np.inf, s)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, axis=1)
                keep = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, keep.sum(axis=1))), pa.array(ids[order][keep]), pa.array(best[keep])], names=["query_id", id_col, "similarity"])

    found = pairs.mapInArrow(run, f"query_id long, {id_col} long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
