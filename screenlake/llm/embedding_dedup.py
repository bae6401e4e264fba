"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample of unit vectors so that the signs of the rotated coordinates are balanced codes
that lose little; each rotation starts from another random one. A code is cut into substrings, one table each; vectors that
agree in a whole substring meet in its bucket. Substrings grow with the logarithm of the number of vectors, which keeps
buckets small, and tables are added until ``recall`` of the sample's simulated neighbours that lie exactly at the threshold
are found (nearer ones are found more often); a plan that can't reach it raises.

Equal vectors are one class, and only classes are indexed. Buckets hold short codes first: a class that has a partner
within the Hamming radius of all simulated neighbours is live in that bucket, and only live classes are sent their
components, which are compared in double precision, so no pair below the threshold is ever linked. A pair counts in the
first table in which its codes agree, so buckets report sums of links a class and a spanning forest, never pairs. Buckets
over a fixed size are cut into blocks, and each pair of blocks is a task's work of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import drop_staged, quoted, shuffle_partitions, stage
from .tokens import release

#: Vectors that a length's rotations are learned on; rows of a bucket that are compared at once; lengths of fewer vectors
#: are one bucket.
SAMPLE, BLOCK, FEW = 8_192, 4_096, 64
HAMMING_BITS = 128


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 20) -> np.ndarray:
    """A projection [dimension, bits]: principal directions, then the rotation that brings them nearest to their signs."""
    _, _, v = np.linalg.svd(x.T @ x)
    v = v[:bits].T
    y = x @ v
    r, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((v.shape[1], v.shape[1])))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
        r = (u @ w).T
    return v @ r


class Tables:
    """projections [dimension, tables * width], mean, width and number of tables; Hamming radius and simulated recall."""

    def __init__(self, mean: np.ndarray, projection: np.ndarray, width: int):
        self.mean, self.projection, self.width, self.n = mean, projection, width, projection.shape[1] // width
        self.radius, self.recall = 0, 1.0

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.projection >= 0

    def codes(self, bits: np.ndarray) -> np.ndarray:
        """Every table's substring as a number."""
        return bits.reshape(len(bits), self.n, self.width) @ (1 << np.arange(self.width, dtype=np.int64))

    @staticmethod
    def short(bits: np.ndarray) -> np.ndarray:
        """The first HAMMING_BITS bits as two words."""
        out = np.zeros((len(bits), HAMMING_BITS), np.uint8)
        k = min(bits.shape[1], HAMMING_BITS)
        out[:, :k] = bits[:, :k]
        return np.packbits(out, axis=1).view(np.uint64)


def plan_tables(sample: np.ndarray, n: int, threshold: float, recall: float, most_tables: int = 2_000) -> Tables:
    """Tables for n vectors; sample holds unit vectors. Raises if most_tables tables do not reach the recall."""
    dimension = sample.shape[1]
    mean = sample.mean(axis=0)
    width = min(31, dimension, max(4, round(math.log2(max(n, 2))) - 4))
    per = max(1, dimension // width)
    rng = np.random.Generator(np.random.PCG64(1))
    x = sample[rng.permutation(len(sample))[:2_000]]
    x = np.concatenate([x] * -(-1_000 // len(x)))
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * u if dimension > 1 else x
    parts, found, seed = [], np.zeros(len(x), bool), 0
    while not parts or found.mean() < recall:
        if len(parts) >= most_tables:
            raise ValueError(f"{most_tables} tables find {found.mean():.3f} of neighbours at {threshold}, not {recall}")
        whole = learn_rotation((sample - mean)[:4_096], per * width, seed)
        seed += 1
        for k in range(min(per, whole.shape[1] // width)):
            parts.append(whole[:, k * width : (k + 1) * width])
            t = Tables(mean, parts[-1], width)
            found |= (t.codes(t.bits(x)) == t.codes(t.bits(y)))[:, 0]
    t = Tables(mean, np.concatenate(parts, axis=1), width)
    a, b = t.short(t.bits(x)), t.short(t.bits(y))
    t.radius, t.recall = int(np.bitwise_count(a ^ b).sum(axis=1).max()) + 1, float(found.mean())
    return t


def _kind(df: DataFrame, vec_col: str) -> str:
    return "array<float>" if "float" in dict(df.dtypes)[vec_col] else "array<double>"


def _keyed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, k1, k2) of every row: k1 and k2 are a hash of 128 bits of v; null for vectors that link with nothing."""
    v = F.col(quoted(vec_col))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.when(fine, v.cast(_kind(df, vec_col))).alias("v"))
    return rows.select("id", "v", *[F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(k))).alias(f"k{k}") for k in (1, 2)])


def _vectors(column) -> list[np.ndarray]:
    """A list column's rows, as arrays of its own kind."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy().cumsum()
    return np.split(flat, ends[:-1])


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(column):
    """(rows, matrix) of each length among a list column's rows."""
    vectors, lengths = _vectors(column), column.value_lengths().to_numpy()
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, np.stack([vectors[r] for r in rows])


def _entries(vectors: DataFrame, plans, short: bool) -> DataFrame:
    """A row a table: bucket, id, k1 and, if short, the first bits as two longs. plans: by length (place, Tables)."""
    names = ["bucket", "id", "k1", "h1", "h2"] if short else ["bucket"]

    def run(batches):
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                ids, keys = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for rows, x in _by_length(part.column(2)):
                    place, t = plans.value.get(x.shape[1], (None, None))
                    if t is None:  # a length of few vectors: one bucket
                        buckets, words = np.full((len(rows), 1), -x.shape[1], np.int64), np.zeros((len(rows), 2), np.uint64)
                    else:
                        bits = t.bits(_unit(x))
                        buckets = t.codes(bits) | (np.arange(t.n, dtype=np.int64) << 31) | (place << 42)
                        words = t.short(bits)
                    n, words = buckets.shape[1], words.view(np.int64)
                    columns = [np.ascontiguousarray(buckets.T).ravel(), *(np.tile(c, n) for c in (ids[rows], keys[rows], words[:, 0], words[:, 1]))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[: len(names)]], names=names)

    return vectors.select("id", "k1", "v").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _cells(rows: DataFrame, hot: DataFrame, *columns: str) -> DataFrame:
    """rows by (bucket, one, two): a bucket whole, or each two blocks of a large one. hot: (bucket, blocks)."""
    dealt = rows.join(hot, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "k1"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "k1", *columns)
    n = shuffle_partitions(rows.sparkSession)
    return dealt.repartition(n, "bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")


def _hot(rows: DataFrame) -> DataFrame:
    return stage(rows.groupBy("bucket").count().where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot")


def whole_cells(batches, most: int = 20_000):
    """Tables of about ``most`` rows whose cells (the first three columns) are complete, and where each cell begins."""
    held, rows = [], 0

    def starts(table) -> np.ndarray:
        a, b, c = (table.column(k).to_numpy() for k in range(3))
        return np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])) + 1])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            s = starts(table)
            if len(s) > 1:
                yield table.slice(0, int(s[-1])).combine_chunks(), s[:-1]
                table = table.slice(int(s[-1])).combine_chunks()
            held, rows = table.to_batches(), table.num_rows
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def _live(entries: DataFrame, hot: DataFrame, radius) -> DataFrame:
    """(bucket, id, k1) of the classes that have a partner within the radius in a bucket. radius: by place of a length."""

    def mark(live, h, rows, one, two, block, r) -> None:
        across = one != two
        left, right = (rows[block[rows] == one], rows[block[rows] == two]) if across else (rows, rows)
        for a in range(0, len(left), 256):
            x = left[a : a + 256]
            near = np.bitwise_count(h[x][:, None, :] ^ h[right][None, :, :]).sum(axis=2, dtype=np.int32) <= r
            if not across:
                near[np.arange(len(x)), np.arange(a, a + len(x))] = False
            live[x] |= near.any(axis=1)
            live[right] |= near.any(axis=0)

    def run(batches):
        release()
        of_place = radius.value
        for table, starts in whole_cells(batches):
            bucket, one, two, block, ids, keys, h1, h2 = (table.column(k).to_numpy() for k in range(8))
            h, live = np.stack([h1, h2], axis=1).view(np.uint64), np.zeros(len(bucket), bool)
            place = np.where(bucket < 0, -1, bucket >> 42)
            limits = np.array([*of_place, HAMMING_BITS], np.int32)[place]
            sizes = np.diff(np.concatenate([starts, [len(bucket)]]))
            left = np.repeat(sizes, sizes) - (np.arange(len(bucket)) - np.repeat(starts, sizes))  # rows of the cell from here on
            left[np.repeat(sizes > 48, sizes)] = 0
            i = np.arange(len(bucket))
            for d in range(1, 48):
                i = i[left[i] > d]
                if not len(i):
                    break
                near = np.bitwise_count(h[i] ^ h[i + d]).sum(axis=1) <= limits[i]
                live[i[near]] = live[i[near] + d] = True
            for s, n in zip(starts[sizes > 48].tolist(), sizes[sizes > 48].tolist()):
                mark(live, h, np.arange(s, s + n), one[s], two[s], block, limits[s])
            yield pa.RecordBatch.from_arrays([pa.array(c[live]) for c in (bucket, ids, keys)], names=["bucket", "id", "k1"])

    return _cells(entries, hot, "h1", "h2").mapInArrow(run, "bucket long, id long, k1 long").distinct()


def bucket_links(x: np.ndarray, weight: np.ndarray, codes, table: int, threshold: float, block: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the weights of linked rows, counted here; smallest row reachable by links) of a bucket's unit vectors.

    codes(rows) gives all tables' codes; a pair counts in the first table in which its codes agree. block: only rows of
    different blocks are compared.
    """
    m = len(x)
    counted, near = np.zeros(m, np.int64), np.zeros((m, m), bool)
    known: np.ndarray | None = None
    for a in range(0, m, 512):
        s = x[a : a + 512] @ x.T >= threshold
        s[np.arange(len(s)), np.arange(a, a + len(s))] = False
        if block is not None:
            s &= block[a : a + 512, None] != block[None, :]
        near[a : a + 512] = s
        i, j = np.nonzero(s)
        if len(i) and table and known is None:
            known = codes(np.arange(m))
        for p in range(0, len(i), 100_000):
            ii, jj = i[p : p + 100_000] + a, j[p : p + 100_000]
            if table:
                first = np.ones(len(ii), bool)
                for t in range(table):  # most pairs that met before met early
                    first[first] = known[ii[first], t] != known[jj[first], t]
                ii, jj = ii[first], jj[first]
            counted += np.bincount(ii, weights=weight[jj], minlength=m).astype(np.int64)
    label = np.arange(m)
    while True:
        new = label.copy()
        for a in range(0, m, 512):
            rows = np.flatnonzero(near[a : a + 512].any(axis=1)) + a
            if len(rows):
                new[rows] = np.minimum(new[rows], np.where(near[rows], label[None, :], m).min(axis=1))
        new = new[new]
        if (new == label).all():
            return counted, label
        label = new


def _links(rows: DataFrame, hot: DataFrame, plans, threshold: float) -> DataFrame:
    """kind 0: (id, k1, n links counted in a bucket); kind 1: a link of a spanning forest from id to n."""

    def run(batches):
        release()
        lengths = {place: t for place, t in plans.value.values()}
        for table, starts in whole_cells(batches, 5_000):
            bucket, one, two, block, ids, keys, weight = (table.column(k).to_numpy() for k in range(7))
            vectors = _vectors(table.column(7).combine_chunks())
            out: list[list] = [[], [], [], []]
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
                if e - s < 2:
                    continue
                order = s + np.lexsort((keys[s:e], ids[s:e]))
                x = _unit(np.stack([vectors[k] for k in order]))
                t = lengths[int(bucket[s]) >> 42] if bucket[s] >= 0 else None
                codes = lambda r, t=t, x=x: t.codes(t.bits(x[r]))
                counted, label = bucket_links(x, weight[order], codes, (int(bucket[s]) >> 31) & 2047 if t else 0, threshold, block[order] if one[s] != two[s] else None)
                some, own = np.flatnonzero(counted), np.flatnonzero(label != np.arange(e - s))
                for c, v in zip(out, (np.repeat([0, 1], [len(some), len(own)]), ids[order[np.concatenate([some, own])]], keys[order[np.concatenate([some, own])]], np.concatenate([counted[some], ids[order[label[own]]]]))):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["kind", "id", "k1", "n"])

    return _cells(rows, hot, "weight", "v").mapInArrow(run, "kind long, id long, k1 long, n long")


def plans_of(vectors: DataFrame, threshold: float, recall: float) -> dict[int, tuple[int, Tables]]:
    """By length of FEW vectors or more: its place, and tables learned on about SAMPLE of its vectors.

    Where there are many lengths each has a smaller sample, a thousand vectors at least, so the driver holds few.
    """
    sizes = [tuple(r) for r in vectors.groupBy(F.size("v").alias("d")).count().where(F.col("count") >= FEW).orderBy("d").collect()]
    plans = {}
    for place, (d, n) in enumerate(sizes):
        most = max(1_024, SAMPLE // len(sizes))
        rows = vectors.where((F.size("v") == d) & (F.pmod(F.col("k2"), F.lit(1 << 30)) < min(1.0, most / n) * (1 << 30)))
        rows = rows.orderBy("k2", "id").limit(2 * most).select("v").toArrow()
        x = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if rows.num_rows else np.eye(d)[:1]
        plans[d] = place, plan_tables(_unit(x), n, threshold, recall)
    return plans


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, recall: float = 0.99) -> DataFrame:
    """One row per input row: id, n_links, component_id (smallest id reachable by links), kept (id = component_id).

    Null, empty, zero vectors and those with null or non-finite components link with nothing; vectors of different lengths
    do not link with each other. n_links counts distinct vectors (id and components), so a row that repeats another counts
    once, and two different vectors of an id are two; rows that share an id are one node of components. Rows without an id
    link with nothing and have no component. Equal vectors (told by hashes of 128 bits) link if the threshold is at most 1.
    The rotations are learned on about SAMPLE vectors a length; every vector is indexed, whatever its length. An empty
    table gives an empty result.
    """
    spark = df.sparkSession
    keyed = _keyed(df, id_col, vec_col)
    usable = keyed.where("id is not null and k1 is not null")
    members = stage(usable.select("id", "k1", "k2").distinct(), "members")
    classes = stage(members.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "classes")
    reps = usable.join(classes.select(F.col("rep").alias("id"), "k1", "k2", "weight"), ["id", "k1", "k2"])
    vectors = stage(reps.groupBy("id", "k1", "k2").agg(F.first("weight").alias("weight"), F.first("v").alias("v")), "vectors")

    known = plans_of(vectors, threshold, recall)
    plans, radius = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast([t.radius for _, t in known.values()])
    hot = _hot(_entries(vectors, plans, False))
    live = stage(_live(_entries(vectors, plans, True), hot, radius), "live")
    compared = live.join(vectors.select("id", "k1", "weight", "v"), ["id", "k1"])
    found = stage(_links(compared, _hot(live), plans, threshold), "links")

    links = found.where("kind = 0").groupBy("id", "k1").agg(F.sum("n").alias("outside"))
    per_class = classes.join(links.withColumnRenamed("id", "rep"), ["rep", "k1"], "left")
    inside = F.col("weight") - 1 if threshold <= 1 else F.lit(0)
    per_class = per_class.select("k1", "k2", "rep", (inside + F.coalesce("outside", F.lit(0))).alias("n_links"))
    of_members = stage(members.join(per_class, ["k1", "k2"]), "members")
    edges = found.where("kind = 1").select(F.col("id").alias("a"), F.col("n").alias("b"))
    if threshold <= 1:
        edges = edges.unionAll(of_members.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    component = components(edges)
    drop_staged(vectors)

    result = keyed.select("id", "k1", "k2").join(of_members.select("id", "k1", "k2", "n_links"), ["id", "k1", "k2"], "left").join(component.withColumnRenamed("node", "id"), "id", "left")
    result = result.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    return result.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
