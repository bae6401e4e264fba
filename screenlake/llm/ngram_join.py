"""N-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set holds the hashes of its distinct word shingles. Equal sets are one class and only their smallest document
goes on. Two sets of Jaccard similarity t or more share one of their first n - ceil(t n) + 1 members under any order of all
shingles; here the most frequent shingles (a list of fixed size) come last, so that passages which many documents share
open no tile unless a document is little else. A tile holds the documents of one shared prefix member in order of set size.

Inside a tile, pairs in a band of sizes are compared by signatures: the parity of hashed members in a bitmap of 1024
bits or as many as members; n1 + n2 less the differing bits, halved, is no less than the overlap. Pairs never leave a tile
in number: in round one each document names its best partner in its tile, or in its block of a large tile, and those that
the exact intersection confirms make classes. A tile's smallest document goes to all its blocks, so that a large group of
near copies hangs together. In round two only documents that passed with another one, and tiles of several classes, are
looked at, and all their pairs of different classes count: a document that passes with any of them is sent its members, the
sorted arrays are intersected in the tile itself, in the first of the tiles that a pair shares, and a spanning forest of the
confirmed links leaves it. Members are sent to few of the tiles that a pair shares: a document brings the first members of
its prefix along, and a pair that has one of them in common was met in that member's tile.

A large tile of round two is cut into cells: blocks of its largest class against blocks of the others, and blocks of the
others against each other. The largest class never meets itself, so a group of near copies makes no square of its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernels import mix, shingle_sets
from .staging import drop_staged, shuffle_partitions, stage
from .tokens import release, text_slices

#: At most so many frequent shingles are put last, and a partition names at most so many.
HEAVY, HEAVY_OF_PARTITION, HEAVY_LEAST = 32_768, 8_192, 8
#: Rows, and members of their sets, of a tile that one task compares at once.
TILE, MEMBERS = 4_096, 1_000_000
#: Members of its prefix that a document brings to a tile.
HEAD = 8


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def least_overlap(n: int, m: int, percent: int) -> int:
    """The smallest intersection of linked sets of n and m members."""
    return -(-percent * (n + m) // (100 + percent))


def bitmap(members: np.ndarray) -> bytes:
    """Parities of the members hashed to a power of two of bits, at least 1024 and at least as many as there are members."""
    width = max(1024, 1 << max(0, len(members) - 1).bit_length())
    odd = np.bincount((mix(members) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def overlap_bound(n: int, a: bytes, m: int, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (n + m - int(np.bitwise_count(x ^ y).sum())) // 2


def overlap(a: bytes, b: bytes) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _keys(members: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(np.add.reduce(mix(members ^ np.uint64(s)), dtype=np.uint64).astype(np.int64)) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def _merged(hashes: list, counts: list, most: int) -> tuple[np.ndarray, np.ndarray]:
    h, back = np.unique(np.concatenate(hashes), return_inverse=True)
    c = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
    if len(h) > most:
        keep = np.sort(np.lexsort((h, -c))[:most])
        h, c = h[keep], c[keep]
    return h, c


def _documents(df: DataFrame, words: int) -> DataFrame:
    """kind 0: (id, n, k1, k2) of every document; kind 1: (id: a shingle, n: its count) of a partition's frequent ones."""

    def run(batches):
        release()
        seen, counts, waiting = [], [], 0
        for batch in batches:
            for at, texts in text_slices(batch, 1):
                sets = shingle_sets(texts, words)
                keys = [_keys(s) for s in sets]
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), batch.column(0).slice(at, n), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())],
                    names=["kind", "id", "n", "k1", "k2"],
                )
                all_of_them = np.concatenate(sets)
                seen.append(all_of_them)
                counts.append(np.ones(len(all_of_them), np.int32))
                waiting += len(all_of_them)
                if waiting > 1_000_000:
                    h, c = _merged(seen, counts, 500_000)
                    seen, counts, waiting = [h], [c], 0
        if seen:
            h, c = _merged(seen, counts, HEAVY_OF_PARTITION)
            h, c = h[c >= HEAVY_LEAST], c[c >= HEAVY_LEAST]
            zero = pa.array(np.zeros(len(h), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), pa.array(h.view(np.int64)), pa.array(c), zero, zero], names=["kind", "id", "n", "k1", "k2"])

    return df.mapInArrow(run, "kind int, id long, n long, k1 long, k2 long")


def _prefixes(df: DataFrame, words: int, percent: int, heavy: np.ndarray) -> DataFrame:
    def run(batches):
        release()
        for batch in batches:
            for at, texts in text_slices(batch, 1):
                n, k1, k2, prefix, rare, bits = [], [], [], [], [], []
                for s in shingle_sets(texts, words):
                    last = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s if len(heavy) else np.zeros(len(s), bool)
                    a, b = _keys(s)
                    n.append(len(s))
                    k1.append(a)
                    k2.append(b)
                    bits.append(bitmap(s))
                    rare.append(int((~last).sum()))
                    prefix.append(np.concatenate([s[~last], s[last]])[: prefix_length(len(s), percent) if len(s) else 0].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(rare, pa.int32()), pa.array(bits, pa.binary())],
                    names=["id", "n", "k1", "k2", "prefix", "rare", "bits"],
                )

    return df.mapInArrow(run, "id long, n long, k1 long, k2 long, prefix array<long>, rare int, bits binary")


def _sets(df: DataFrame, words: int) -> DataFrame:
    def run(batches):
        release()
        for batch in batches:
            for at, texts in text_slices(batch, 1):
                sets = shingle_sets(texts, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "members"])

    return df.mapInArrow(run, "id long, n long, members binary")


def _fold(x: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        x = (x >> width) ^ (x & ((1 << width) - 1))
    return x


def _few(nodes, sizes, classes, sides, bits, percent: int):
    """Passing pairs of a small tile, one array of (i, j, bound) with i before j by size."""
    ints = [(int.from_bytes(b, "big"), 8 * len(b)) for b in bits]
    out = []
    for i, n in enumerate(sizes):
        x, w = ints[i]
        for j in range(i + 1, len(sizes)):
            m = sizes[j]
            if 100 * n < percent * m:
                break
            if nodes[i] == nodes[j] or classes[i] == classes[j] or sides[i] == sides[j] != 0:
                continue
            y, v = ints[j]
            to = min(w, v)
            bound = (n + m - (_fold(x, w, to) ^ _fold(y, v, to)).bit_count()) // 2
            if bound >= least_overlap(n, m, percent):
                out.append((i, j, bound))
    if out:
        yield tuple(np.array(out, np.int64).T)


def _many(nodes, sizes, classes, sides, bits, percent: int):
    """As _few, for large tiles, in numpy, a few million pairs at a time."""
    nodes, n, classes, sides = (np.array(x, np.int64) for x in (nodes, sizes, classes, sides))
    widths = np.array([8 * len(b) for b in bits])
    for to in np.unique(widths):
        rows = np.flatnonzero((widths == to) | (widths == 2 * to))
        maps = np.zeros((len(rows), to // 8), np.uint8)
        for k, r in enumerate(rows):
            x = np.frombuffer(bits[r], np.uint8)
            maps[k] = x if len(x) == to // 8 else x[: len(x) // 2] ^ x[len(x) // 2 :]
        maps = maps.view(np.uint64)
        step = max(1, 4_000_000 // (len(rows) * maps.shape[1]))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            end = a + 1 + int(np.searchsorted(n[rows[a + 1 :]] * percent, 100 * n[part[-1]], "right")) if a + 1 < len(rows) else a + 1
            cols = rows[a:end]
            differ = np.bitwise_count(maps[a : a + step, None, :] ^ maps[None, a:end, :]).sum(axis=2, dtype=np.int64)
            total = n[part][:, None] + n[cols][None, :]
            bound = (total - differ) // 2
            fine = (part[:, None] < cols[None, :]) & (100 * n[part][:, None] >= percent * n[cols][None, :]) & (bound >= -(-percent * total // (100 + percent)))
            fine &= (nodes[part][:, None] != nodes[cols][None, :]) & (classes[part][:, None] != classes[cols][None, :])
            fine &= (widths[part][:, None] == to) | (widths[cols][None, :] == to)
            fine &= (sides[part][:, None] == 0) | (sides[part][:, None] != sides[cols][None, :])
            i, j = np.nonzero(fine)
            if len(i):
                yield part[i].astype(np.int64), cols[j].astype(np.int64), bound[i, j]


def passing(nodes, sizes, classes, sides, bits, percent: int):
    """Arrays (i, j, bound) of the pairs of rows, sorted by size, that may be linked.

    Rows of one class make no pair, nor do rows of one side, unless the side is 0.
    """
    if len(set(classes)) > 1:
        yield from (_few if len(nodes) <= 24 else _many)(nodes, sizes, classes, sides, bits, percent)


class Overlaps:
    """Sizes of many intersections of sorted arrays without repeats, by one search in all of them."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        known, self.rank = np.unique(flat, return_inverse=True)
        self.width = max(1, len(known))
        self.keys = np.repeat(np.arange(len(sets)), self.size) * self.width + self.rank

    def of(self, i: np.ndarray, j: np.ndarray, most: int = 1_000_000) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        if not len(self.keys):
            return out
        swap = self.size[i] > self.size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        ends = np.cumsum(self.size[i])
        a = 0
        while a < len(i):
            e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            n = self.size[i[a:e]]
            pair = np.repeat(np.arange(e - a), n)
            inner = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            probe = j[a:e][pair] * self.width + self.rank[self.start[i[a:e]][pair] + inner]
            at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            out[a:e] = np.bincount(pair[self.keys[at] == probe], minlength=e - a)
            a = e
        return out


def _best(nodes, sizes, sides, bits, percent: int):
    """Each row's pair with its nearest passing partner, as arrays of node ids."""
    n, ids = np.array(sizes, np.int64), np.array(nodes, np.int64)
    score, partner = np.full(len(n), -1.0), np.zeros(len(n), np.int64)
    for i, j, bound in passing(nodes, sizes, nodes, sides, bits, percent):
        s = np.tile(bound / (n[i] + n[j] - bound), 2)
        x, y = np.concatenate([i, j]), ids[np.concatenate([j, i])]
        order = np.lexsort((y, -s, x))
        top = order[np.concatenate([[True], np.diff(x[order]) != 0])]
        x, y, s = x[top], y[top], s[top]
        better = (s > score[x]) | ((s == score[x]) & (y < partner[x]))
        score[x[better]], partner[x[better]] = s[better], y[better]
    found = score >= 0
    return ids[found], partner[found]


def _met_before(heads: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j share one of their first members that lies before the tile's own in their prefixes (place at)."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 50_000):
        x, y = i[a : a + 50_000], j[a : a + 50_000]
        mine = np.where(np.arange(heads.shape[1]) < at[x][:, None], heads[x], -1)
        same = (mine[:, :, None] == heads[y][:, None, :]) & (mine != -1)[:, :, None]
        out[a : a + 50_000] = same.any(axis=(1, 2))
    return out


def _live(nodes, sizes, classes, sides, bits, at, heads, percent: int):
    """Rows that pass with some row of another class, unless they met before, as an array of node ids."""
    found, place, first = np.zeros(len(nodes), bool), np.array(at, np.int64), None
    for i, j, _ in passing(nodes, sizes, classes, sides, bits, percent):
        if first is None:
            first = np.full((len(nodes), HEAD), -2, np.int64)
            for k, h in enumerate(heads):
                first[k, : len(h)] = h
        new = ~_met_before(first, place, i, j)
        found[i[new]] = found[j[new]] = True
    ids = np.unique(np.array(nodes, np.int64)[found])
    return ids, ids


def forest(nodes, sizes, classes, sides, bits, at, prefixes, members, percent: int):
    """Links (arrays of node ids) that join the rows' classes, each confirmed by the exact intersection.

    A pair is looked at in the first of the prefix members that both share, so in one tile only; at: the tile's own
    member's place in each prefix.
    """
    n, ids = np.array(sizes, np.int64), np.array(nodes, np.int64)
    _, label = np.unique(np.array(classes, np.int64), return_inverse=True)
    whole = Overlaps([np.frombuffer(m, np.uint64) for m in members])
    before = Overlaps([np.sort(np.array(p[:k], np.int64)) for k, p in zip(at, prefixes)])
    out: list[tuple[int, int]] = []
    for i, j, _ in passing(nodes, sizes, classes, sides, bits, percent):
        for a in range(0, len(i), 20_000):
            x, y = i[a : a + 20_000], j[a : a + 20_000]
            fresh = label[x] != label[y]
            x, y = x[fresh], y[fresh]
            first = before.of(x, y) == 0
            x, y = x[first], y[first]
            total = n[x] + n[y]
            linked = whole.of(x, y) >= -(-percent * total // (100 + percent))
            for u, v in zip(x[linked].tolist(), y[linked].tolist()):
                if label[u] != label[v]:
                    label[label == label[v]] = label[u]
                    out.append((int(ids[u]), int(ids[v])))
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _in_cells(rows: DataFrame, keys: list[str], columns: list[str], of) -> DataFrame:
    """of(*columns) -> (a, b) arrays, over each cell's rows in order of size; h is the first key."""
    n, width = shuffle_partitions(rows.sparkSession), len(keys)

    def run(batches):
        release()
        key, cell, out, waiting = None, [], [], 0

        def results():
            a, b = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.concatenate(of_h))], names=["a", "b", "h"])

        of_h: list[np.ndarray] = []

        def done():
            nonlocal waiting
            if len(cell) > 1:
                found = of(*zip(*cell))
                if len(found[0]):
                    out.append(found)
                    of_h.append(np.full(len(found[0]), key[0], np.int64))
                    waiting += len(found[0])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(width + len(columns))]
            for row in zip(*cols):
                if row[:width] != key:
                    done()
                    key, cell = row[:width], []
                    if waiting > 10_000:
                        yield results()
                        out, of_h, waiting = [], [], 0
                cell.append(row[width:])
        done()
        if out:
            yield results()

    dealt = rows.select(*keys, *columns).repartition(n, *keys).sortWithinPartitions(*keys, "size", "node")
    return dealt.mapInArrow(run, "a long, b long, h long")


def _large_tiles(tiles: DataFrame) -> DataFrame:
    large = tiles.groupBy("h").agg(F.count("*").alias("rows"), F.min("node").alias("first")).where(F.col("rows") > TILE)
    return stage(large.select("h", "first", F.ceil(F.col("rows") / TILE).cast("int").alias("blocks")), "hot")


def _best_pairs(tiles: DataFrame, hot: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Round one: pairs (a, b) of nodes and their best partners in a block of a tile of (h, node, size)."""
    dealt = tiles.join(hot, "h", "left")
    own = F.pmod(F.xxhash64("h", "node"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    dealt = dealt.select("h", "block", "node", "size").join(prefixes.select("node", "bits"), "node")
    return _in_cells(dealt, ["h", "block"], ["node", "size", "bits"], lambda nodes, sizes, bits: _best(nodes, sizes, [0] * len(nodes), bits, percent)).select("a", "b").distinct()


def _cells(tiles: DataFrame, most_rows: int, most_members: int) -> DataFrame:
    """(h, kind, one, two, side, at, node, size, class) of tiles of several classes; a row comes once in each of its cells.

    Kind 0: a small tile whole. Kind 1: a block of the largest class against a block of the others. Kind 2: two blocks of
    the others. In each two rows of different sides meet, and in side 0 all rows.
    """
    each = tiles.groupBy("h", "class").agg(F.count("*").alias("rows"), F.sum("size").alias("members"))
    several = each.groupBy("h").agg(F.count("*").alias("classes"), F.sum("rows").alias("rows"), F.sum("members").alias("members"), F.max(F.struct("rows", "class", "members")).alias("top")).where("classes > 1")
    blocks = lambda r, m: F.greatest(F.lit(1), F.ceil(r / most_rows), F.ceil(m / most_members)).cast("int")
    several = several.select(
        "h",
        ((F.col("rows") > most_rows) | (F.col("members") > most_members)).alias("big"),
        F.col("top.class").alias("main"),
        blocks(F.col("top.rows"), F.col("top.members")).alias("n_main"),
        blocks(F.col("rows") - F.col("top.rows"), F.col("members") - F.col("top.members")).alias("n_rest"),
    )
    dealt = tiles.join(stage(several, "several"), "h")
    main = F.col("class") == F.col("main")
    cell = lambda k, a, b, s: F.struct(F.lit(k).alias("kind"), a.alias("one"), b.alias("two"), s.alias("side"))
    zero = F.lit(0)
    block = F.col("block")
    to_rest = F.transform(F.sequence(zero, F.col("n_rest") - 1), lambda c: cell(1, block, c, F.lit(2)))
    to_main = F.transform(F.sequence(zero, F.col("n_main") - 1), lambda b: cell(1, b, block, F.lit(1)))
    among = F.transform(F.sequence(zero, F.col("n_rest") - 1), lambda c: cell(2, F.least(block, c), F.greatest(block, c), F.when(block == c, 0).otherwise(block + 1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("h", "node"), F.when(main, F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    dealt = dealt.withColumn("cell", F.explode(F.when(~F.col("big"), F.array(cell(0, zero, zero, zero))).when(main, to_rest).otherwise(F.concat(to_main, among))))
    return dealt.select("h", "cell.*", "at", "node", "size", "class")


def _forest_links(tiles: DataFrame, prefixes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Round two: confirmed links (a, b) between the classes of tiles (h, at, node, size, class)."""
    keys = ["h", "kind", "one", "two"]
    cells = _cells(tiles, TILE, 1 << 62).join(prefixes.select("node", "bits", F.slice("prefix", 1, HEAD).alias("head")), "node")
    live = _in_cells(cells, keys, ["node", "size", "class", "side", "bits", "at", "head"], lambda *columns: _live(*columns, percent))
    live = stage(live.select("h", F.col("a").alias("node")).distinct(), "live")
    live = stage(live.join(tiles, ["h", "node"]).select("h", "at", "node", "size", "class"), "live")
    sets = _sets(docs.join(live.select(F.col("node").alias("id")).distinct(), "id", "left_semi"), words)
    sets = stage(sets.select(F.col("id").alias("node"), F.col("n").alias("size"), "members"), "members")
    exact = _cells(live, TILE, MEMBERS).join(prefixes.select("node", "bits", "prefix"), "node").join(sets, ["node", "size"])
    links = stage(_in_cells(exact, keys, ["node", "size", "class", "side", "bits", "at", "prefix", "members"], lambda *columns: forest(*columns, percent)).select("a", "b"), "links")
    drop_staged(sets)
    return links


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose whole sets are similar enough."""

    def run(batches):
        for batch in batches:
            r = batch.to_pydict()
            keep = [overlap(x, y) >= least_overlap(n, m, percent) for n, m, x, y in zip(r["n"], r["m"], r["x"], r["y"])]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    def side(name: str, n: str, to: str) -> DataFrame:
        return sets.select(F.col("id").alias(name), F.col("n").alias(n), F.col("members").alias(to))

    both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    return stage(both.mapInArrow(run, "a long, b long"), "links")


def ngram_join(df: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Links: 100 * intersection >= percent * union of the shingle sets. Null and empty texts, and texts of white space, have
    no shingles and link with nothing; a text of fewer words than a shingle has its whole sequence as its one shingle. Rows
    that share an id are one node. Rows without an id are their own component, null. Empty tables give an empty result.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    first = stage(_documents(docs, words), "sets")
    rows = first.where("kind = 0")
    reps = stage(rows.where("n > 0 and id is not null").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep")), "classes")
    frequent = first.where("kind = 1").groupBy("id").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "id").limit(HEAVY)
    heavy = np.sort(np.array([r[0] for r in frequent.select("id").collect()], np.int64).view(np.uint64))  # HEAVY rows at most

    prefixes = _prefixes(docs, words, percent, heavy).join(reps.select(F.col("rep").alias("id"), "n", "k1", "k2"), ["id", "n", "k1", "k2"], "left_semi")
    prefixes = stage(prefixes.select(F.col("id").alias("node"), F.col("n").alias("size"), "prefix", "rare", "bits"), "prefixes")
    members = prefixes.select(F.posexplode("prefix").alias("pos", "h"), "node", "size", "rare")
    # a rare member's rows without a neighbour of fitting size open no tile; frequent members' rows, few of them, stay
    by_size = Window.partitionBy("h").orderBy("size", "node")
    rare = members.where("pos < rare").withColumn("prev", F.lag("size").over(by_size)).withColumn("next", F.lead("size").over(by_size))
    rare = rare.where((100 * F.col("prev") >= percent * F.col("size")) | (100 * F.col("size") >= percent * F.col("next")))
    wide = ["h", F.col("pos").alias("at"), "node", "size"]
    tiles = stage(rare.select(*wide).unionAll(members.where("pos >= rare").select(*wide)), "tiles")

    hot = _large_tiles(tiles)
    best = stage(_best_pairs(tiles, hot, prefixes, percent), "pairs")
    wanted = stage(best.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    sets = stage(_sets(docs.join(wanted, "id", "left_semi"), words), "members")
    links = _verified(best, sets, percent)
    drop_staged(sets)
    # who passed with nobody in round one can do so only across the blocks of a large tile
    open_ = wanted.select(F.col("id").alias("node")).unionAll(tiles.join(hot, "h", "left_semi").select("node")).distinct()
    so_far = open_.join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("class"))
    classed = stage(tiles.join(so_far, "node").select("h", "at", "node", "size", "class"), "classed")
    more = _forest_links(classed, prefixes, docs, words, percent)
    final = components(links.unionAll(more))

    classes = stage(reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component")), "classes")
    for done in (prefixes, tiles, classed, best, wanted):
        drop_staged(done)
    return rows.join(classes, ["n", "k1", "k2"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
