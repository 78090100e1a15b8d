"""Problem 1: the most similar vectors of every vector.

Method: NN-descent.  A neighbour graph starts from the exact neighbours inside
small blocks, taken in several orders of the vectors, and improves by joins of
neighbours of neighbours: around every vector its neighbours (either way) are
compared with each other, and whatever is nearer than what a vector has
replaces it, until a round changes next to nothing.  Queries walk the graph
greedily (``greedy_search``).

How it is laid out.  Vectors live in home blocks of about ``block`` vectors,
and a vector's number holds its block's.  A round ships to each block the
foreign vectors that its own are linked with, each once a block, and joins
locally with matrix products.  Nothing is ever held whole: the driver fits the
trees that order the vectors on a bounded sample, tasks hold one block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators import similarity
from furrow.session import Scratch

#: Low bits of a vector's number that count within its block.
PLACE_BITS = 13
LISTS = "pos bigint, nb array<bigint>, nd array<float>"


def usable_vectors(features: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "x") -> DataFrame:
    """(vec_id, x) of the rows with exactly ``dim`` finite entries that are not all zero."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))  # NaN sorts above infinity
    good = F.col(id_col).isNotNull() & (F.size(x) == dim) & finite & F.exists(x, lambda v: v != 0.0)
    return features.where(good).select(F.col(id_col).cast("bigint").alias("vec_id"), x.cast("array<double>").alias("x"))


# ---------------------------------------------------------------- orders


@dataclass
class Order:
    """A tree of 2-means splits and, below its leaves, hyperplanes through the leaf's mean."""

    normal: np.ndarray  # of each inner node, heap order
    offset: np.ndarray
    depth: int
    mean: np.ndarray  # of each leaf
    planes: np.ndarray  # further splits of every leaf
    along: np.ndarray  # the line that sorts a leaf's last cells

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", x, self.normal[node]) > self.offset[node]
            node = 2 * node + 1 + right
        leaf = node - (len(self.normal) if self.depth else 0)
        centred = x - self.mean[leaf]
        code = leaf
        for p in self.planes:
            code = 2 * code + (centred @ p > 0)
        return code, (centred @ self.along).astype(np.float64)


def fit_order(sample: np.ndarray, cells: int, seed: int, least: int = 12) -> Order:
    """Order with about ``cells`` cells; the tree stops where a leaf would hold under ``least`` sampled vectors."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    wanted = max(0, math.ceil(math.log2(max(1, cells))))
    depth = max(0, min(wanted, int(math.log2(max(1, len(sample) // least)))))
    n = (1 << depth) - 1
    normal, offset = np.zeros((n, dim)), np.zeros(n)
    node = np.zeros(len(sample), np.int64)
    for level in range(depth):
        for v in range((1 << level) - 1, (1 << (level + 1)) - 1):
            pts = sample[node == v]
            w = rng.normal(size=dim)
            if len(pts) > 1:
                a, b = pts[rng.choice(len(pts), 2, replace=False)]
                for _ in range(6):
                    near = ((pts - a) ** 2).sum(1) < ((pts - b) ** 2).sum(1)
                    if near.all() or not near.any():
                        break
                    a, b = pts[near].mean(0), pts[~near].mean(0)
                if (b - a).any():
                    w = b - a
            w = w / np.linalg.norm(w)
            along = pts @ w
            cut = (a + b) @ w / 2 if len(pts) > 1 else 0.0
            if len(along) and not 0.2 < (along > cut).mean() < 0.8:
                cut = np.median(along)
            normal[v], offset[v] = w, cut
        node = 2 * node + 1 + (np.einsum("ij,ij->i", sample, normal[node]) > offset[node])
    leaf = node - n
    mean = np.zeros((1 << depth, dim))
    count = np.bincount(leaf, minlength=1 << depth)
    np.add.at(mean, leaf, sample)
    mean = np.where(count[:, None] > 0, mean / np.maximum(count, 1)[:, None], sample.mean(0) if len(sample) else 0.0)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    return Order(normal, offset, depth, mean, unit(rng.normal(size=(wanted - depth, dim))), unit(rng.normal(size=dim)))


def _coder(orders: list[Order], dim: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0
            raw = x.tobytes()
            step = 8 * dim
            digest = b"".join(xxhash.xxh3_128_digest(raw[i : i + step]) for i in range(0, len(raw), step))
            h = np.frombuffer(digest, np.int64).reshape(-1, 2)
            low = x.astype(np.float32)
            vec = pa.array([r.tobytes() for r in low], pa.binary())
            columns = [batch.column(0), pa.array(h[:, 0]), pa.array(h[:, 1]), vec]
            names = ["vec_id", "h1", "h2", "v"]
            for i, o in enumerate(orders):
                code, along = o.keys(x)
                columns += [pa.array(code), pa.array(along)]
                names += [f"code{i}", f"along{i}"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


# ---------------------------------------------------------------- blocks


def _vectors(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def block_neighbours(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the k nearest others of each row, nearest first."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return np.empty((n, 0), np.int64), np.empty((n, 0), np.float32)
    c = x - x.mean(0)
    s = np.einsum("ij,ij->i", c, c)
    p = np.empty((n, k), np.int64)
    exact = np.empty((n, k), np.float32)
    for i in range(0, n, 512):
        d = s[None] - 2 * (c[i : i + 512] @ c.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        p[i : i + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
        e = x[p[i : i + 512]] - x[i : i + 512, None]
        exact[i : i + 512] = np.einsum("ijk,ijk->ij", e, e)
    o = np.argsort(exact, axis=1, kind="stable")
    return np.take_along_axis(p, o, 1), np.take_along_axis(exact, o, 1)


def _list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a sorted partition in blocks of ``size``; the last holds up to half as many more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 2 * size:
            rows = pa.Table.from_batches(held)
            at = 0
            while n - at >= 2 * size:
                yield rows.slice(at, size)
                at += size
            held, n = rows.slice(at).to_batches(), n - at
    if n:
        rows = pa.Table.from_batches(held)
        cut = n if n <= 1.5 * size else n // 2
        yield rows.slice(0, cut)
        if cut < n:
            yield rows.slice(cut)


def _number_home(size: int, k: int, dim: int, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b, rows in enumerate(_blocks(batches, size)):
            pos = (((np.int64(part) << 24) + b) << PLACE_BITS) + np.arange(rows.num_rows)
            x = _vectors(rows["v"], dim)
            near, d = block_neighbours(x, k)
            lengths = np.full(len(x), near.shape[1])
            out = pa.table({"pos": pos, **{c: rows[c] for c in ("vec_id", "h1", "h2", "v", *extra)}, "norm": np.linalg.norm(x, axis=1).astype(np.float32), "nb": _list_array(pos[near].ravel(), lengths, pa.int64()), "nd": _list_array(d.ravel(), lengths, pa.float32())})
            yield from out.to_batches()

    return run


def _block_lists(size: int, k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, size):
            pos = rows["pos"].to_numpy()
            near, d = block_neighbours(_vectors(rows["v"], dim), k)
            lengths = np.full(len(pos), near.shape[1])
            yield from pa.table({"pos": pos, "nb": _list_array(pos[near].ravel(), lengths, pa.int64()), "nd": _list_array(d.ravel(), lengths, pa.float32())}).to_batches()

    return run


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, neighbour, distance) of list rows."""
    nb, nd = rows["nb"].combine_chunks(), rows["nd"].combine_chunks()
    nb, nd = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (nb, nd))
    lengths = np.diff(nb.offsets.to_numpy())
    return np.repeat(rows["pos"].to_numpy(), lengths), nb.flatten().to_numpy(), nd.flatten().to_numpy()


def _top(a: np.ndarray, b: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest distinct b of each a: owners, list lengths, neighbours, distances."""
    o = np.lexsort((d, b, a))
    a, b, d = a[o], b[o], d[o]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, d = a[keep], b[keep], d[keep]
    o = np.lexsort((b, d, a))
    a, b, d = a[o], b[o], d[o]
    owners, first, counts = np.unique(a, return_index=True, return_counts=True)
    rank = np.arange(len(a)) - np.repeat(first, counts)
    keep = rank < k
    return owners, np.minimum(counts, k), b[keep], d[keep]


def _merge(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        old = rows.filter(pa.compute.equal(rows["kind"], 0))
        a, b, d = _flat(rows)
        owners, lengths, nb, nd = _top(a, b, d, k)
        oa, ob, _ = _flat(old)
        known = np.unique(oa * np.int64(2654435761) ^ ob)
        fresh = ~np.isin(np.repeat(owners, lengths) * np.int64(2654435761) ^ nb, known)
        starts = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=starts[1:])
        n_new = np.add.reduceat(np.append(fresh, False).astype(np.int32), starts[:-1]) if len(lengths) else np.empty(0, np.int32)
        return pa.table({"pos": owners, "nb": _list_array(nb, lengths, pa.int64()), "nd": _list_array(nd, lengths, pa.float32()), "n_new": pa.array(np.where(lengths > 0, n_new, 0), pa.int32())})

    return run


def _local_join(k: int, reverse: int, dim: int) -> Callable[[pa.Table], pa.Table]:
    """Compare the neighbours of each own vector with each other.

    kind 0: own vector, 1: visitor, a vector of another block that has an own
    one as neighbour (both with the distance that a new neighbour must beat),
    2: own list, 3: the visitors of an own vector.  Pairs of one block are
    known from the start and left out.
    """
    empty = pa.table({"pos": pa.array([], pa.int64()), "nb": pa.array([], pa.list_(pa.int64())), "nd": pa.array([], pa.list_(pa.float32()))})

    def run(rows: pa.Table) -> pa.Table:
        kind = rows["kind"].to_numpy()
        vec = rows.filter(pa.array(kind < 2)).sort_by("pos")
        ids, x = vec["pos"].to_numpy(), _vectors(vec["v"], dim)
        limit = vec["far"].to_numpy(zero_copy_only=False).astype(np.float32)
        lists = rows.filter(pa.array(kind == 2))
        limit[np.searchsorted(ids, lists["pos"].to_numpy())] = lists["far"].to_numpy()
        home = ids >> PLACE_BITS
        vu, vv, _ = _flat(rows.filter(pa.array(kind == 3)))
        if not len(vu):
            return empty
        u, v, d = _flat(lists)
        known_u, known_v = u, v
        inside = (u >> PLACE_BITS) == (v >> PLACE_BITS)
        u, v, d = u[inside], v[inside], d[inside]
        # The same links seen from the other end, the nearest ``reverse`` of each.
        o = np.lexsort((u, d, v))
        ru, rv = v[o], u[o]
        _, first, counts = np.unique(ru, return_index=True, return_counts=True)
        near = np.arange(len(ru)) - np.repeat(first, counts) < reverse
        u, v = np.concatenate([u, ru[near], vu]), np.concatenate([v, rv[near], vv])
        busy = np.isin(u, np.unique(vu))
        iu, iv = np.searchsorted(ids, u[busy]), np.searchsorted(ids, v[busy])
        key = np.unique(iu * len(ids) + iv)
        iu, iv = key // len(ids), key % len(ids)
        owners, first, counts = np.unique(iu, return_index=True, return_counts=True)
        width = counts.max() + 1
        lists = np.full((len(owners), width), -1, np.int64)
        lists[:, 0] = owners
        lists[np.repeat(np.arange(len(owners)), counts), np.arange(len(iu)) - np.repeat(first, counts) + 1] = iv
        out_a, out_b = [], []
        step = max(1, 2_000_000 // (width * max(width, dim)))
        for at in range(0, len(lists), step):
            m = lists[at : at + step]
            off = x[m] - x[m[:, :1]]
            s = np.einsum("ijk,ijk->ij", off, off)
            d = s[:, :, None] + s[:, None, :] - 2 * (off @ off.transpose(0, 2, 1))
            there = m >= 0
            site = np.where(there, home[m], -1)
            better = (d < limit[m][:, :, None] * 1.0001) & there[:, :, None] & there[:, None, :] & (site[:, :, None] != site[:, None, :])
            i, p, q = np.nonzero(better)
            out_a.append(m[i, p])
            out_b.append(m[i, q])
        key = np.unique(np.concatenate(out_a) * len(ids) + np.concatenate(out_b))
        known = np.searchsorted(ids, known_v)
        held = ids[np.minimum(known, len(ids) - 1)] == known_v
        key = key[~np.isin(key, np.searchsorted(ids, known_u[held]) * len(ids) + known[held])]
        a, b = key // len(ids), key % len(ids)
        e = x[a] - x[b]
        d = np.einsum("ij,ij->i", e, e)
        better = d < limit[a]
        own, lengths, nb, nd = _top(a[better], b[better], d[better], k)
        return pa.table({"pos": ids[own], "nb": _list_array(ids[nb], lengths, pa.int64()), "nd": _list_array(nd, lengths, pa.float32())})

    return run


# ---------------------------------------------------------------- graph


@dataclass
class VectorGraph:
    """The nodes are the distinct vectors.

    nodes: pos, vec_id (NULL where several ids, or rows, have the vector), h1,
    h2, v, norm.  lists: pos, nb, nd (squared distances), nearest first.
    shared: vec_id, h1, h2 of the ids without a node of their own.
    """

    nodes: DataFrame
    lists: DataFrame
    shared: DataFrame
    source: DataFrame
    dim: int
    k: int
    scratch: Scratch

    def placed(self) -> DataFrame:
        """(vec_id, pos) of every id."""
        some = self.nodes.where("vec_id IS NULL").select("h1", "h2", "pos")
        return self.nodes.where("vec_id IS NOT NULL").select("vec_id", "pos").unionByName(self.shared.join(some, ["h1", "h2"]).select("vec_id", "pos"))

    def named(self, most: int) -> DataFrame:
        """(pos, norm, ids): the ``most`` smallest ids of each node."""
        small = Window.partitionBy("h1", "h2").orderBy("vec_id")
        firsts = self.shared.withColumn("r", F.row_number().over(small)).where(F.col("r") <= most).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("several"))
        ids = F.when(F.col("vec_id").isNotNull(), F.array("vec_id")).otherwise(F.col("several"))
        return self.nodes.select("pos", "vec_id", "h1", "h2", "norm").join(firsts, ["h1", "h2"], "left").select("pos", "norm", ids.alias("ids")).where("ids IS NOT NULL")


def build_graph(
    features: DataFrame,
    dim: int = 50,
    k: int = 8,
    orders: int = 3,
    block: int = 3584,
    reverse: int = 8,
    max_rounds: int = 30,
    settle: float = 0.01,
    sample: int = 32768,
    seed: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "x",
    scratch: Scratch | None = None,
    trace: list[VectorGraph] | None = None,
) -> VectorGraph:
    """NN-descent over all usable vectors.

    Equal vectors are one node.  A vector id given with different vectors
    takes the one of the smaller hash.  ``sample`` bounds the vectors the
    orders are fitted on, never what is indexed.  Rounds end when less than
    ``settle`` of the list entries changed; a graph that has not settled after
    ``max_rounds`` is an error.  ``trace`` collects the graph of the start and
    of each round.  A round joins a vector's own ``k`` neighbours and, of the vectors that have it as
    neighbour, the nearest ``reverse`` of its own block and of the others
    (NN-descent's bounded reverse list, so a hub's group stays bounded); recall
    is measured in the tests.
    """
    if block * 3 // 2 >= 1 << PLACE_BITS:
        raise ValueError("block is too large")
    spark = features.sparkSession
    scratch = scratch or Scratch(spark)
    usable = usable_vectors(features, dim, id_col, vec_col)
    n = max(1, features.count())
    share = min(1.0, sample / n)
    pick = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(seed)), 12) < F.lit(int(share * (1 << 52)))
    drawn = [r.x for r in usable.where(pick).groupBy("vec_id").agg(F.min("x").alias("x")).select("x").collect()]  # about ``sample`` ids, however often each is given
    fitted = np.array(drawn, np.float64).reshape(-1, dim)
    fits = [fit_order(fitted, max(1, 2 * n // block), seed + i) for i in range(orders)]
    extra = [c for i in range(1, orders) for c in (f"code{i}", f"along{i}")]
    keys = "".join(f", code{i} bigint, along{i} double" for i in range(orders))
    coded = scratch.save(usable.mapInArrow(_coder(fits, dim), f"vec_id bigint, h1 bigint, h2 bigint, v binary{keys}"))
    ids = coded.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("h"), F.count("*").alias("c")).select("vec_id", "h.h1", "h.h2", "c")
    ids = scratch.save(ids)
    families = ids.groupBy("h1", "h2").agg(F.count("*").alias("m")).where("m > 1").select("h1", "h2")
    shared = ids.where("c > 1").select("vec_id", "h1", "h2").union(ids.join(families, ["h1", "h2"], "left_semi").select("vec_id", "h1", "h2")).distinct()
    shared = scratch.save(shared)
    parts = max(1, math.ceil(n / (4 * block)))
    # Only ids that share a vector or are given more than once need the wide de-duplication.
    alone = coded.join(shared.select("vec_id"), "vec_id", "left_anti")
    once = coded.join(shared.select("vec_id"), "vec_id", "left_semi").dropDuplicates(["h1", "h2"]).withColumn("vec_id", F.lit(None).cast("bigint"))
    ordered = alone.unionByName(once).repartitionByRange(parts, "code0", "along0", "h1", "h2").sortWithinPartitions("code0", "along0", "h1", "h2")
    more = "".join(f", code{i} bigint, along{i} double" for i in range(1, orders))
    nodes = scratch.save(ordered.mapInArrow(_number_home(block, k, dim, extra), f"pos bigint, vec_id bigint, h1 bigint, h2 bigint, v binary{more}, norm float, nb array<bigint>, nd array<float>"))
    scratch.drop(coded)
    scratch.release()
    found = nodes.select("pos", "nb", "nd")
    cand = None
    for i in range(1, orders):
        line = nodes.select("pos", "v", f"code{i}", f"along{i}").repartitionByRange(parts, f"code{i}", f"along{i}", "pos").sortWithinPartitions(f"code{i}", f"along{i}", "pos")
        got = line.select("pos", "v").mapInArrow(_block_lists(block, k, dim), LISTS)
        cand = got if cand is None else cand.unionByName(got)
    lists = _merged(found, cand, k, scratch) if cand is not None else scratch.save(found.withColumn("n_new", F.lit(0)))
    scratch.release()
    so_far = lambda: VectorGraph(nodes.select("pos", "vec_id", "h1", "h2", "v", "norm"), lists.select("pos", "nb", "nd"), shared, usable, dim, k, scratch)
    for _ in range(max_rounds):
        if trace is not None:
            trace.append(so_far())
        better = _round(nodes, lists, k, reverse, dim)
        old, lists = lists, _merged(lists.select("pos", "nb", "nd"), better, k, scratch)
        if trace is None:
            scratch.drop(old)
        scratch.release()
        if (lists.agg(F.sum("n_new")).first()[0] or 0) <= settle * n * k:
            break
    else:
        raise RuntimeError(f"the graph did not settle in {max_rounds} rounds")
    if trace is not None:
        trace.append(so_far())
    return so_far()


def _merged(old: DataFrame, new: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    site = F.shiftright("pos", PLACE_BITS).alias("site")
    rows = old.select(site, F.lit(0).alias("kind"), "pos", "nb", "nd").unionByName(new.select(site, F.lit(1).alias("kind"), "pos", "nb", "nd"))
    return scratch.save(rows.groupBy("site").applyInArrow(_merge(k), LISTS + ", n_new int"))


def _round(nodes: DataFrame, lists: DataFrame, k: int, reverse: int, dim: int) -> DataFrame:
    """Candidate lists of one round."""
    none = lambda kind: F.lit(None).cast(kind)
    site = lambda c: F.shiftright(c, PLACE_BITS)
    far = F.when(F.size("nd") >= k, F.element_at("nd", -1)).otherwise(F.lit(float("inf"))).cast("float")
    links = lists.select(F.col("pos").alias("u"), far.alias("far"), F.explode(F.arrays_zip("nb", "nd")).alias("l")).select("u", "far", F.col("l.nb").alias("v"), F.col("l.nd").alias("d"))
    nearest = Window.partitionBy("v").orderBy("d", "u")
    abroad = links.where(site("u") != site("v")).withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= reverse)
    needs = abroad.select(site("v").alias("site"), F.col("u").alias("pos"), "far").distinct()
    visitors = nodes.select("pos", "v").join(needs, "pos").select("site", F.lit(1).alias("kind"), "pos", "v", "far", none("array<bigint>").alias("nb"), none("array<float>").alias("nd"))
    own = nodes.select(site("pos").alias("site"), F.lit(0).alias("kind"), "pos", "v", none("float").alias("far"), none("array<bigint>").alias("nb"), none("array<float>").alias("nd"))
    ahead = lists.select(site("pos").alias("site"), F.lit(2).alias("kind"), "pos", none("binary").alias("v"), far.alias("far"), "nb", "nd")
    visits = abroad.groupBy("v").agg(F.collect_list("u").alias("nb"), F.collect_list("d").alias("nd")).select(
        site("v").alias("site"), F.lit(3).alias("kind"), F.col("v").alias("pos"), none("binary").alias("v"), none("float").alias("far"), "nb", "nd"
    )
    rows = own.unionByName(visitors).unionByName(ahead).unionByName(visits)
    return rows.groupBy("site").applyInArrow(_local_join(k, reverse, dim), LISTS)


# ---------------------------------------------------------------- results


def nearest(graph: VectorGraph, top: int = 5) -> DataFrame:
    """(vec_id, near_id, distance): the ``top`` nearest other vectors by the graph; ties to the smaller id.

    Copies of a vector are expanded from the ``top + 1`` smallest ids of each
    node, which is all that any list can need, so a vector that a third of all
    rows share costs one short list a row.  Distances of the graph are single
    precision; where that leaves open who is the ``top``-th, they are computed
    again from the vectors as stored.
    """
    if graph.k < top:
        raise ValueError("the graph keeps fewer neighbours than asked for")
    scratch = graph.scratch
    named = scratch.save(graph.named(top + 1))
    reach = F.arrays_zip(F.slice("nb", 1, top + 3).alias("nb"), F.slice("nd", 1, top + 3).alias("nd"))
    links = graph.lists.select("pos", F.explode(reach).alias("l")).select("pos", F.col("l.nb").alias("v"), F.sqrt(F.col("l.nd").cast("double")).alias("d"))
    there = named.select(F.col("pos").alias("v"), "ids", "norm")
    spread = links.join(there, "v").select("pos", "d", "norm", F.explode("ids").alias("id"))
    own = named.select("pos", F.lit(0.0).alias("d"), "norm", F.explode("ids").alias("id"))
    entry = F.struct("d", "id", "norm")
    ranked = spread.unionByName(own).groupBy("pos").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    # One entry is the vector itself, so places top and top + 1 (from 0) are the last kept and the first left out.
    last, after = F.get("all", F.lit(top)), F.get("all", F.lit(top + 1))
    blur = (last["norm"] + 8 * last["d"]) * 2.0**-21
    ranked = scratch.save(ranked.withColumn("open", F.coalesce((after["d"] - last["d"] <= blur) & (after["d"] > 0), F.lit(False))))
    sure = ranked.where("NOT open").select("pos", F.slice("all", 1, top + 1).alias("all"))
    doubt = scratch.save(ranked.where("open").join(named.select("pos", F.get("ids", F.lit(0)).alias("me")), "pos").select("pos", "me", F.explode("all").alias("e")).select("pos", "me", F.col("e.id").alias("id")))
    asked = doubt.select(F.col("me").alias("vec_id")).union(doubt.select("id")).distinct()
    base = graph.source.join(asked, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("x").alias("x"))
    exact = doubt.join(base.select(F.col("vec_id").alias("me"), F.col("x").alias("a")), "me").join(base.select(F.col("vec_id").alias("id"), F.col("x").alias("b")), "id")
    gap = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    again = exact.select("pos", F.struct(gap.alias("d"), F.col("id"), F.lit(0.0).cast("float").alias("norm")).alias("e")).groupBy("pos").agg(F.slice(F.sort_array(F.collect_list("e")), 1, top + 1).alias("all"))
    best = sure if doubt.isEmpty() else sure.unionByName(again)
    placed = graph.placed().join(best, "pos")
    mine = F.slice(F.filter("all", lambda e: e["id"] != F.col("vec_id")), 1, top)
    return placed.select("vec_id", F.explode(mine).alias("e")).select("vec_id", F.col("e.id").alias("near_id"), F.col("e.d").alias("distance"))


def unordered_pairs(near: DataFrame) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b, of all pairs one of which has the other as neighbour."""
    return near.select(F.least("vec_id", "near_id").alias("vec_a"), F.greatest("vec_id", "near_id").alias("vec_b")).distinct()


def _entries(points: list, starts: int, dim: int):
    """(q, pos, d): of the sampled nodes the ``starts`` nearest to each query."""
    pos = np.array([p.pos for p in points], np.int64)
    x = np.frombuffer(b"".join(bytes(p.v) for p in points), np.float32).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.einsum("ij,ij->i", x, x)
        m = min(starts, len(x))
        for b in batches:
            q = _vectors(b.column(1), dim)
            near = np.concatenate([np.argpartition(s - 2 * (q[i : i + 256] @ x.T), m - 1, axis=1)[:, :m] for i in range(0, len(q), 256)])
            e = x[near] - q[:, None]
            d = np.einsum("ijk,ijk->ij", e, e).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), m)), pa.array(pos[near].ravel()), pa.array(d.ravel())], names=["q", "pos", "d"])

    return run


def greedy_search(graph: VectorGraph, queries: DataFrame, top: int = 5, beam: int = 24, widen: int = 4, starts: int = 12, points: int = 8192, id_col: str = "vec_id", vec_col: str = "x") -> DataFrame:
    """(vec_id, near_id, distance) by greedy walks over the graph.

    ``queries`` holds ids and vectors, of the collection or not; unusable
    vectors get no row, an id given with different vectors takes the one of
    the smaller hash, and an id is not its own neighbour.  Equal query vectors
    walk once, and each of their ids gets a result.

    A query enters at the ``starts`` nearest of about ``points`` sampled nodes
    (broadcast: their number is fixed), and in each step looks at the links
    (either way) of the ``widen`` nearest nodes it has not looked at yet,
    keeping the ``beam`` nearest, until none of the beam is left to look at.
    Steps are joins on node numbers that carry no vectors but the asked
    nodes'; the number of queries is not bounded.  Copies are expanded as in
    ``nearest``, from the ``top + 1`` smallest ids of each node found; ties to
    the smaller id.
    """
    scratch, dim = graph.scratch, graph.dim
    coded = usable_vectors(queries, dim, id_col, vec_col).mapInArrow(_coder([], dim), "vec_id bigint, h1 bigint, h2 bigint, v binary")
    asked = scratch.save(coded.groupBy("vec_id").agg(F.min(F.struct("h1", "h2", "v")).alias("r")).select("vec_id", "r.*"))
    by_vector = asked.groupBy("h1", "h2").agg(F.min("vec_id").alias("q"), F.first("v").alias("qv"))
    by_vector = scratch.save(by_vector)
    vectors = by_vector.select("q", "qv")
    back = Window.partitionBy("v").orderBy("d", "u")
    links = graph.lists.select(F.col("pos").alias("u"), F.explode(F.arrays_zip("nb", "nd")).alias("l")).select("u", F.col("l.nb").alias("v"), F.col("l.nd").alias("d"))
    behind = links.withColumn("r", F.row_number().over(back)).where(F.col("r") <= graph.k).groupBy(F.col("v").alias("pos")).agg(F.collect_list("u").alias("more"))
    walk = scratch.save(graph.lists.join(behind, "pos", "left").select("pos", F.array_union("nb", F.coalesce("more", F.array().cast("array<bigint>"))).alias("nb")))
    every = max(1, graph.nodes.count() // points)
    sampled = graph.nodes.where(F.pmod(F.xxhash64("pos"), F.lit(every)) == 0).select("pos", "v").collect() or graph.nodes.select("pos", "v").orderBy("pos").limit(1).collect()
    schema = "q bigint, pos bigint, d float"
    if not sampled:
        return asked.where("false").select("vec_id", F.col("vec_id").alias("near_id"), F.lit(0.0).alias("distance"))
    found = vectors.mapInArrow(_entries(sampled, starts, dim), schema).withColumn("done", F.lit(False))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = _vectors(b.column(2), dim) - _vectors(b.column(3), dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", e, e).astype(np.float32))], names=["q", "pos", "d"])

    while True:
        nearest_first = F.row_number().over(Window.partitionBy("q").orderBy("d", "pos"))
        kept = found.withColumn("r", nearest_first).where(F.col("r") <= beam)
        turn = F.row_number().over(Window.partitionBy("q", "done").orderBy("r"))
        kept = scratch.save(kept.withColumn("look", ~F.col("done") & (turn <= widen)).drop("r"))
        looks = kept.where("look").select("q", "pos")
        state = kept.select("q", "pos", "d", (F.col("done") | F.col("look")).alias("done"))
        if looks.isEmpty():
            break
        ahead = looks.join(walk, "pos").select("q", F.explode("nb").alias("pos")).distinct()
        # Written, so that its size is known and the nodes are only shuffled where it is large.
        fresh = scratch.save(ahead.join(state.select("q", "pos"), ["q", "pos"], "left_anti"))
        met = fresh.join(graph.nodes.select("pos", "v"), "pos").join(vectors, "q").select("q", "pos", "v", "qv").mapInArrow(measure, schema)
        found = state.unionByName(met.withColumn("done", F.lit(False)))
    spread = state.join(graph.named(top + 1).select("pos", "ids"), "pos").select("q", F.sqrt(F.col("d").cast("double")).alias("d"), F.explode("ids").alias("id"))
    best = spread.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id"))), 1, top + 1).alias("all"))
    mine = F.slice(F.filter("all", lambda e: e["id"] != F.col("vec_id")), 1, top)
    each = asked.select("vec_id", "h1", "h2").join(by_vector.select("h1", "h2", "q"), ["h1", "h2"]).join(best, "q").select("vec_id", F.explode(mine).alias("e"))
    return each.select("vec_id", F.col("e.id").alias("near_id"), F.col("e.d").alias("distance"))


def nearest_of_all(graph: VectorGraph, every: int = 50, top: int = 5) -> DataFrame:
    """(id, far, n): of the ids divisible by ``every`` the number of nearest neighbours and the distance of the last, against all vectors, in blocks."""
    rows = graph.source.groupBy("vec_id").agg(F.min("x").alias("x")).select(F.col("vec_id").alias("id"), F.lit("").alias("label"), "x")
    exact = similarity.nearest(rows.where(F.col("id") % every == 0), rows, graph.dim, top + 1).where("id != near_id")
    place = F.row_number().over(Window.partitionBy("id").orderBy("dist", "near_id"))
    exact = exact.withColumn("place", place).where(F.col("place") <= top)
    return graph.scratch.save(exact.groupBy("id").agg(F.sqrt(F.max("dist")).alias("far"), F.count("*").alias("n")))


def recall(graph: VectorGraph, found: DataFrame, every: int = 50, top: int = 5, exact: DataFrame | None = None) -> DataFrame:
    """(n_queries, n_pairs, recall): share of the exact nearest neighbours of the ids divisible by ``every`` that ``found`` holds.

    A neighbour at the distance of the last exact one (``nearest_of_all``)
    counts as found, so copies that answer for each other do.
    """
    last = nearest_of_all(graph, every, top) if exact is None else exact
    near = found.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("id"), "near_id", "distance").distinct()
    hits = near.join(last, "id").where(F.col("distance") <= F.col("far") * (1 + 1e-5) + 1e-9).groupBy("id").agg(F.count("*").alias("hit"))
    both = last.join(hits, "id", "left")
    return both.agg(F.count("*").alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.round(F.try_divide(F.sum(F.least("n", F.coalesce("hit", F.lit(0)))), F.sum("n")), 4).alias("recall"))


def recall_of_rounds(trace: list[VectorGraph], top: int = 5) -> DataFrame:
    """(round, n_queries, n_pairs, recall) of the graphs of a trace; round 0 is the start."""
    exact, out = nearest_of_all(trace[0], top=top), None
    for i, graph in enumerate(trace):
        row = recall(graph, nearest(graph, top), top=top, exact=exact).select(F.lit(i).alias("round"), "*")
        out = row if out is None else out.unionByName(row)
    return out
