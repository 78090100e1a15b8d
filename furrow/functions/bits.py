"""Segment join of 64-bit numbers few bits apart.

A number is a string of 64 letters, cut into k + s segments.  k replaced
letters leave at least s segments as they are, so two numbers within k bits
share the key of one choice of s segments: an equi-join, exact for every k and
s.  A larger s makes keys more numerous and more selective; ``plan`` takes the
one of the least cost for the sides' sizes.  Letters are only replaced, never
inserted, so a segment has one allowed position and the band of the verifying
dynamic programming is the diagonal: the number of differing bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import clean
from furrow.session import Scratch

WIDTH = 64
#: What a shuffled and sorted key costs, in verified pairs.
ROW_COST = 30
#: Keys that one task spells out, keys and pairs of one partition of the join, and numbers from which a key is cut further.
TASK_KEYS = 400_000
JOIN_KEYS = 1_000_000
JOIN_PAIRS = 20_000_000
HOT = 4096
#: One number of so many is looked at to find such keys.
LOOK = 64


def mask64(value: int) -> Column:
    """A 64-bit mask as the signed number Spark knows it by."""
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("bigint")


def segments(positions: list[int], n: int) -> list[int]:
    """Masks of ``n`` near-equal runs of the bit positions."""
    edges = [len(positions) * i // n for i in range(n + 1)]
    return [sum(1 << p for p in positions[a:b]) for a, b in zip(edges, edges[1:])]


def choices(k: int, s: int) -> list[int]:
    """Masks of every choice of ``s`` of k + s segments of a whole number."""
    return [sum(c) for c in combinations(segments(list(range(WIDTH)), k + s), s)]


def plan(left: int, right: int, k: int, most: int = 4) -> int:
    """The number s of unchanged segments with the least cost of keys and verified pairs."""

    cost = lambda s: math.comb(k + s, s) * (left + right) * ROW_COST + pairs_met(left, right, k, s)
    return min(range(1, min(most, WIDTH - k) + 1), key=cost)


def pairs_met(left: int, right: int, k: int, s: int) -> float:
    """Pairs that share a key where bits are even."""
    return math.comb(k + s, s) * left * right / 2.0 ** (WIDTH * s / (k + s))


def _of(h: Column):
    # Spark counts a lambda's parameters, so what it closes over can't be a default.
    return lambda m, i: F.xxhash64(i, h.bitwiseAND(m))


def _within(h: Column, key: Column):
    return lambda m, i: F.xxhash64(key, i, h.bitwiseAND(m))


def keyed(hashes: DataFrame, masks: list[int]) -> DataFrame:
    """(hash, key), a key a mask; equal keys of different numbers only cost a check."""
    keys = F.transform(F.array(*map(mask64, masks)), _of(F.col("hash")))
    return hashes.select("hash", F.explode(keys).alias("key"))


def _further(hashes: DataFrame, masks: list[int], k: int, hot: DataFrame) -> DataFrame:
    """Keys of the numbers under a hot key: that key with one of k + 1 segments of the remaining bits."""
    rest = [segments([p for p in range(WIDTH) if not m >> p & 1], k + 1) for m in masks]
    at = F.transform(F.array(*map(mask64, masks)), lambda m, i: F.struct(i.alias("i"), F.xxhash64(i, F.col("hash").bitwiseAND(m)).alias("key")))
    rows = hashes.select("hash", F.explode(at).alias("c")).select("hash", "c.i", "c.key").join(hot, "key", "left_semi")
    below = F.get(F.array(*[F.array(*map(mask64, r)) for r in rest]), F.col("i"))
    return rows.select("hash", F.explode(F.transform(below, _within(F.col("hash"), F.col("key")))).alias("key"))


def _spread(hashes: DataFrame, rows: int, keys: int) -> DataFrame:
    """The numbers in as many tasks as their keys ask for."""
    return hashes.repartition(max(1, math.ceil(rows * keys / TASK_KEYS)))


def close_pairs(left: DataFrame, right: DataFrame | None, k: int, scratch: Scratch, s: int | None = None) -> DataFrame:
    """Pairs (a, b, bits) of the numbers ``hash`` at most ``k`` bits apart, equal ones included.

    Both sides are reduced to distinct numbers; NULL matches nothing.  Without
    ``right`` the join is of one side with itself, of pairs a < b.

    A key under which very many numbers lie (flat images share whole segments)
    is cut further by the segments of the remaining bits, so its pairs do not
    grow with the square of its numbers; which keys those are is seen from one
    number in ``LOOK``, and decides only what the join costs, never its result.
    """
    alone = right is None
    sides = [scratch.save(d.select("hash").where("hash IS NOT NULL").distinct()) for d in ([left] if alone else [left, right])]
    sizes = [d.count() for d in sides]
    s = s or plan(sizes[0], sizes[-1], k)
    masks = choices(k, s)
    wide = [_spread(d, n, len(masks)) for d, n in zip(sides, sizes)]
    parts = [[keyed(d, masks) for d in wide]]
    if max(sizes) >= LOOK * HOT // 8:
        seen = None
        for d in sides:
            some = keyed(d.where(F.pmod(F.xxhash64("hash"), F.lit(LOOK)) == 0), masks)
            seen = some if seen is None else seen.unionByName(some)
        hot = scratch.save(seen.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * LOOK >= HOT).select("key"))
        if not hot.isEmpty():
            parts = [[p.join(hot, "key", "left_anti") for p in parts[0]], [_further(d, masks, k, hot) for d in wide]]
    # The smaller side is hashed in partitions of about JOIN_KEYS short rows whatever the table's size; crowded keys are sorted.
    n = math.ceil(max(1, sum(sizes) * len(masks) / JOIN_KEYS, pairs_met(sizes[0], sizes[-1], k, s) / JOIN_PAIRS))
    out = None
    for i, p in enumerate(parts):
        x, y = p[0].withColumnRenamed("hash", "x"), p[-1].withColumnRenamed("hash", "y")
        if i == 0:
            x, y = x.repartition(n, "key"), y.repartition(n, "key")
            x, y = (x.hint("shuffle_hash"), y) if sizes[0] < sizes[-1] else (x, y.hint("shuffle_hash"))
        close = x.join(y, "key").where(clean.hamming64("x", "y") <= k)
        close = close.where("x < y") if alone else close
        out = close if out is None else out.unionByName(close)
    return out.select(F.col("x").alias("a"), F.col("y").alias("b"), clean.hamming64("x", "y").alias("bits")).distinct()


# ---- middling bounds: blocks of numbers sorted by every choice of segments

#: Numbers of a sorted block at most, those compared at once, what sorting a number costs in compared pairs, and bytes of blocks that are broadcast.
SORTED = 1 << 22
RUN = 1 << 13
SORT_COST = 60
SHIPPED = 64 << 20


def _moves(mask: int) -> list[tuple[int, int]]:
    """(bits, places to the left) of the moves that bring a mask's bits to the top; distances stay."""
    moves: dict[int, int] = {}
    for to, p in enumerate(sorted(range(WIDTH), key=lambda p: (mask >> p & 1, p))):
        moves[to - p] = moves.get(to - p, 0) | 1 << p
    return [(m, by) for by, m in moves.items()]


def _moved(x: np.ndarray, moves: list[tuple[int, int]], back: bool = False) -> np.ndarray:
    out = np.zeros_like(x)
    for m, by in moves:
        if back:
            m, by = (m << by if by >= 0 else m >> -by), -by
        part = x & np.uint64(m)
        out |= part << np.uint64(by) if by >= 0 else part >> np.uint64(-by)
    return out


def _agreeing(x: np.ndarray, mask: int, k: int, deep: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different numbers at most k bits apart, among them all that agree in the mask's bits.

    Numbers are sorted with those bits on top and compared with the next ones,
    as far as the largest run of equal bits nearby reaches.  Runs above
    ``HOT`` are cut further by k + 1 segments of the remaining bits.
    """
    moves = _moves(mask)
    y = np.sort(_moved(x, moves))
    key = y >> np.uint64(WIDTH - mask.bit_count()) if mask else np.zeros_like(y)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(first, len(y)))
    left = np.repeat(first + sizes, sizes) - np.arange(len(y)) - 1
    if deep:
        for at, n in zip(first[sizes > HOT], sizes[sizes > HOT]):
            run = _moved(y[at : at + n], moves, back=True)
            for rest in segments([p for p in range(WIDTH) if not mask >> p & 1], k + 1):
                yield from _agreeing(run, mask | rest, k, deep=False)
            left[at : at + n] = 0
    diff, bits = np.empty(RUN, np.uint64), np.empty(RUN, np.uint8)
    met: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(y), RUN):
        ahead = left[start : start + RUN]
        lo, hi = 0, len(ahead)
        for d in range(1, int(ahead.max()) + 1):
            if d % 64 == 0:
                still = np.flatnonzero(ahead >= d)
                lo, hi = still[0], still[-1] + 1
            a = y[start + lo : start + hi]
            b = y[start + lo + d : start + hi + d]
            n = len(b)
            np.bitwise_xor(a[:n], b, out=diff[:n])
            np.bitwise_count(diff[:n], out=bits[:n])
            at = np.flatnonzero(bits[:n] <= k)
            if len(at):
                met.append((a[at], b[at]))
    if met:
        yield tuple(_moved(np.concatenate(z), moves, back=True) for z in zip(*met))


def _sorter(k: int, s: int, chunks: int):
    """Pairs of two blocks, each under the first choice of segments that it agrees in."""
    parts = segments(list(range(WIDTH)), k + s)
    masks = choices(k, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b, same = np.frombuffer(r["a"], np.int64).view(np.uint64), np.frombuffer(r["b"], np.int64).view(np.uint64), r["i"] == r["j"]
                every, mine = (a, None) if same else (np.concatenate([a, b]), np.sort(a))
                for mask in masks[r["chunk"] :: chunks]:
                    for u, v in _agreeing(every, mask, k):
                        diff = u ^ v
                        seen, least = np.zeros(len(u), np.int64), np.zeros(len(u), np.uint64)
                        for p in parts:
                            agrees = ((diff & np.uint64(p)) == 0) & (seen < s)
                            seen += agrees
                            least[agrees] |= np.uint64(p)
                        keep = least == np.uint64(mask)
                        if not same:
                            inside = [mine[np.minimum(np.searchsorted(mine, z), len(mine) - 1)] == z for z in (u, v)]
                            keep &= inside[0] != inside[1]
                        if keep.any():
                            x, y = u[keep].view(np.int64), v[keep].view(np.int64)
                            yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y), "bits": np.bitwise_count(diff[keep]).astype(np.int32)})

    return run


def sorted_pairs(hashes: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b, bits), a < b, of distinct numbers ``hash`` at most ``k`` bits apart, as ``close_pairs`` gives them.

    For bounds of which a key a choice of segments would be shuffled by the
    hundred: a task holds two blocks of numbers and sorts them by some of the
    choices.  Shuffled are the blocks; a task's memory follows from ``SORTED``.
    Exact for every k; a pair comes out once, but where a run above ``HOT`` was
    cut, which the last step undoes.
    """
    spark = hashes.sparkSession
    one = scratch.save(hashes.select("hash").where("hash IS NOT NULL").distinct())
    n = one.count()
    blocks = max(1, math.ceil(n / SORTED))
    held = n if blocks == 1 else 2 * n / blocks
    s = min(range(1, min(4, WIDTH - k) + 1), key=lambda s: math.comb(k + s, s) * (SORT_COST + held / 2.0 ** (WIDTH * s / (k + s))))
    tasks = blocks * (blocks + 1) // 2
    chunks = max(1, min(math.comb(k + s, s), math.ceil(4 * spark.sparkContext.defaultParallelism / tasks)))
    named = one.withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int"))
    packed = scratch.save(named.groupBy("block").applyInArrow(_blocks, "block int, m binary"))
    left, right = packed.select(F.col("block").alias("i"), F.col("m").alias("a")), packed.select(F.col("block").alias("j"), F.col("m").alias("b"))
    ids = spark.range(0, tasks * chunks, 1, tasks * chunks).withColumn("chunk", (F.col("id") % chunks).cast("int")).withColumn("pair", (F.col("id") / chunks).cast("int"))
    where = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    cell = F.get(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in where]), F.col("pair"))
    ids = ids.select("chunk", cell.alias("cell")).select("chunk", "cell.i", "cell.j")
    if 8 * n <= SHIPPED:
        work = ids.join(F.broadcast(left), "i").join(F.broadcast(right), "j")
    else:
        work = ids.join(left, "i").join(right, "j").repartition(tasks * chunks)
    return work.mapInArrow(_sorter(k, s, chunks), "a bigint, b bigint, bits int").distinct()


# ---- wide bounds: blocks of numbers compared where one of a few segments is near

#: Numbers of a block at most, rows and pairs compared at once, and links held at once.
BLOCK = 1 << 22
ROWS = 64
TILE = 1 << 18
HELD = 1 << 21
#: Nanoseconds of a compared pair, a gathered number, a visited key and a key looked up from it: they choose the number of segments.
PAIR_NS, GATHER_NS, KEY_NS, NEAR_NS = 2.2, 2, 100_000, 25
#: Bytes that lead the sorted orders in which links to the hub are looked for, and the numbers after each that are looked at.
ORDERS = list(combinations(range(WIDTH // 8), 2))
AFTER = 96
#: Not joined with the hub at any bound.
NEVER = 255


def _blocks(rows: pa.Table) -> pa.Table:
    x = rows["hash"].combine_chunks().to_numpy()
    return pa.table({"block": [rows["block"][0].as_py()], "m": pa.array([x.tobytes()], pa.binary())}, schema=pa.schema([("block", pa.int32()), ("m", pa.binary())]))


def _share(width: int, most: int) -> float:
    """Share of even numbers of so many bits at most ``most`` bits from one."""
    return sum(math.comb(width, i) for i in range(min(most, width) + 1)) / 2.0**width


def near_segments(n: int, k: int) -> list[tuple[int, int]]:
    """(mask, bound) of segments, one of which is within its bound for every two numbers within k bits; those of the least cost for n numbers.

    The bounds of m segments add up to k - m + 1: were each exceeded, k + 1
    bits would differ.  One segment of no bits stands for comparing all.
    """
    best, least = [(0, 0)], n * n / 2 * PAIR_NS
    for m in range(2, min(8, k + 1) + 1):
        parts = segments(list(range(WIDTH)), m)[::-1]
        cuts = [(p, (k - m + 1) // m + (i < (k - m + 1) % m)) for i, p in enumerate(parts)]
        cost = 0.0
        for p, r in cuts:
            w = p.bit_count()
            keys, ball = min(n, 2.0**w), sum(math.comb(w, i) for i in range(r + 1))
            cost += n * n / 2 * _share(w, r) * (PAIR_NS + GATHER_NS * keys / max(n, 1)) + keys * (KEY_NS + ball * NEAR_NS)
        if w <= 24 and cost < least:
            best, least = cuts, cost
    return best


def _merged(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number of each component, from those of the components before links u - v."""
    x, y = u, v
    while len(x):
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
        up = np.arange(len(root))
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, up[up]):
            up = up[up]
        root = up[root]
    return root


def _forest(u: np.ndarray, v: np.ndarray, bits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of fewer than n, that join at every bound the same of n numbers as the given ones."""
    root, out = np.arange(n), []
    for d in np.unique(bits):
        at = bits == d
        before, root = root, _merged(root, u[at], v[at])
        tops = np.flatnonzero((before == np.arange(n)) & (root != np.arange(n)))
        out.append((tops, root[tops], np.full(len(tops), d, np.uint8)))
    return tuple(map(np.concatenate, zip(*out))) if out else (u, v, bits)


def _levels(bounds: list[int]) -> np.ndarray:
    """By number of bits, the least bound that holds it."""
    return np.array([min((t for t in bounds if t >= d), default=NEVER) for d in range(WIDTH + 1)], np.uint8)


def _sorted_block(rows: pa.Table) -> pa.Table:
    x = np.sort(rows["hash"].combine_chunks().to_numpy())
    return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int32()), "m": pa.array([x.tobytes()], pa.binary())})


def _turned(bounds: list[int]):
    """Links of near numbers that an order of a block, two bytes first, brings together; what it misses costs work, never the result."""
    level = _levels(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["m"], np.uint64)
                n, lead = len(x), ORDERS[r["turn"]]
                # Random numbers in plenty form one component from some bound on.
                most = min((t for t in bounds if n * _share(WIDTH, t) >= 4), default=max(bounds))
                # The last byte in memory is the highest.
                turned = x.view(np.uint8).reshape(-1, 8)[:, [p for p in range(8) if p not in lead] + list(lead)].copy().view("<u8")[:, 0]
                order = np.argsort(turned)
                y = x[order]
                close = np.zeros(RUN, bool)
                met = [(np.zeros(0, np.int64),) * 3]
                for start in range(0, n, RUN):
                    for after in range(1, AFTER + 1):
                        b = y[start + after : start + after + RUN]
                        near = np.bitwise_count(y[start : start + len(b)] ^ b)
                        np.less_equal(near, most, out=close[: len(b)])
                        close[len(b) :] = False
                        some = np.flatnonzero(close.view(np.uint64))
                        if len(some):
                            at = ((some * 8)[:, None] + np.arange(8))[close.reshape(-1, 8)[some]]
                            met.append((at + start, at + (start + after), level[near[at]]))
                u, v, d = map(np.concatenate, zip(*met))
                links = {"u": order[u].astype(np.int32), "v": order[v].astype(np.int32), "d": d.astype(np.uint8)}
                yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]], pa.int32()), "n": pa.array([n], pa.int32()), **{c: pa.array([z.tobytes()], pa.binary()) for c, z in links.items()}})

    return run


def _hub(rows: pa.Table) -> pa.Table:
    """A hub among a block's numbers, the bound at which each is seen to be joined with it (or ``NEVER``), and the links that show it."""
    n = rows["n"][0].as_py()
    u, v, d = (np.concatenate([np.frombuffer(z, t) for z in rows[c].to_pylist()]) for c, t in (("u", np.int32), ("v", np.int32), ("d", np.uint8)))
    u, v, d = _forest(u, v, d, n)
    root, roots = np.arange(n), []
    for t in np.unique(d).tolist():
        root = _merged(root, u[d == t], v[d == t])
        roots.append((t, root))
    hub = int(np.bincount(root).argmax())
    joined = np.full(n, NEVER, np.uint8)
    for t, r in reversed(roots):
        joined[r == r[hub]] = t
    cells = {"joined": joined, "u": u.astype(np.int32), "v": v.astype(np.int32), "d": d.astype(np.uint8)}
    return pa.table({"block": rows["block"][:1].cast(pa.int32()), "hub": pa.array([hub], pa.int32()), **{c: pa.array([z.tobytes()], pa.binary()) for c, z in cells.items()}})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of blocks as rows."""
    for batch in batches:
        for r in batch.to_pylist():
            x, u, v = np.frombuffer(r["m"], np.int64), np.frombuffer(r["u"], np.int32), np.frombuffer(r["v"], np.int32)
            yield pa.RecordBatch.from_pydict({"a": x[u], "b": x[v], "dist": np.frombuffer(r["d"], np.uint8).astype(np.int32)})


def _ball(width: int, most: int) -> np.ndarray:
    """Numbers of so many bits of which at most ``most`` are set."""
    return np.array([sum(1 << p for p in c) for i in range(most + 1) for c in combinations(range(width), i)], np.int64)


def _near(a: np.ndarray, b: np.ndarray | None, k: int, cuts: list[tuple[int, int]], cut: int, share: int, shares: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits) of the pairs at most k bits apart (without ``b``, of two numbers of ``a``) for which this cut is the first within its bound.

    Both sides are sorted by the cut's bits.
    """
    mask, most = cuts[cut]
    width, moves = mask.bit_count(), _moves(mask)
    before = [(np.uint64(m), r) for m, r in cuts[:cut]]
    edges, ends = (np.searchsorted(_moved(x, moves) >> np.uint64(WIDTH - width) if mask else np.zeros(len(x), np.uint64), np.arange((1 << width) + 1, dtype=np.uint64)) for x in (a, a if b is None else b))
    others = a if b is None else b
    ball = _ball(width, most)
    tiles = -(-np.diff(edges) // ROWS)
    key = np.repeat(np.arange(len(tiles)), tiles)
    first = edges[key] + ROWS * (np.arange(len(key)) - np.repeat(np.cumsum(tiles) - tiles, tiles))
    room = TILE + 8 * ROWS
    diff, bits, close = np.empty(room, np.uint64), np.empty(room, np.uint8), np.empty(room, bool)
    eights = np.arange(room // 8)
    for v, start in zip(key[share::shares].tolist(), first[share::shares].tolist()):
        stop = min(start + ROWS, int(edges[v + 1]))
        beside = v ^ ball
        if b is None:
            beside = beside[beside > v]
        lens = ends[beside + 1] - ends[beside]
        where = np.repeat(ends[beside] - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
        # Of the numbers under the same key, those from this tile on.
        own = int(edges[v + 1]) - start if b is None else 0
        if own:
            where = np.concatenate([np.arange(start, start + own), where])
        x = a[start:stop, None]
        step = max(8, TILE // len(x) // 8 * 8)
        for at in range(0, len(where), step):
            column = where[at : at + step]
            y = others[column]
            wide, size = len(y), len(x) * len(y)
            full = -(-size // 8) * 8
            np.bitwise_xor(x, y, out=diff[:size].reshape(len(x), wide))
            np.bitwise_count(diff[:size], out=bits[:size])
            np.less_equal(bits[:size], k, out=close[:size])
            close[size:full] = False
            some = eights[: full // 8][close[:full].view(np.uint64) != 0]
            if not len(some):
                continue
            # Eight at a time: most are empty.
            hit = ((some * 8)[:, None] + eights[:8])[close[:full].reshape(-1, 8)[some]]
            if before:
                apart = diff[hit]
                keep = np.ones(len(hit), bool)
                for m, r in before:
                    keep &= np.bitwise_count(apart & m) > r
                hit = hit[keep]
            i = hit // wide
            j = hit - i * wide
            if at < own:
                keep = (j + at >= own) | (j + at > i)
                hit, i, j = hit[keep], i[keep], j[keep]
            if len(hit):
                yield i + start, column[j], bits[hit]


def _few(u: np.ndarray, v: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_forest`` of the numbers that the links name."""
    named, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, d = _forest(at[: len(u)], at[len(u) :], bits, len(named))
    return named[x], named[y], d


def merger(bounds: list[int]):
    """Of all links (a, b, dist), the numbers they name and, by bound, the smallest number of each one's component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
        held += [(b["a"].to_numpy(), b["b"].to_numpy(), b["dist"].to_numpy().astype(np.uint8)) for b in batches]
        a, b, dist = map(np.concatenate, zip(*held))
        named, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v, root, out, done = at[: len(a)], at[len(a) :], np.arange(len(named)), {"vertex": named}, -1
        for t in bounds:
            new = (dist > done) & (dist <= t)
            root, done = _merged(root, u[new], v[new]), t
            out[f"t{t}"] = named[root]
        yield from pa.table(out).to_batches(max_chunksize=1 << 17)

    return run


def _comparer(k: int, cuts: list[tuple[int, int]], shares: int, bounds: list[int] | None):
    level = _levels(bounds or [k])

    def ordered(m: bytes, joined: bytes | None, hub: int | None, mask: int):
        x = np.frombuffer(m, np.uint64)
        if not joined:
            return x[np.argsort(_moved(x, _moves(mask)))], None, None
        order = np.argsort(_moved(x, _moves(mask)))
        return x[order], np.frombuffer(joined, np.uint8)[order], int(np.flatnonzero(order == hub)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, joined_a, hub_a = ordered(r["a"], r["joined_a"], r["hub_a"], cuts[r["cut"]][0])
                b, joined_b, hub_b = (None, joined_a, hub_a) if r["b"] is None else ordered(r["b"], r["joined_b"], r["hub_b"], cuts[r["cut"]][0])
                shift = 0 if b is None else len(a)
                counts = np.zeros(WIDTH + 1, np.int64)
                held: list[tuple] = []
                size, full = 0, HELD
                for i, j, bits in _near(a, b, k, cuts, r["cut"], r["share"], shares):
                    counts += np.bincount(bits, minlength=WIDTH + 1)
                    if not bounds:
                        continue
                    # What is joined with its hub at that bound stands for the hub; two such numbers need no link but one between hubs.
                    d = level[bits]
                    in_a, in_b = joined_a[i] <= d, joined_b[j] <= d
                    if b is None:
                        new = np.flatnonzero(~(in_a & in_b))
                        i, j, d, in_a, in_b = i[new], j[new], d[new], in_a[new], in_b[new]
                    if not len(i):
                        continue
                    u, v = np.where(in_a, hub_a, i), np.where(in_b, hub_b, j) + shift
                    if b is not None and len(u) > 1:
                        same = in_a & in_b
                        keep = ~same
                        for t in np.unique(d[same]):
                            keep[np.flatnonzero(same & (d == t))[0]] = True
                        u, v, d = u[keep], v[keep], d[keep]
                    held.append((u, v, d))
                    size += len(u)
                    if size >= full:
                        held = [_few(*map(np.concatenate, zip(*held)))]
                        size = len(held[0][0])
                        full = size + HELD
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"a": pa.nulls(len(at), pa.int64()), "b": pa.nulls(len(at), pa.int64()), "dist": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})
                if held:
                    every = (a if b is None else np.concatenate([a, b])).view(np.int64)
                    u, v, d = _few(*map(np.concatenate, zip(*held)))
                    yield pa.RecordBatch.from_pydict({"a": every[u], "b": every[v], "dist": pa.array(d.astype(np.int32)), "n": pa.nulls(len(u), pa.int64())})

    return run


def compared(hashes: DataFrame, k: int, scratch: Scratch, links: bool = True, bounds: list[int] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Counts (dist, n_pairs) of the pairs of distinct numbers ``hash`` at most k bits apart, and links (a, b, dist) among them.

    Links join at every bound up to k (or each of ``bounds``, which then are
    their distances) the same numbers as all pairs do, and are few: pairs are
    counted and never written.  For bounds so wide that hardly any segment is
    equal: a task holds two blocks of numbers and compares those one of whose
    segments is near (``near_segments``), about an eighth of all pairs in a
    large table.  Exact for every k.
    """
    spark = hashes.sparkSession
    bounds = sorted({min(t, k) for t in bounds or range(k + 1)} | {k}) if links else None
    one = scratch.save(hashes.select("hash").where("hash IS NOT NULL").distinct())
    n = one.count()
    blocks = max(1, math.ceil(n / BLOCK))
    named = one.withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int"))
    packed = scratch.save(named.groupBy("block").applyInArrow(_sorted_block, "block int, m binary"))
    small = 9 * n <= SHIPPED
    if links:
        turns = spark.range(0, blocks * len(ORDERS), 1, blocks * len(ORDERS)).select((F.col("id") % blocks).cast("int").alias("block"), F.floor(F.col("id") / blocks).cast("int").alias("turn"))
        turns = turns.join(F.broadcast(packed), "block") if small else turns.join(packed, "block").repartition(blocks * len(ORDERS))
        shown = scratch.save(turns.select("block", "turn", "m").mapInArrow(_turned(bounds), "block int, n int, u binary, v binary, d binary"))
        hubs = shown.groupBy("block").applyInArrow(_hub, "block int, hub int, joined binary, u binary, v binary, d binary")
        packed = scratch.save(packed.join(hubs, "block"))
    else:
        packed = packed.withColumns({"joined": F.lit(None).cast("binary"), "hub": F.lit(None).cast("int")})
    cuts = near_segments(math.ceil(n / blocks), k)
    pairs = blocks * (blocks + 1) // 2
    shares = max(1, math.ceil(6 * spark.sparkContext.defaultParallelism / (pairs * len(cuts))))
    tasks = pairs * len(cuts) * shares
    where = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    cell = F.get(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in where]), (F.col("id") % pairs).cast("int"))
    # The last segment has the least bound, so the longest tasks start first.
    turn = F.floor(F.col("id") / pairs)
    ids = spark.range(0, tasks, 1, tasks).select(F.floor(turn / shares).cast("int").alias("cut"), (turn % shares).cast("int").alias("share"), cell.alias("cell")).select("cut", "share", "cell.i", "cell.j")
    left = packed.select(F.col("block").alias("i"), F.col("m").alias("a"), F.col("joined").alias("joined_a"), F.col("hub").alias("hub_a"))
    right = packed.select(F.col("block").alias("j"), F.col("m").alias("b"), F.col("joined").alias("joined_b"), F.col("hub").alias("hub_b"))
    if blocks == 1:
        # A block alone meets itself.
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("b", "binary"), ("joined_b", "binary"), ("hub_b", "int"))]
        work = ids.join(F.broadcast(left), "i").select("*", *empty)
    else:
        alone = F.col("i") == F.col("j")
        both = ids.join(left, "i").join(right, "j") if not small else ids.join(F.broadcast(left), "i").join(F.broadcast(right), "j")
        work = both.withColumns({c: F.when(~alone, F.col(c)) for c in ("b", "joined_b", "hub_b")})
        work = work if small else work.repartition(tasks)
    found = scratch.save(work.mapInArrow(_comparer(k, cuts, shares, bounds), "a bigint, b bigint, dist int, n bigint"))
    counts = found.where("n IS NOT NULL").groupBy("dist").agg(F.sum("n").alias("n_pairs"))
    if not links:
        return counts, None
    shown = packed.select("m", "u", "v", "d").mapInArrow(_unpacked, "a bigint, b bigint, dist int")
    return counts, scratch.save(shown.unionByName(found.where("n IS NULL").select("a", "b", "dist")))
