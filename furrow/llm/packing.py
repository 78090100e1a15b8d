"""Problem 6: filling fixed-capacity containers.

Method: bin completion.  The largest remaining item opens a container, filled
around it as well as can be; that packing is the incumbent.  Branch and bound
then branches over the undominated fillings of each largest size and is pruned
by the total waste, until the least number is proven or a stated budget of
nodes is used up.  Equal sizes are interchangeable, so the search works on the
histogram of sizes, which the capacity bounds whatever the number of items: a
filling found once is used as often as its sizes last.  Items then find their
container by their rank within their size, which is counted without ever
bringing a size's items together.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.text import spread
from furrow.session import Scratch

#: Where the public vocabulary files are, and which one sizes are counted with.
VOCABULARIES = os.environ.get("FURROW_VOCABULARIES", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern of this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _counter(path: str):
    import tiktoken

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
        encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; NULL and empty texts have 0 tokens."""
    path = vocabulary or f"{VOCABULARIES}/{VOCABULARY}"
    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(rows).mapInArrow(_counter(path), "doc_id bigint, n_tokens bigint")


@dataclass
class Filling:
    """Sizes with their multiplicity, used for ``times`` containers."""

    parts: dict[int, int]
    times: int


def best_completion(sizes: list[int], counts: dict[int, int], room: int, effort: int = 4000) -> dict[int, int]:
    """The multiset of ``sizes`` (ascending, available ``counts`` times) that fills ``room`` best.

    Depth first over sizes from large to small, larger multiplicities first,
    so the first leaf is the best-fit filling and the incumbent only improves.
    A branch ends when even all smaller items cannot beat the incumbent's
    waste, and the search when nothing is wasted.  A filling is dominated if
    a larger item fits in place of a smaller one; taking sizes in falling
    order visits the dominating filling first.  ``effort`` bounds the nodes;
    the incumbent stands then.
    """
    mass = [0]
    for s in sizes:
        mass.append(mass[-1] + s * counts[s])
    best: list = [room, {}]
    left = [effort]

    def go(upto: int, space: int, taken: dict[int, int]) -> None:
        if space < best[0]:
            best[0], best[1] = space, dict(taken)
        upto = bisect_right(sizes, space, 0, upto)
        while upto > 0 and best[0] > 0 and left[0] > 0:
            if space - mass[upto] >= best[0]:
                return
            left[0] -= 1
            s = sizes[upto - 1]
            most = min(counts[s], space // s)
            for k in range(most, 0, -1):
                taken[s] = k
                go(upto - 1, space - k * s, taken)
                if best[0] == 0 or left[0] <= 0:
                    break
            taken.pop(s, None)
            upto -= 1

    go(len(sizes), room, {})
    return best[1]


def least_containers(histogram: dict[int, int], capacity: int) -> int:
    """A number of containers that no packing can do without.

    For a small size a: items that leave less than a are alone, items over
    half the capacity have a container each, and what of a and more does not
    fit beside these needs containers of its own.  The best a counts.
    """
    sizes = sorted(histogram)
    counts, sums = [0], [0]
    for s in sizes:
        counts.append(counts[-1] + histogram[s])
        sums.append(sums[-1] + s * histogram[s])
    half = bisect_right(sizes, capacity // 2)
    best = -(-sums[-1] // capacity)
    for a in [0, *sizes[:half]]:
        low, high = bisect_left(sizes, a), bisect_right(sizes, capacity - a)
        free = (counts[high] - counts[half]) * capacity - (sums[high] - sums[half])
        best = max(best, counts[-1] - counts[half] + max(0, -(-(sums[half] - sums[low] - free) // capacity)))
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing: each item, largest first, to the container with the least room that holds it.

    Containers of one content are counted together.  The tightest container
    takes as many of a size as fit before another one gets any.
    """
    groups: list[tuple[int, dict[int, int], int]] = []  # room, parts, containers; least room first
    for s in sorted((s for s, n in histogram.items() if n > 0 and s > 0), reverse=True):
        n = histogram[s]
        while n:
            i = bisect_left(groups, s, key=lambda g: g[0])
            room, parts, times = groups.pop(i) if i < len(groups) else (capacity, {}, n)
            q = min(room // s, n)
            used = min(times, n // q)
            n -= q * used
            if times > used and parts:
                insort(groups, (room, parts, times - used), key=lambda g: g[0])
            insort(groups, (room - q * s, {**parts, s: q}, used), key=lambda g: g[0])
    return [Filling(parts, times) for _, parts, times in groups]


def completions(sizes: list[int], counts: dict[int, int], room: int, width: int = 12, effort: int = 4000) -> tuple[list[dict[int, int]], int, bool]:
    """The ``width`` undominated fillings of ``room`` that waste least, the nodes used, and whether no others exist.

    A filling is dominated, and left out, if a free size fits into its waste,
    could replace a smaller one of its sizes, or two of them together.
    """
    found: list[tuple[int, int, dict[int, int]]] = []
    left, whole = [effort], [True]

    def dominated(space: int, taken: dict[int, int]) -> bool:
        free = [s for s in sizes if counts[s] > taken.get(s, 0)]
        mine = list(taken)
        pairs = [a + b for i, a in enumerate(mine) for b in mine[i:] if a != b or taken[a] > 1]
        # The least free size above (for the rest of the room and one size) or not under (for two) what it replaces.
        for base, at in [(0, bisect_right(free, 0)), *((a, bisect_right(free, a)) for a in mine), *((p, bisect_left(free, p)) for p in pairs)]:
            if at < len(free) and free[at] <= base + space:
                return True
        return False

    def go(upto: int, space: int, taken: dict[int, int]) -> None:
        left[0] -= 1
        if left[0] < 0:
            whole[0] = False
            return
        upto = bisect_right(sizes, space, 0, upto)
        if not dominated(space, taken):
            found.append((space, sum(taken.values()), dict(taken)))
        for i in range(upto, 0, -1):
            s = sizes[i - 1]
            for k in range(min(counts[s], space // s), 0, -1):
                taken[s] = k
                go(i - 1, space - k * s, taken)
                if left[0] < 0:
                    break
            taken.pop(s, None)
            if left[0] < 0:
                return

    go(len(sizes), room, {})
    found.sort(key=lambda f: f[:2])
    return [f[2] for f in found[:width]], effort - max(0, left[0]), whole[0] and len(found) <= width


def fill(histogram: dict[int, int], capacity: int, budget: int = 400_000) -> list[Filling]:
    """Fillings that use every item of the histogram (size: number) once.

    The incumbent is the smaller of ``best_fillings`` and ``best_fit``; where
    it holds more than ``least_containers``, branch and bound looks for a smaller packing.  A
    branch is a filling of the largest size, as often as its sizes last or
    once.  Branches are taken in waves: at most 0, 1, 3, 7, ... departures
    from the best filling in all, so early choices are revisited as well.
    ``budget`` bounds the nodes of all waves; the best packing stands then.
    """
    best = min(best_fillings(histogram, capacity), best_fit(histogram, capacity), key=lambda fs: sum(f.times for f in fs))
    start = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    least, n_best = least_containers(start, capacity), sum(f.times for f in best)
    slack = 0
    while n_best > least and budget > 0:
        counts, used, mass, cut = dict(start), 0, sum(s * n for s, n in start.items()), False
        path: list[tuple[Filling, int]] = []

        def branches(allowed: int) -> Iterator[tuple[Filling, int]]:
            nonlocal budget, cut
            sizes = sorted(s for s in counts if counts[s])
            large = sizes[-1]
            counts[large] -= 1
            options, nodes, whole = completions([s for s in sizes if counts[s]], counts, capacity - large)
            counts[large] += 1
            budget -= nodes + len(sizes)
            cut = cut or not whole
            cost = 0
            for parts in options:
                parts = {**parts, large: parts.get(large, 0) + 1}
                most = min(counts[s] // k for s, k in parts.items())
                for times in (most, 1) if most > 1 else (1,):
                    if cost > allowed:
                        cut = True
                        return
                    yield Filling(parts, times), allowed - cost
                    cost += 1

        frames = [branches(slack)]
        while frames and budget > 0 and n_best > least:
            step = next(frames[-1], None)
            if step is None:
                frames.pop()
                if path:
                    f, _ = path.pop()
                    used -= f.times
                    for s, k in f.parts.items():
                        counts[s] += k * f.times
                        mass += s * k * f.times
                continue
            f, allowed = step
            path.append(step)
            used += f.times
            for s, k in f.parts.items():
                counts[s] -= k * f.times
                mass -= s * k * f.times
            if mass == 0 and used < n_best:
                best, n_best = [g for g, _ in path], used
            # Total waste: what is left needs so many containers even if none of their room is lost.
            hopeless = mass == 0 or used - (-mass // capacity) >= n_best
            frames.append(iter(()) if hopeless else branches(allowed))
        if not cut:
            break
        slack = 2 * slack + 1
    return best


def best_fillings(histogram: dict[int, int], capacity: int) -> list[Filling]:
    """The packing that gives each largest size its best filling, as often as the sizes last."""
    counts = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    sizes = sorted(counts)
    out = []
    while sizes:
        large = sizes[-1]
        counts[large] -= 1
        usable = sizes if counts[large] else sizes[:-1]
        parts = best_completion(usable, counts, capacity - large)
        counts[large] += 1
        parts = dict(parts)
        parts[large] = parts.get(large, 0) + 1
        times = min(counts[s] // k for s, k in parts.items())
        for s, k in parts.items():
            counts[s] -= k * times
        sizes = [s for s in sizes if counts[s]]
        out.append(Filling(parts, times))
    return out


def pack(sized: DataFrame, capacity: int = 2048, lane_rows: int = 100_000, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, piece, n_pieces, size, container): every item in a container.

    ``sized`` has doc_id and n_tokens.  An item larger than the capacity, and
    only such, is cut into full pieces and a rest.  Items of 0 tokens need no
    space and get no row; ids given twice are two items.

    The driver holds the histogram (at most ``capacity`` entries) and the
    fillings (bounded by the sizes and by the budget of the search).  Items are
    ranked within lanes (a hash) of about ``lane_rows`` items of a size, offset
    by the lanes' counts, so a size that a third of all items have is ranked
    in as many tasks as it needs.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = sized.sparkSession
    scratch = scratch or Scratch(spark)
    n_pieces = F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("bigint")
    pieces = sized.where("n_tokens > 0").select("doc_id", "n_tokens", n_pieces.alias("n_pieces"), F.explode(F.sequence(F.lit(1).cast("bigint"), n_pieces)).alias("piece"))
    size = F.least(F.lit(capacity), F.col("n_tokens") - (F.col("piece") - 1) * capacity).cast("int")
    items = scratch.save(pieces.select("doc_id", "piece", "n_pieces", size.alias("size")))
    histogram = {r["size"]: r.n for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}
    lanes = spark.createDataFrame([(s, -(-n // lane_rows)) for s, n in histogram.items()], "size int, lanes bigint")
    items = items.join(F.broadcast(lanes), "size").withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece"), F.col("lanes"))).drop("lanes")
    by_lane = items.groupBy("size", "lane").agg(F.count("*").alias("n"))
    rows, first = [], 0
    used: dict[int, int] = {}
    for f in fill(histogram, capacity):
        for s, k in f.parts.items():
            start = used.get(s, 0)
            rows.append((s, start, start + k * f.times, k, first))
            used[s] = start + k * f.times
        first += f.times
    slots = spark.createDataFrame(rows, "size int, low bigint, high bigint, k bigint, first bigint")
    earlier = Window.partitionBy("size").orderBy("lane")
    offsets = by_lane.select("size", "lane", (F.sum("n").over(earlier) - F.col("n")).alias("offset"))
    inside = Window.partitionBy("size", "lane").orderBy("doc_id", "piece")
    ranked = items.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["size", "lane"]).withColumn("rank", F.col("rank") + F.col("offset"))
    s = slots.alias("s")
    placed = ranked.alias("r").join(F.broadcast(s), (F.col("r.size") == F.col("s.size")) & (F.col("r.rank") >= F.col("s.low")) & (F.col("r.rank") < F.col("s.high")))
    container = F.col("s.first") + F.floor((F.col("r.rank") - F.col("s.low")) / F.col("s.k"))
    return placed.select("r.doc_id", "r.piece", "r.n_pieces", "r.size", container.cast("bigint").alias("container"))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Containers, the least number that could do, and the share of space left empty."""
    totals = packed.agg(F.countDistinct("container").alias("n_containers"), F.sum("size").alias("n_tokens"))
    least = F.ceil(F.col("n_tokens") / capacity)
    return totals.select("n_containers", least.alias("n_least"), "n_tokens", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * capacity), 6).alias("empty_share"))


def oversized(packed: DataFrame) -> DataFrame:
    """(doc_id) of the items that had to be cut."""
    return packed.where("n_pieces > 1").select("doc_id").distinct()


def broken_rules(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: items placed, containers over the capacity, repeated and missing pieces, items cut without need."""
    over = packed.groupBy("container").agg(F.sum("size").alias("used")).agg(F.count_if(F.col("used") > capacity).alias("n_over"))
    each = packed.groupBy("doc_id", "piece").agg(F.count("*").alias("n"), F.max("n_pieces").alias("n_pieces"), F.sum("size").alias("size"))
    whole = each.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("n_pieces").alias("n_pieces"), F.sum("size").alias("size"), F.max("n").alias("most"))
    counts = whole.agg(
        F.count("*").alias("n_items"), F.count_if(F.col("most") > 1).alias("n_repeated"), F.count_if(F.col("n") < F.col("n_pieces")).alias("n_incomplete"), F.count_if((F.col("n_pieces") > 1) & (F.col("size") <= capacity)).alias("n_needless"),
    )
    return counts.join(over)
