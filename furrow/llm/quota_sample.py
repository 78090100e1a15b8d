"""Problem 3: a sample that matches target category proportions.

Method: controlled rounding.  For each plan the rows of each category, in the
wanted proportions and at least the minimum of each, are spread over the
strata (sources) in proportion to what each stratum has.  That fractional
two-way table is made integer by a maximum flow in which every cell and both
margins may only take the floor or the ceiling of their fractional value, so
both margins are preserved.  A second flow, of what the plan asks for through
what the cells have, says which categories fall short.  Within a cell the
sample is exact: the rows of the smallest random keys.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import Scratch


def max_flow(n: int, arcs: list[tuple[int, int, int]], source: int, sink: int) -> tuple[int, list[int]]:
    """Value and flow on each arc (from, to, capacity), by shortest blocking flows."""
    to, cap, head = [], [], [[] for _ in range(n)]
    for u, v, c in arcs:
        head[u].append(len(to)); to.append(v); cap.append(c)  # noqa: E702
        head[v].append(len(to)); to.append(u); cap.append(0)  # noqa: E702
    total = 0
    while True:
        level = [-1] * n
        level[source] = 0
        todo = deque([source])
        while todo:
            u = todo.popleft()
            for e in head[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return total, [cap[2 * i + 1] for i in range(len(arcs))]
        at = [0] * n
        while True:
            path, u = [], source
            while u != sink:
                while at[u] < len(head[u]) and not (cap[head[u][at[u]]] and level[to[head[u][at[u]]]] == level[u] + 1):
                    at[u] += 1
                if at[u] == len(head[u]):
                    if not path:
                        break
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                    continue
                path.append(head[u][at[u]])
                u = to[path[-1]]
            if u != sink:
                break
            push = min(cap[e] for e in path)
            for e in path:
                cap[e] -= push
                cap[e ^ 1] += push
            total += push


def controlled_rounding(table: list[list[float]]) -> list[list[int]]:
    """Integers next to each cell whose row, column and grand totals are next to the table's.

    Flow with lower bounds: source -> row -> column -> sink, where a bound is
    the floor and a capacity the ceiling of the cell or margin; rounding a
    two-way table this way is always feasible.
    """
    rows, cols = len(table), len(table[0]) if table else 0
    tidy = [[round(x, 9) for x in row] for row in table]
    low = lambda x: math.floor(round(x, 6) + 1e-9)
    high = lambda x: math.ceil(round(x, 6) - 1e-9)
    s, t, ss, tt = rows + cols, rows + cols + 1, rows + cols + 2, rows + cols + 3
    arcs, need = [], [0] * (rows + cols + 4)

    def bounded(u: int, v: int, x: float) -> None:
        a, b = low(x), high(x)
        arcs.append((u, v, b - a))
        need[v] += a
        need[u] -= a

    for i in range(rows):
        for j in range(cols):
            bounded(i, rows + j, tidy[i][j])
    for i in range(rows):
        bounded(s, i, sum(tidy[i]))
    for j in range(cols):
        bounded(rows + j, t, sum(r[j] for r in tidy))
    bounded(t, s, sum(map(sum, tidy)))
    wanted = 0
    for v in range(rows + cols + 2):
        if need[v] > 0:
            arcs.append((ss, v, need[v]))
            wanted += need[v]
        elif need[v] < 0:
            arcs.append((v, tt, -need[v]))
    got, flow = max_flow(rows + cols + 4, arcs, ss, tt)
    if got != wanted:
        raise ArithmeticError("the table has no controlled rounding")
    return [[low(tidy[i][j]) + flow[i * cols + j] for j in range(cols)] for i in range(rows)]


def eligible(records: DataFrame) -> DataFrame:
    """Original training records with a class."""
    return records.where("split = 'train' AND final_class IS NOT NULL AND NOT is_copy")


def plan_needs(sources: DataFrame, plans: DataFrame) -> DataFrame:
    """Each plan row with available rows, wanted rows and the rows it asks for.

    wanted = target_share x S, S = floor(sample_fraction x all eligible);
    asked = the larger of ``min_rows`` and wanted, rounded up.  Products are
    decimal, so shares such as 0.45 stay exact.  Plan rows with a NULL share,
    fraction or minimum count as 0; classes in no plan are not sampled; a
    class without rows has 0 available.
    """
    counts = sources.groupBy("final_class").agg(F.count("*").alias("n_available"))
    total = sources.agg(F.count("*").alias("n_all"))
    decimal = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(12,8)")
    size = F.floor(decimal("sample_fraction") * F.col("n_all").cast("decimal(18,0)"))
    plans = plans.select("plan_id", "final_class", "target_share", "sample_fraction", "min_rows")
    out = plans.where("plan_id IS NOT NULL AND final_class IS NOT NULL").crossJoin(F.broadcast(total)).join(F.broadcast(counts), "final_class", "left")
    out = out.withColumn("n_available", F.coalesce("n_available", F.lit(0))).withColumn("sample_size", size.cast("decimal(18,0)"))
    out = out.withColumn("wanted", F.col("sample_size") * decimal("target_share")).withColumn("min_rows", F.coalesce("min_rows", F.lit(0)))
    asked = F.greatest(F.col("min_rows").cast("bigint"), F.ceil("wanted").cast("bigint"))
    return out.select("plan_id", "final_class", "target_share", "min_rows", "n_available", "sample_size", "wanted", asked.alias("asked"))


def class_goals(wanted: list[float], least: list[float], most: list[float]) -> list[float]:
    """Rows of each class: in the proportions wanted, within the bounds, adding up to what is wanted in all.

    A class at its minimum or at all it has leaves the others a common factor
    of what they want.  Where the bounds leave no such sum, it is the nearest.
    """
    total = sum(wanted)
    at = lambda f: [min(max(f * w, a), b) for w, a, b in zip(wanted, least, most)]
    low, high = 0.0, 1.0
    while sum(at(high)) < total and any(f < b for f, b, w in zip(at(high), most, wanted) if w > 0):
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(at(middle)) < total else (low, middle)
    goals = at(high)
    free = [i for i, g in enumerate(goals) if least[i] < g < most[i]]
    if free:  # the factor in closed form
        rest = total - sum(g for i, g in enumerate(goals) if i not in free)
        for i in free:
            goals[i] = rest * wanted[i] / sum(wanted[j] for j in free)
    return goals


def rows_met(asked: list[int], cells: list[list[int]]) -> list[int]:
    """How much of what each class asks for its cells can give: a flow from classes through cells to strata."""
    rows, cols = len(cells), len(cells[0]) if cells else 0
    arcs = [(rows + cols, i, asked[i]) for i in range(rows)]
    arcs += [(i, rows + j, cells[i][j]) for i in range(rows) for j in range(cols)]
    arcs += [(rows + j, rows + cols + 1, sum(r[j] for r in cells)) for j in range(cols)]
    return max_flow(rows + cols + 2, arcs, rows + cols, rows + cols + 1)[1][:rows]


def _round_plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Integer quotas of one plan: classes by strata, both of bounded number."""
    wide = pdf.pivot_table(index="final_class", columns="stratum", values="n_cell", aggfunc="sum", fill_value=0).sort_index()
    first = pdf.groupby("final_class")[["wanted", "min_rows", "asked"]].first().reindex(wide.index)
    have = wide.sum(axis=1).tolist()
    cells = [[int(n) for n in wide.loc[c]] for c in wide.index]
    goals = class_goals(first.wanted.tolist(), [min(a, b) for a, b in zip(first.min_rows.tolist(), have)], have)
    whole = controlled_rounding([[g * n / h if h else 0.0 for n in row] for g, h, row in zip(goals, have, cells)])
    met = rows_met([int(x) for x in first.asked], cells)
    out = [(int(pdf.plan_id.iloc[0]), c, int(s), int(whole[i][j]), float(goals[i]), int(met[i])) for i, c in enumerate(wide.index) for j, s in enumerate(wide.columns)]
    return pd.DataFrame(out, columns=["plan_id", "final_class", "stratum", "quota", "goal", "met"])


def with_strata(sources: DataFrame, strata: int) -> DataFrame:
    """``stratum`` of each row: the ``strata`` largest sources are strata of their own, the rest share as many by hash; NULL is a source."""
    named = sources.withColumn("source_folder", F.coalesce("source_folder", F.lit("")))
    by_size = named.groupBy("source_folder").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_folder").limit(strata)
    own = by_size.select(F.col("source_folder").alias("s"), (F.row_number().over(Window.orderBy(F.desc("n"), "source_folder")) - 1).alias("own"))
    rest = F.pmod(F.xxhash64("source_folder"), F.lit(strata)) + strata
    return named.join(F.broadcast(own), F.col("source_folder") == F.col("s"), "left").withColumn("stratum", F.coalesce("own", rest).cast("int")).drop("s", "own")


def quota_sample(sources: DataFrame, plans: DataFrame, strata: int = 256, seed: int = 11, key_bits: int = 12, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of all plans.

    sample: plan_id, path, final_class.  report: one row a plan row with what
    was wanted, the goal, what was given and its share of the plan's sample,
    what is available, and whether the class falls short: whether its cells
    have fewer rows than the plan asks for (``plan_needs``).  Sources are
    strata (``with_strata``), so the tables that the flows work on stay
    bounded however many sources there are.  No row is drawn twice in a plan.
    A minimum that lifts a class is taken from the others in proportion
    (``class_goals``).

    Drawing: keys fall into 2**key_bits ranges a cell.  Counts by range say
    which range holds the quota's end: lower ranges are taken whole, and only
    that one is ranked, so no task ever sorts a whole cell.
    """
    scratch = scratch or Scratch(sources.sparkSession)
    key = F.xxhash64("path", F.lit(seed))
    pool = scratch.save(sources.select("path", "final_class", "source_folder", F.shiftrightunsigned(key, 64 - key_bits).cast("int").alias("range"), key.alias("key")))
    pool = with_strata(pool, strata).drop("source_folder")
    needs = scratch.save(plan_needs(pool, plans))
    ranges = pool.groupBy("final_class", "stratum", "range").agg(F.count("*").alias("n"))
    cells = ranges.groupBy("final_class", "stratum").agg(F.sum("n").alias("n_cell"))
    wanted = needs.groupBy("plan_id", "final_class").agg(F.max(F.col("wanted").cast("double")).alias("wanted"), F.max(F.col("min_rows").cast("double")).alias("min_rows"), F.max("asked").alias("asked"))
    quotas = wanted.join(cells, "final_class").groupBy("plan_id").applyInPandas(_round_plan, "plan_id int, final_class string, stratum int, quota long, goal double, met long")
    quotas = scratch.save(quotas)
    upto = Window.partitionBy("final_class", "stratum").orderBy("range")
    placed = ranges.select("final_class", "stratum", "range", "n", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    cut = placed.join(F.broadcast(quotas), ["final_class", "stratum"]).where("before < quota")
    cut = cut.select("plan_id", "final_class", "stratum", "range", F.least("n", F.col("quota") - F.col("before")).alias("take"), "n")
    drawn = pool.join(cut, ["final_class", "stratum", "range"])
    inside = Window.partitionBy("plan_id", "final_class", "stratum", "range").orderBy("key", "path")
    whole = drawn.where("take = n")
    edge = drawn.where("take < n").withColumn("rank", F.row_number().over(inside)).where("rank <= take")
    sample = whole.select("plan_id", "path", "final_class").union(edge.select("plan_id", "path", "final_class"))
    given = quotas.groupBy("plan_id", "final_class").agg(F.sum("quota").alias("n_given"), F.max("goal").alias("goal"), F.max("met").alias("met"))
    given = given.withColumn("share", F.try_divide("n_given", F.sum("n_given").over(Window.partitionBy("plan_id"))))
    report = needs.join(given, ["plan_id", "final_class"], "left").select(
        "plan_id", "final_class", "target_share", "min_rows", "n_available", F.col("sample_size").cast("long").alias("sample_size"), F.col("wanted").cast("double").alias("wanted"),
        F.coalesce("goal", F.lit(0.0)).alias("goal"), F.coalesce("n_given", F.lit(0)).alias("n_given"), F.coalesce("share", F.lit(0.0)).alias("share_given"), (F.coalesce("met", F.lit(0)) < F.col("asked")).alias("falls_short"),
    )
    return sample, report


def broken_rules(sources: DataFrame, sample: DataFrame, report: DataFrame) -> DataFrame:
    """Per plan: rows drawn twice, rows that are not eligible, classes and sources a row or more off their share of the goal.

    A source's share is that of the class's rows; sources here are strata of
    their own.
    """
    drawn = sample.join(sources.select("path", F.coalesce("source_folder", F.lit("")).alias("source"), F.lit(True).alias("known")), "path", "left")
    rows = drawn.groupBy("plan_id").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"), F.count_if(F.col("known").isNull()).alias("n_foreign"))
    have = sources.groupBy("final_class", F.coalesce("source_folder", F.lit("")).alias("source")).agg(F.count("*").alias("n_cell"))
    goals = report.groupBy("plan_id", "final_class").agg(F.max("goal").alias("goal"), F.max("n_available").alias("n_available"))
    due = goals.join(have, "final_class").groupBy("plan_id", "source").agg(F.sum(F.col("goal") * F.col("n_cell") / F.col("n_available")).alias("due"))
    got = drawn.groupBy("plan_id", "source").agg(F.count("*").alias("n"))
    off = lambda df, keys: df.groupBy("plan_id").agg(F.count_if(F.abs(F.coalesce("n", F.lit(0)) - F.col("due")) >= 1).alias(keys))
    sources_off = off(due.join(got, ["plan_id", "source"], "left"), "n_sources_off")
    classes_off = off(goals.withColumnRenamed("goal", "due").join(sample.groupBy("plan_id", "final_class").agg(F.count("*").alias("n")), ["plan_id", "final_class"], "left"), "n_classes_off")
    return classes_off.join(sources_off, "plan_id").join(rows, "plan_id").select("plan_id", (F.col("n") - F.col("n_paths")).alias("n_repeated"), "n_foreign", "n_classes_off", "n_sources_off")
