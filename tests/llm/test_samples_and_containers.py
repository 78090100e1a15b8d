import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm import packing, quota_sample


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(0, 9).map(lambda v: round(v, 3)), min_size=4, max_size=4), min_size=1, max_size=6))
def test_controlled_rounding_keeps_cells_and_margins(table):
    out = quota_sample.controlled_rounding(table)
    near = lambda whole, part: abs(whole - part) < 1 + 1e-6
    assert all(near(w, p) for ws, ps in zip(out, table) for w, p in zip(ws, ps))
    assert all(near(sum(w), sum(p)) for w, p in zip(out, table))
    assert all(near(sum(r[j] for r in out), sum(r[j] for r in table)) for j in range(4))
    assert near(sum(map(sum, out)), sum(map(sum, table)))


def test_max_flow():
    arcs = [(0, 1, 3), (0, 2, 2), (1, 3, 2), (2, 3, 3), (1, 2, 5)]
    value, flow = quota_sample.max_flow(4, arcs, 0, 3)
    assert value == 5 and flow[2] + flow[3] == 5


PLAN = "plan_id int, final_class string, target_share double, sample_fraction double, min_rows int, n_available int, wanted int"
SOURCE = "path string, final_class string, source_folder string, stratum int, key int, range int"


def test_sample_is_exact_and_reports_shortfalls(spark):
    rng = random.Random(1)
    rows = [(f"p{i}", rng.choice("aaaaaabbbc"), rng.choice(["f1", "f1", "f2", None])) for i in range(2000)]
    have = Counter(c for _, c, _ in rows)
    plans = [(1, "a", 0.5, 0.45, 5), (1, "b", 0.3, 0.45, 5), (1, "c", 0.2, 0.45, 5), (2, "a", 0.0, 0.1, 7), (2, "zz", 0.1, 0.1, 1), (3, "c", 0.9, 1.0, 0), (4, "b", None, None, None), (None, "a", 1.0, 1.0, 1), (5, None, 1.0, 1.0, 1)]
    source = spark.createDataFrame([(p, c, f, 1, 1, 1) for p, c, f in rows], SOURCE)
    plan = spark.createDataFrame([(*p, 1, 1) for p in plans], PLAN)
    sample, report = quota_sample.quota_sample(source, plan)
    got = sample.collect()
    assert len({(r.plan_id, r.path) for r in got}) == len(got)
    n = Counter((r.plan_id, r.final_class) for r in got)
    size = 900
    for c, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        goal = min(have[c], share * size)
        assert abs(n[1, c] - goal) < 1
    assert n[2, "a"] == 7 and n[3, "c"] == have["c"] and (4, "b") not in n
    short = {(r.plan_id, r.final_class) for r in report.collect() if r.falls_short}
    assert short == {(2, "zz"), (3, "c")} | ({(1, "c")} if have["c"] < 180 else set())
    again = quota_sample.quota_sample(source.repartition(3), plan)[0].collect()
    assert {(r.plan_id, r.path) for r in again} == {(r.plan_id, r.path) for r in got}


def test_goals_keep_proportions_within_bounds():
    assert quota_sample.class_goals([50.0, 30, 20], [0, 0, 0], [99, 99, 99]) == pytest.approx([50, 30, 20])
    assert quota_sample.class_goals([80.0, 16, 4], [0, 0, 25], [99, 99, 99]) == pytest.approx([62.5, 12.5, 25])  # the minimum is taken from the others
    assert quota_sample.class_goals([50.0, 30, 20], [0, 0, 0], [99, 99, 4]) == pytest.approx([60, 36, 4])  # what a class lacks goes to the others
    assert quota_sample.class_goals([50.0, 50], [0, 0], [10, 20]) == pytest.approx([10, 20])
    assert quota_sample.class_goals([5.0, 5], [20, 30], [40, 40]) == pytest.approx([20, 30])
    assert quota_sample.class_goals([0.0, 10], [7, 0], [9, 0]) == pytest.approx([7, 0])
    assert quota_sample.class_goals([], [], []) == []
    assert quota_sample.rows_met([5, 9], [[2, 2], [4, 8]]) == [4, 9]


def test_many_sources_share_strata(spark):
    df = spark.createDataFrame([(f"p{i}", "a", f"s{i % 40}" if i % 7 else None) for i in range(400)], "path string, final_class string, source_folder string")
    got = {}
    for r in quota_sample.with_strata(df, 3).collect():
        got.setdefault(r.source_folder, set()).add(r.stratum)
    assert got[""] == {0} and all(len(v) == 1 for v in got.values()) and set.union(*got.values()) <= set(range(6))


def test_sample_of_nothing(spark):
    plan = spark.createDataFrame([(1, "a", 0.5, 0.5, 2, 0, 0)], PLAN)
    sample, report = quota_sample.quota_sample(spark.createDataFrame([], SOURCE), plan)
    assert sample.count() == 0
    assert [r.falls_short for r in report.collect()] == [True]
    assert quota_sample.quota_sample(spark.createDataFrame([("p", "a", "f", 1, 1, 1)], SOURCE), plan.limit(0))[0].count() == 0


def best_waste(sizes, room):
    sums = {0}
    for s in sizes:
        sums |= {x + s for x in sums if x + s <= room}
    return room - max(sums)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=14), st.integers(0, 120))
def test_best_completion_is_optimal(sizes, room):
    counts = Counter(sizes)
    parts = packing.best_completion(sorted(counts), counts, room)
    assert all(k <= counts[s] for s, k in parts.items())
    assert room - sum(s * k for s, k in parts.items()) == best_waste(sizes, room)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_fill_uses_every_item_once(sizes):
    used = Counter()
    for f in packing.fill(Counter(sizes), 100):
        assert f.times >= 1 and sum(s * k for s, k in f.parts.items()) <= 100
        used.update({s: k * f.times for s, k in f.parts.items()})
    assert used == Counter(s for s in sizes if s)


def test_pack(spark):
    rng = random.Random(3)
    sizes = [rng.choice([0, 5, 40, 40, 40, 61, 99, 100, 101, 350]) for _ in range(600)]
    df = spark.createDataFrame([(i, n, 1, 1) for i, n in enumerate(sizes)] + [(7, sizes[7], 1, 1)], "doc_id bigint, n_tokens bigint, size int, container int")
    rows = packing.pack(df, 100, lane_rows=3).collect()
    want = Counter()
    for i, n in [*enumerate(sizes), (7, sizes[7])]:
        while n > 0:
            want[i, min(n, 100)] += 1
            n -= 100
    assert Counter((r.doc_id, r["size"]) for r in rows) == want
    load = Counter()
    for r in rows:
        load[r.container] += r["size"]
    assert max(load.values()) <= 100
    assert {r.doc_id for r in packing.oversized(packing.pack(df, 100)).collect()} == {i for i, n in enumerate(sizes) if n > 100}
    report = packing.fill_report(packing.pack(df, 100), 100).first()
    assert report.n_containers == len(load) and report.n_tokens == sum(load.values())


def test_pack_nothing_and_bad_capacity(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(df, 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def test_token_counts(spark):
    docs = [(1, None), (2, ""), (3, "hello world"), (4, "a" * 100_000), (5, "<|endoftext|> é ​ \n\n"), (None, "x")]
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 2048 and got[5] > 3 and len(got) == 5
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{packing.VOCABULARIES}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    assert got[5] == len(other.encode(docs[4][1], add_special_tokens=False).ids)


TIGHT = [1139, 948, 900, 900, 600, 600, 500, 408]


@pytest.mark.parametrize("copies", [1, 1000])
def test_fill_branches_over_fillings(copies):
    fillings = packing.fill({s: n * copies for s, n in Counter(TIGHT).items()}, 2048)
    assert sum(f.times for f in fillings) <= 3 * copies
    used = Counter()
    for f in fillings:
        assert sum(s * k for s, k in f.parts.items()) <= 2048
        used.update({s: k * f.times for s, k in f.parts.items()})
    assert used == {s: n * copies for s, n in Counter(TIGHT).items()}


def fewest(sizes, capacity):
    best, loads = [len(sizes)], []

    def go(i):
        if len(loads) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(loads)
            return
        for j in range(len(loads)):
            if loads[j] + sizes[i] <= capacity:
                loads[j] += sizes[i]
                go(i + 1)
                loads[j] -= sizes[i]
        loads.append(sizes[i])
        go(i + 1)
        loads.pop()

    go(0)
    return best[0]


def test_fill_needs_the_fewest_containers():
    rng = random.Random(6)
    for _ in range(150):
        sizes = sorted((rng.randint(10, 70) for _ in range(rng.randint(1, 10))), reverse=True)
        assert sum(f.times for f in packing.fill(Counter(sizes), 100)) == fewest(sizes, 100)


def decreasing(sizes, capacity):
    """Best-fit decreasing, item by item."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - s)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_fill_never_takes_more_than_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, rng.choice([2048, 1100, 700])) for _ in range(rng.choice([7, 120]))]
    histogram = dict(Counter(sizes))
    one_by_one = decreasing(sizes, 2048)
    assert sum(f.times for f in packing.best_fit(histogram, 2048)) == one_by_one
    found = packing.fill(histogram, 2048, budget=20_000)
    used = Counter()
    for f in found:
        assert sum(s * k for s, k in f.parts.items()) <= 2048
        for s, k in f.parts.items():
            used[s] += k * f.times
    assert used == Counter(sizes)
    assert packing.least_containers(histogram, 2048) <= sum(f.times for f in found) <= one_by_one
