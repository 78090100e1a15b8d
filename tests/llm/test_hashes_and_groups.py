import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm import components, group_splits, near_hash

RECORD = "path string, final_class string, source_folder string, split string, is_copy boolean, hash bigint, vertex string, component string, bits int"


def records(spark, rows):
    return spark.createDataFrame([(p, c, f, s, False, h, "x", "y", 1) for p, c, f, s, h in rows], RECORD)


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def flipped(h, bits):
    for b in bits:
        h ^= 1 << b
    return h


@pytest.mark.parametrize("k", [0, 1, 2, 4, 5, 6])
def test_near_hashes_are_exact(spark, k):
    rng = random.Random(k)
    pool = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    pool += [flipped(rng.choice(pool), rng.sample(range(64), rng.randint(0, 8))) for _ in range(60)]
    left, right = pool[::2], pool[1::2]
    frame = lambda hs: spark.createDataFrame([(signed(h),) for h in hs * 2] + [(None,)], "hash bigint")
    got = {(r.a, r.b, r.bits) for r in near_hash.near_hashes(frame(left), frame(right), k).collect()}
    want = {(signed(a), signed(b), (a ^ b).bit_count()) for a in left for b in right if (a ^ b).bit_count() <= k}
    assert got == want
    got = {(r.a, r.b) for r in near_hash.near_hashes(frame(pool), None, k).collect()}
    assert got == {tuple(sorted((signed(a), signed(b)))) for a, b in combinations(set(pool), 2) if (a ^ b).bit_count() <= k}


def test_split_overlaps_with_nulls_ties_and_names(spark):
    h = 0xF0F0F0F0F0F0F0F0
    rows = [
        ("train/a/IMG_1.jpg", "a", "f1", "train", signed(h)),
        ("test/a/img_1_hard2.PNG", "a", "f1", "test", None),  # by name
        ("test/b/IMG_1.jpg", "b", None, "test", None),  # no folder, no hash
        ("val/a/z.jpg", "a", "f2", "val", signed(flipped(h, range(5)))),
        ("val/a/y.jpg", "a", "f2", "val", signed(flipped(h, range(6)))),
        ("train/a/copy__dup1.jpg", None, None, "train", signed(h)),
        ("x/none.jpg", None, None, None, signed(h)),
    ]
    pairs = near_hash.split_overlaps(records(spark, rows), 5)
    got = {(r.train_path, r.eval_path, r.bits) for r in pairs.collect()}
    assert got == {("train/a/IMG_1.jpg", "test/a/img_1_hard2.PNG", None), ("train/a/IMG_1.jpg", "val/a/z.jpg", 5), ("train/a/copy__dup1.jpg", "val/a/z.jpg", 5)}
    report = {(r.split, r.source_folder): (r.n_pairs, r.n_eval, r.n_train, r.n_exact) for r in near_hash.overlap_report(pairs).collect()}
    assert report == {("test", "f1"): (1, 1, 1, 0), ("val", "f2"): (2, 1, 2, 0)}
    assert near_hash.split_overlaps(records(spark, []), 5).count() == 0


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            parent[root(a)] = root(b)
    return {x: root(x) for x in list(parent)}


def same_partition(a, b):
    group = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    return group(a) == group(b)


@pytest.mark.parametrize("edges", [
    [],
    [(1, 1)],
    [(None, 2), (3, None), (None, None)],
    [(i, i + 1) for i in range(24)],  # a chain longer than any growth
    [(0, i) for i in range(1, 200)],  # a hub
    [(i, (i * 7 + 3) % 90) for i in range(90)] * 2 + [(5, 5), (200, 201)],
])
def test_components(spark, edges):
    df = spark.createDataFrame([(a, b, "c") for a, b in edges], "src bigint, dst bigint, vertex string")
    got = {r.vertex: r.component for r in components.connected_components(df).collect()}
    want = union_find(edges)
    assert set(got) == set(want) and same_partition(got, want)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30), st.integers(0, 2))
def test_components_random(spark, edges, seed):
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r.vertex: r.component for r in components.connected_components(df, seed=seed, beta=0.05 + seed / 4, growth_steps=1 + seed).collect()}
    assert same_partition(got, union_find(edges)) and set(got) == set(union_find(edges))


def test_photo_groups(spark):
    rows = [(p, "c", "f", "train", h) for p, h in [("a", 1), ("b", 1), ("c", None), ("d", None), ("e", 7), ("f/x.jpg", None), ("g", None)]]
    pairs = [("b", "c", " MATCH "), ("./d", "e", "same"), ("f\\x.jpg", " e ", "Same"), ("a", "g", "no match"), ("g", "nowhere", "match"), ("g", None, "match"), ("g", "g", "match"), ("c", "b", None), ("b", "c", "match")]
    df = spark.createDataFrame([(a, b, v, "x") for a, b, v in pairs], "path_a string, path_b string, verdict string, vertex string")
    groups = components.photo_groups(records(spark, rows), df)
    assert {(r.path, r.group_path) for r in groups.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f/x.jpg", "d"), ("g", "g")}
    assert {(r.group_path, r.path) for r in components.members(groups).collect()} == {("a", "b"), ("a", "c"), ("d", "e"), ("d", "f/x.jpg")}
    assert components.photo_groups(records(spark, []), df).count() == 0


def test_scenes_and_straddling(spark):
    chain = [0, 0b11111, 0b1111111111]  # ends are ten bits apart
    rows = [("p0", "a", "f", "train", chain[0]), ("p1", None, "f", None, chain[1]), ("p2", "a", "f", "val", chain[2]), ("q", "a", "f", "test", -1), ("r", "a", "f", "test", None), ("s", "a", "f", "train", None), ("q2", "a", "f", "test", -1)]
    scenes = group_splits.scene_groups(records(spark, rows), 5)
    assert {r.path for r in group_splits.straddling(scenes).collect()} == {"p0", "p1", "p2"}
    assert scenes.select("scene").distinct().count() == 4


def test_differencing_balances():
    rng = random.Random(2)
    for weights in ([], [5], [3, 3, 3, 3], [rng.randint(1, 40) for _ in range(300)], [1000, 1, 1, 1]):
        parts = group_splits.difference(weights, 4)
        assert sorted(i for p in parts for i in p) == list(range(len(weights)))
        sums = [sum(weights[i] for i in p) for p in parts]
        if len(weights) == 300:
            assert max(sums) - min(sums) <= 2
        assert max(sums, default=0) >= max(weights, default=0)


def test_assigned_splits_keep_scenes_whole(spark):
    rng = random.Random(4)
    rows = [(f"p{i}", rng.choice(["a", "a", "b", None]), "f", "train", i // rng.choice([1, 2, 5]) * 1_000_003 if i % 11 else None) for i in range(1500)]
    rows += [(f"hot{i}", "b", "f", "train", 77) for i in range(500)]  # a scene of a quarter of all records
    targets = spark.createDataFrame([("train", 0.7, 9), ("val", 0.2, 9), ("test", 0.1, 9), (None, 0.5, 9)], "split string, target_share double, n int")
    scenes = group_splits.scene_groups(records(spark, rows), 0)
    out = group_splits.assign_splits(scenes, targets, bins=40, shard_rows=200)
    got = out.collect()
    assert sorted(r.path for r in got) == sorted(r[0] for r in rows)
    by_scene = {}
    for r in got:
        by_scene.setdefault(r.scene, set()).add(r.new_split)
    assert all(len(s) == 1 for s in by_scene.values())
    report = {(r.final_class, r.new_split): r.gap for r in group_splits.balance_report(out, targets).collect()}
    assert all(abs(g) < 0.06 for (c, _), g in report.items() if c == "a")
    assert group_splits.assign_splits(group_splits.scene_groups(records(spark, []), 5), targets).count() == 0
    assert {r.new_split for r in group_splits.assign_splits(scenes, targets.limit(0)).collect()} == {None}


def one_by_one(weights, targets):
    behind = {s: t * sum(weights) / sum(targets.values()) for s, t in targets.items()}
    for w in sorted(weights, reverse=True):
        behind[min(targets, key=lambda s: (-behind[s], -targets[s], s))] -= w
    return behind


def test_runs_of_equal_bins_are_the_steps_one_by_one():
    rng = random.Random(8)
    for _ in range(200):
        weights = [rng.choice([1, 2, 50, 51, 52, 700]) for _ in range(rng.randint(1, 300))]
        targets = {"train": 0.7, "val": 0.2, "test": 0.1}
        histogram = {w: weights.count(w) for w in set(weights)}
        runs = group_splits.allocate_runs(histogram, targets)
        assert {w: sum(b - a for x, a, b, _ in runs if x == w) for w in histogram} == histogram
        left = {s: t * sum(weights) - sum(w * (b - a) for w, a, b, x in runs if x == s) for s, t in targets.items()}
        want = one_by_one(weights, targets)
        assert sorted(left.values()) == pytest.approx(sorted(want.values()), abs=1e-6)


def test_a_heavy_scene_is_made_up_for_by_other_shards(spark):
    n = 4000
    rows = [(f"p{i}", "a", "/%d" % i) for i in range(n)] + [(f"h{i}", "a", "#hot") for i in range(n // 2)]
    grouped = spark.createDataFrame(rows, "path string, final_class string, scene string")
    targets = spark.createDataFrame([("train", 0.7), ("val", 0.2), ("test", 0.1)], "split string, target_share double")
    out = group_splits.assign_splits(grouped, targets, bins=40, shard_rows=200)
    gaps = {r.new_split: r.gap for r in group_splits.balance_report(out, targets).collect()}
    assert len(gaps) == 3 and all(abs(g) < 0.01 for g in gaps.values()), gaps
