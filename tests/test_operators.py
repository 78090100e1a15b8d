"""Core operators on small tables: empty ones, NULLs, ties, hot groups, and brute force where there is no SQL."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from furrow.functions import bits, pixels
from furrow.operators import audit, decision, filters, graph, image, joins, metrics, sampling, similarity, stats
from furrow.session import Scratch
from furrow.sources import files, sinks


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("most", [0, 1, 5, 10, 18])
def test_hamming_pairs(spark, most):
    rng = random.Random(most)
    pool = [rng.getrandbits(64) for _ in range(5)]
    for _ in range(50):
        h = rng.choice(pool)
        for b in rng.sample(range(64), rng.randint(0, 12)):
            h ^= 1 << b
        pool.append(h)
    df = spark.createDataFrame([(signed(h),) for h in pool * 2] + [(None,)], "hash bigint")
    got = {(r.a, r.b, r.dist) for r in graph.hamming_pairs(df, most).collect()}
    want = {(min(signed(a), signed(b)), max(signed(a), signed(b)), (a ^ b).bit_count()) for a in pool for b in pool if a != b and (a ^ b).bit_count() <= most}
    assert got == want
    assert graph.hamming_pairs(df.limit(0), most).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 60)], [(i, i * 5 % 47) for i in range(47)]])
def test_components(spark, edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {r.vertex: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}


def test_greedy_dedupe_folds_in_order(spark):
    rng = random.Random(7)
    rows, base = [], [rng.getrandbits(64) for _ in range(4)]
    for i in range(120):
        h = rng.choice(base)
        for b in rng.sample(range(24), rng.randint(0, 5)):
            h ^= 1 << b
        rows.append((f"p{rng.randrange(10**6):06d}_{i}", rng.choice("ab"), signed(h) if i % 17 else None))
    kept, want = [], {}
    for p, c, h in sorted(rows, key=lambda r: (r[1], r[0])):
        d, kc, kp = min(((((h ^ k) & ((1 << 64) - 1)).bit_count(), kc, kp) for k, kc, kp in kept), default=(99, None, None)) if h is not None else (99, None, None)
        want[p] = ("keep", None, False) if d > 5 else ("exact" if d == 0 else "near", kp, kc != c)
        if d > 5 and h is not None:
            kept.append((h, c, p))
    table = spark.createDataFrame(rows, "path string, final_class string, hash bigint")
    got = {r.path: (r.fate, r.rival, r.cross) for r in graph.greedy_dedupe(table).collect()}
    assert got == want
    assert graph.greedy_dedupe(table.limit(0)).count() == 0


@pytest.mark.parametrize("s", [1, 2, 3])
def test_crowded_keys_are_cut_further(spark, s, monkeypatch):
    """Flat images: a third of the hashes share their upper bits."""
    monkeypatch.setattr(bits, "HOT", 40)
    monkeypatch.setattr(bits, "LOOK", 4)
    rng = random.Random(s)
    pool = [rng.getrandbits(22) for _ in range(300)] + [rng.getrandbits(64) for _ in range(300)]
    pool += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for h in pool]
    frame = lambda hs: spark.createDataFrame([(signed(h),) for h in hs] + [(None,)], "hash bigint")
    near = lambda a, b: (a ^ b).bit_count() <= 5
    got = [(r.a, r.b) for r in bits.close_pairs(frame(pool), None, 5, Scratch(spark), s).collect()]
    assert len(got) == len(set(got)) and set(got) == {(signed(a), signed(b)) for a in pool for b in pool if signed(a) < signed(b) and near(a, b)}
    left, right = pool[:500], pool[400:]
    got = {(r.a, r.b) for r in bits.close_pairs(frame(left), frame(right), 5, Scratch(spark), s).collect()}
    assert got == {(signed(a), signed(b)) for a in left for b in right if near(a, b)}


def test_ranked_lanes_are_whole_and_stable(spark):
    rows = [(i, "hot" if i % 3 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, label string")
    got = sampling.ranked(df, ["label"], "id", 3).collect()
    for label in ("hot", None):
        ranks = sorted(r["rank"] for r in got if r.label == label)
        assert ranks == list(range(1, len(ranks) + 1))
    again = sampling.ranked(df.repartition(7), ["label"], "id", 3).collect()
    assert {(r.id, r["rank"]) for r in again} == {(r.id, r["rank"]) for r in got}


@pytest.mark.parametrize("n,want", [(1, {"train": 1}), (2, {"train": 1, "test": 1}), (3, {"train": 1, "test": 2}), (5, {"train": 1, "val": 2, "test": 2}), (25, {"train": 18, "val": 5, "test": 2})])
def test_three_way_edges(spark, n, want):
    df = spark.createDataFrame([(i, "c") for i in range(n)], "id int, label string")
    got = {}
    for r in sampling.three_way(df, "label", "id", 1).collect():
        got[r.split] = got.get(r.split, 0) + 1
    assert got == want


def test_two_way_singleton_trains(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "two")], "id int, label string")
    got = {r.id: r.split for r in sampling.two_way(df, "label", "id", 0.75, 1).collect()}
    assert got[1] == "train" and sorted((got[2], got[3])) == ["test", "train"]
    with pytest.raises(ValueError):
        filters.check_split_parameters(1.0, 3)


def test_greedy_cluster_split_matches_the_fold(spark):
    rng = random.Random(5)
    clusters = [("c", i, rng.choice([1, 1, 1, 2, 3, 9])) for i in range(200)]
    targets = {"train": 0.7, "val": 0.2, "test": 0.1}
    placed, got = 0, dict.fromkeys(targets, 0)
    for _, _, n in sorted(clusters, key=lambda c: -c[2]):
        placed += n
        best = max(targets, key=lambda s: targets[s] * placed - got[s])
        got[best] += n
    out = sampling.greedy_cluster_split(spark.createDataFrame(clusters, "label string, cluster bigint, n bigint"), targets, 1).collect()
    sums = dict.fromkeys(targets, 0)
    for r in out:
        sums[r.split] += r.n
    assert len(out) == 200 and sums == got


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_is_exact_over_blocks(spark, metric, monkeypatch):
    monkeypatch.setattr(similarity, "PASS_BYTES", 200)  # several passes
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 6)), 1)
    x[20:30] = x[5]
    frame = lambda ids: spark.createDataFrame([(int(i), f"l{i % 3}", x[i].tolist()) for i in ids], "id bigint, label string, x array<double>")
    q, t = range(0, 90, 9), [i for i in range(90) if i % 9]
    got = {(r.id, r["rank"]): r.near_id for r in similarity.nearest(frame(q), frame(t).repartition(3), 6, 4, metric, block=16).collect()}
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    for i in q:
        d = ((x[t] - x[i]) ** 2).sum(1) if metric == "l2" else -(unit[t] @ unit[i])
        if metric == "l2":
            assert [got[i, k] for k in range(1, 5)] == [t[j] for j in np.lexsort((t, d))[:4]]
        else:
            assert np.allclose([-(unit[got[i, k]] @ unit[i]) for k in range(1, 5)], np.sort(d)[:4])
    assert similarity.nearest(frame([0]), frame([]), 6, 4, metric).count() == 0


def test_metrics_of_nothing_and_of_undefined_ratios(spark):
    df = spark.createDataFrame([("r", "a", "b"), ("r", "a", "b"), ("r", "b", None), ("r", None, "c")], "run_tag string, true_class string, pred string")
    conf = metrics.confusion(df, ["run_tag"])
    nan = {r["class"]: r for r in metrics.class_report(conf, ["run_tag"], "nan").collect()}
    assert nan["a"].recall == 0 and np.isnan(nan["a"].precision) and np.isnan(nan["b"].recall)
    zero = {r["class"]: r for r in metrics.class_report(conf, ["run_tag"], "zero").collect()}
    assert zero["a"].precision == zero["b"].recall == zero["b"].f1 == 0
    assert metrics.confusion(df.limit(0), ["run_tag"]).count() == 0
    assert stats.zscore_fit(spark.createDataFrame([([1.0, 2.0],), ([1.0, 4.0],)], "x array<double>"), ddof=1).orderBy("dim").collect()[0].std == 1.0


def test_decisions_on_the_bounds(spark):
    cases = [(1, [("rot", 0.65), ("leaf", 0.53)]), (2, [("rot", 0.64), ("leaf", 0.10)]), (3, [("rot", 0.70), ("leaf", 0.59)]), (4, [("leaf", 0.70), ("rot", 0.69)]), (5, [("leaf", 0.9)]), (6, []), (7, [("_note", 0.99), ("leaf", 0.2)]), (8, [("b", 0.5), ("a", 0.5)])]
    df = spark.createDataFrame(cases, "id int, scores array<struct<cls: string, p: double>>")
    got = {r.id: r for r in decision.decide(df, "scores", ["rot"]).collect()}
    assert [bool(got[i].abstain) for i in (1, 2, 3, 4)] == [False, True, True, False]
    assert got[5].margin == 1.0 and got[6].top_class is None and got[7].top_class == "leaf" and got[8].top_class == "a"
    assert got[2].low_confidence and got[3].low_confidence and not got[4].low_confidence


def test_parents_and_counts(spark):
    copies = spark.createDataFrame([("x", "train", "a"), ("y", "val", "a"), ("z", None, "q")], "path string, split string, parent string")
    parents = spark.createDataFrame([("a", "train"), ("b", "val")], "name string, split string")
    assert {r.path: r.status for r in joins.parent_check(copies, parents).collect()} == {"x": "ok", "y": "elsewhere", "z": "orphan"}
    a = spark.createDataFrame([(None,), ("s",)], "k string")
    assert {(r.k, r.n_a, r.n_b) for r in joins.count_difference(a, a.limit(0), ["k"]).collect()} == {(None, 1, 0), ("s", 1, 0)}


def test_sorted_pairs(spark, monkeypatch):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(150)] + [rng.getrandbits(10) << 3 for _ in range(60)]  # flat images share whole segments
    xs = {b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(12))) for b in base for _ in range(3)} | {0, (1 << 64) - 1}
    xs = sorted(x - (1 << 64) if x >> 63 else x for x in xs)
    df = spark.createDataFrame([(x,) for x in xs + xs[:5] + [None]], "hash bigint")
    for k in (8, 10):
        want = {(a, b, n) for i, a in enumerate(xs) for b in xs[i + 1 :] if (n := ((a ^ b) & ((1 << 64) - 1)).bit_count()) <= k}
        for size, hot in ((1 << 22, 4096), (200, 16)):  # one block; several, with runs that are cut further
            monkeypatch.setattr(bits, "SORTED", size)
            monkeypatch.setattr(bits, "HOT", hot)
            # Workers know only the module's own HOT, so the pairs are taken in this process too.
            here = list(bits._sorter(k, 2, 1)([pa.RecordBatch.from_pylist([{"a": np.array(xs).tobytes(), "b": np.array(xs).tobytes(), "i": 0, "j": 0, "chunk": 0}])]))
            assert {(r["a"], r["b"], r["bits"]) for batch in here for r in batch.to_pylist()} == want
            got = [tuple(r) for r in bits.sorted_pairs(df, k, Scratch(spark)).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    assert bits.sorted_pairs(df.where("hash IS NULL"), 10, Scratch(spark)).count() == 0


def test_verification(spark):
    before = spark.createDataFrame([("a", "c"), ("b", "c")], "path string, final_class string")
    after = spark.createDataFrame([("a", "c"), ("z", "d")], "path string, final_class string")
    members = spark.createDataFrame([(1, "train"), (1, "val"), (2, None)], "cluster int, split string")
    assert {r.check: r.n_found for r in audit.verification(before, after, members).collect()} == {"missing": 1, "unknown": 1, "class_counts": 2, "torn_clusters": 1}


# ---- images


def flood(mask, diagonal):
    h, w = mask.shape
    seen, sizes = np.zeros(mask.shape, int), []
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not seen[y, x]:
                todo, n = [(y, x)], 0
                seen[y, x] = len(sizes) + 1
                while todo:
                    a, b = todo.pop()
                    n += 1
                    for p in range(max(0, a - 1), min(h, a + 2)):
                        for q in range(max(0, b - 1), min(w, b + 2)):
                            if (diagonal or p == a or q == b) and mask[p, q] and not seen[p, q]:
                                seen[p, q] = len(sizes) + 1
                                todo.append((p, q))
                sizes.append(n)
    return seen, sizes


@pytest.mark.parametrize("seed", range(8))
def test_labels(seed):
    mask = np.random.default_rng(seed).random((13, 17)) < 0.45
    for diagonal in (True, False):
        lab, sizes = pixels.label(mask, diagonal)
        want, n = flood(mask, diagonal)
        assert np.array_equal(lab, want) and sizes.tolist() == n


def test_mask_shapes():
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert pixels.fill_holes(ring).all()
    diagonal = np.eye(4, dtype=bool)
    assert len(pixels.label(diagonal)[1]) == 1
    assert not pixels.shape(np.zeros((4, 4), bool)).any()
    line = np.zeros((5, 5), bool)
    line[2] = True
    area, perimeter, cx, cy, major, minor, ecc, solidity, extent = pixels.shape(line)
    assert (area, perimeter, cx, cy, minor, ecc, solidity, extent) == (5, 5, 2, 2, 0, 1, 1, 1)
    two = np.zeros((5, 9), bool)
    two[1:3, 1:3] = two[1:3, 6:8] = True
    assert pixels.shape(two)[2] == 1.5  # the first of equals
    assert pixels.texture(np.zeros((4, 4))).tolist() == [0, 0, 1, 1]
    assert pixels.texture(np.full((4, 4), 9.0)).tolist() == [0, 0, 1, 1]


def test_colours_go_round():
    rgb = np.random.default_rng(0).integers(0, 256, (20, 20, 3)).astype(np.uint8)
    hsv = pixels.rgb_to_hsv(rgb)
    assert np.abs(pixels.hsv_to_rgb(hsv).astype(int) - rgb).max() <= 1
    full = np.array([[[1.0, 1.0, 1.0]]])
    assert pixels.hsv_to_rgb(full).tolist() == [[[0, 0, 0]]]
    assert pixels.to_uint8(np.array([[0.5]])).tolist() == [[128]] and pixels.to_uint8(np.array([[65535]], np.uint16)).tolist() == [[255]]
    assert pixels.resize(np.full((9, 7), 5, np.uint8), 4, 4).tolist() == [[5] * 4] * 4


def test_image_rows_with_broken_bytes(spark):
    good = np.random.default_rng(1).integers(0, 256, (16, 16, 3)).astype(np.uint8)
    rows = [("a/x/1.png", 16, 16, 3, good.tobytes()), ("a/x/2.png", 16, 16, 3, b"short"), ("a/x/3.png", 16, 16, 1, good[:, :, 0].tobytes()), ("a/x/4.png", None, 1, 1, None), (None, 16, 16, 4, bytes(1024))]
    df = spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows], image.IMAGE)
    got = {r.path: r for r in image.feature_table(df, 32, 5).collect()}
    assert len(got["a/x/1.png"].features) == 50 and got["a/x/2.png"].features is None and got["a/x/1.png"].label == "x"
    assert image.hashes(df).where("dhash IS NOT NULL").count() == 3
    assert image.feature_table(df.limit(0)).count() == 0


def test_decoded_folder(spark, tmp_path):
    import struct
    import zlib

    def png(a):
        raw = b"".join(b"\0" + r.tobytes() for r in a)
        part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")

    a = np.random.default_rng(2).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    (tmp_path / "leaf").mkdir()
    (tmp_path / "leaf" / "one.PNG").write_bytes(png(a))
    (tmp_path / "leaf" / "bad.png").write_bytes(b"no image")
    rows = image.decoded(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and np.array_equal(np.frombuffer(rows[0].data, np.uint8).reshape(6, 5, 3), a)
    listing = files.image_listing(spark, str(tmp_path))
    assert {(r.label, r.name) for r in listing.collect()} == {("leaf", "one.PNG"), ("leaf", "bad.png")}
    classes = spark.createDataFrame([("leaf",), ("fruit",)], "label string")
    assert {r.label: r.n for r in files.class_listing(listing, classes).collect()} == {"leaf": 2, "fruit": 0}


def test_files(spark, tmp_path):
    assert files.read_document(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "one.json").write_text('{"weights": "w",\n "macro_f1": NaN, "per_class": [{"class": "a", "support": 2, "f1": NaN}]}')
    doc = files.read_document(spark, str(tmp_path / "one.json"), files.EVALUATION).first()
    assert np.isnan(doc.macro_f1) and doc.per_class[0].support == 2 and doc.n_test is None
    (tmp_path / "old.csv").write_text("path,true,pred,correct,is_plantvillage\na,b,c,0,False\n")
    assert files.read_csv(spark, str(tmp_path / "old.csv"), files.PREDICTIONS).first().confidence is None
    df = spark.createDataFrame([(1, " a"), (2, ""), (3, None), (4, 'q"x,\n')], "i int, s string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert {(r.i, r.s) for r in files.read_csv(spark, str(tmp_path / "csv"), "i int, s string").collect()} == {(1, " a"), (2, ""), (3, None), (4, 'q"x,\n')}
    assert files.cached(df, str(tmp_path / "c"), "1").count() == 4
    assert files.cached(df.limit(1), str(tmp_path / "c"), "1").count() == 4 and files.cached(df.limit(1), str(tmp_path / "c"), "2").count() == 1


def test_scoring_failures_are_rows(spark):
    def score(pdf):
        if (pdf.i == 3).any():
            raise OSError("down")
        return pdf[["i"]].rename(columns={"i": "score"}).astype(float)

    df = spark.createDataFrame([(1,), (2,), (3,)], "i int").repartitionByRange(3, "i")
    got = {r.i: (r.score, r.error) for r in files.scored(df, score, "score double", retries=2, pause=0.01).collect()}
    assert got[1] == (1.0, None) and got[3][0] is None and "down" in got[3][1]


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    groups = {"a": [rng.gauss(0, 1) for _ in range(301)], "b": [1.5] * 40, None: [rng.choice([0.0, 0.25, 1e300, -1e300]) for _ in range(77)], "one": [7.0], "two": [3.0, -4.0], "tied": [2.0] * 90 + [rng.random() for _ in range(10)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("void", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    shares = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.9, "q4": 1.0}
    got = {r.k: [r[q] for q in shares] for r in stats.quantiles(df, ["k"], "x", shares, bins=16).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, list(shares.values())).tolist(), rel=1e-9), k
    assert stats.quantiles(df.limit(0), ["k"], "x", shares).count() == 0


def test_placed_counts_through_ranges(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else None, rng.randrange(50), i) for i in range(600)]
    out = sampling.placed(spark.createDataFrame(rows, "k string, a int, i int").repartition(5), ["k"], ["a", "i"]).collect()
    for k in ("hot", None):
        want = sorted((a, i) for g, a, i in rows if g == k)
        assert [(r.a, r.i) for r in sorted((r for r in out if r.k == k), key=lambda r: r.place)] == want
        assert sorted(r.place for r in out if r.k == k) == list(range(1, len(want) + 1))


def test_views_of_an_image(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (40, 60, 3), dtype=np.uint8)
    views = pixels.crops(a, 8, 16)
    assert len(views) == 8 and all(v.shape == (16, 16, 3) for v in views)
    assert all(np.array_equal(views[i][:, ::-1], views[i + 1]) for i in range(0, 8, 2))
    assert np.array_equal(views[0], pixels.resize(a, 16, 16))
    y, x = (40 - 22) // 2, (60 - 33) // 2
    assert np.array_equal(views[6], pixels.resize(a[y : y + 22, x : x + 33], 16, 16))  # the smallest crop, 0.55 of each side
    again, other = pixels.perturbed(a / 255, 5, 1), pixels.perturbed(a / 255, 5, 2)
    assert len(again) == 5 and all(v.min() >= 0 and v.max() <= 1 and abs(v - a / 255).max() < 0.08 for v in again)
    assert np.array_equal(again[0], pixels.perturbed(a / 255, 5, 1)[0]) and not np.array_equal(again[0], other[0])
    rows = spark.createDataFrame([("a.png", 40, 60, 3, a.tobytes()), ("bad.png", 4, 4, 3, b"x"), (None, None, None, None, None)], image.IMAGE)
    score = lambda vs: np.array([[v.mean() / 255, 1 - v.mean() / 255] for v in vs])
    got = {r.path: r for r in image.scored_views(rows, score, ["p", "q"], 8, 16).collect()}
    assert got["a.png"].scores[0].p == pytest.approx(np.mean([v.mean() / 255 for v in views]))
    assert got["a.png"].uncertainty == pytest.approx(np.std([v.mean() / 255 for v in views])) and got["bad.png"].scores is None


def test_pipeline_at_its_own_canvas():
    a = np.full((90, 120, 3), 120, np.uint8)
    a[25:65, 30:90] = (40, 200, 40)  # a leaf
    a[40:46, 55:62] = (120, 120, 120)  # with a hole
    a[5:7, 5:7] = (40, 200, 40)  # and a speck
    s = pixels.pipeline(a)
    assert s["mask"].shape == (256, 256) and s["masked"].shape == (256, 256, 3)
    assert s["mask"][128, 128] and not s["mask"][17, 13] and not s["mask"][10, 200]
    assert abs(s["mask"].sum() - 40 / 90 * 256 * 60 / 120 * 256) < 0.12 * s["mask"].sum()
    assert not s["masked"][~s["mask"]].any() and np.array_equal(s["masked"][s["mask"]], s["enhanced"][s["mask"]])
    f = pixels.features(s["masked"], s["mask"])
    assert len(f) == 50 and f[:16].sum() == pytest.approx(1) and f[41] == s["mask"].sum()
    assert not pixels.features(a, np.zeros((90, 120), bool)).any()


def test_greedy_cluster_split_deals_many_of_one_size(spark):
    n, targets = 2500, {"train": 0.7, "val": 0.2, "test": 0.1}
    rows = [("a", f"c{i:04d}", 1) for i in range(n)] + [("a", "big", 7), ("b", "x", 2)]
    out = sampling.greedy_cluster_split(spark.createDataFrame(rows, "label string, cluster string, n bigint"), targets, 13)
    assert ">=" not in " ".join(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    order = sorted((r[1] for r in rows if r[0] == "a"), key=lambda c: (c != "big", hashlib.md5(f"{c}:13".encode()).hexdigest()))
    placed, got, want = 0, dict.fromkeys(targets, 0), {}
    for c in order:
        size = 7 if c == "big" else 1
        placed += size
        want[c] = max(targets, key=lambda s: targets[s] * placed - got[s])
        got[want[c]] += size
    assert {r.cluster: r.split for r in out.where("label = 'a'").collect()} == want and out.count() == len(rows)


def test_listing_is_not_the_drivers(spark, tmp_path):
    for name in ("test/a/x.JPG", "test/a/_x.png", "test/b/deep/y.png", "test/b/.hidden.png", "z.txt", "_temporary/q.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    out = files.image_listing(spark, str(tmp_path))
    assert {(r.path, r.label, r.name, r.length) for r in out.collect()} == {(f"file:{tmp_path}/test/a/x.JPG", "a", "x.JPG", 3), (f"file:{tmp_path}/test/b/deep/y.png", "deep", "y.png", 3)}
    assert "binaryFile" not in out._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "empty").mkdir()
    assert files.image_listing(spark, f"file://{tmp_path}/empty").count() == 0


def test_wide_bounds_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    pool = [rng.getrandbits(64) for _ in range(40)]
    pool += [pool[i % 40] ^ sum(1 << b for b in rng.sample(range(64), i % 20)) for i in range(260)]
    monkeypatch.setattr(bits, "BLOCK", 70)
    df = spark.createDataFrame([(signed(h),) for h in [*pool, pool[0]]] + [(None,)], "hash bigint")
    pool = sorted(set(pool), key=signed)
    dist = {(a, b): (a ^ b).bit_count() for i, a in enumerate(pool) for b in pool[i + 1 :]}
    counts, links = bits.compared(df, 18, Scratch(spark))
    assert {r.dist: r.n_pairs for r in counts.collect()} == {d: list(dist.values()).count(d) for d in set(dist.values()) if d <= 18}
    assert {(r.dist, r.n_pairs) for r in graph.pair_counts(df, 18).collect()} == {(r.dist, r.n_pairs) for r in counts.collect()}
    for t in (6, 10, 18):
        close = spark.createDataFrame([(signed(a), signed(b)) for (a, b), d in dist.items() if d <= t], "a bigint, b bigint")
        assert set(graph.components(links.where(f"dist <= {t}")).collect()) == set(graph.components(close).collect())
    assert graph.pair_counts(df.limit(0), 18).count() == 0


def test_forest_of_links():
    u, v, d = bits._forest(np.array([0, 1, 0, 2, 4]), np.array([1, 2, 2, 3, 3]), np.array([3, 1, 2, 5, 4], np.uint8), 5)
    assert len(u) == 4 and sorted(d.tolist()) == [1, 2, 4, 5]


def test_near_segments_meet_each_pair_once():
    """Only a part of a large table's pairs is compared, and none within the bound is lost or met twice."""
    cuts = bits.near_segments(3_000_000, 18)
    assert sum(bits._share(m.bit_count(), r) for m, r in cuts) < 0.2
    rng = random.Random(9)
    pool = [rng.getrandbits(64) for _ in range(60)] + [rng.getrandbits(9) << 20 for _ in range(80)]  # a crowded key
    pool += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 20))) for h in pool for _ in range(2)]
    xs = np.array(sorted(set(pool)), np.uint64)
    brute = lambda a, b: {(min(x, y), max(x, y), (x ^ y).bit_count()) for x in a.tolist() for y in b.tolist() if x != y and (x ^ y).bit_count() <= 18}
    for several in (cuts, bits.near_segments(300_000, 18), [(0, 0)]):
        for a, b in ((xs, None), (xs[::2], xs[1::2])):
            got = []
            for cut, (mask, _) in enumerate(several):
                u, v = (z if z is None else z[np.argsort(bits._moved(z, bits._moves(mask)))] for z in (a, b))
                for share in range(2):
                    for i, j, d in bits._near(u, v, 18, several, cut, share, 2):
                        got += [(min(x, y), max(x, y), n) for x, y, n in zip(u[i].tolist(), (u if v is None else v)[j].tolist(), d.tolist())]
            assert len(got) == len(set(got)) and set(got) == brute(a, a if b is None else b)


def test_sweep_joins_through_hubs(spark, monkeypatch):
    """At a wide bound most hashes are one component: links to its hub stand for all of them, in one block and across blocks."""
    rng = random.Random(11)
    pool = {rng.getrandbits(24) << 30 for _ in range(250)} | {rng.getrandbits(64) for _ in range(60)}
    df = spark.createDataFrame([(signed(h), rng.choice(["train", "val", "test"])) for h in sorted(pool)], "hash bigint, split string")
    dist = {(a, b): (a ^ b).bit_count() for a in pool for b in pool if a < b}
    close = {t: spark.createDataFrame([(signed(a), signed(b), d) for (a, b), d in dist.items() if d <= t], "a bigint, b bigint, dist int") for t in (4, 8, 18)}
    for block in (1 << 22, 120):
        monkeypatch.setattr(bits, "BLOCK", block)
        links = bits.compared(df, 18, Scratch(spark), bounds=[4, 8, 18])[1]
        assert links.count() < 2 * len(pool) < close[18].count()
        found = graph.components_by_bound(links, [4, 8, 18], Scratch(spark))
        for t in (4, 8, 18):
            got = {r.vertex: r[f"t{t}"] for r in found.collect()}
            want = {r.vertex: r.component for r in graph.components(close[t]).collect()}
            assert {h: got.get(h, h) for h in map(signed, pool)} == {h: want.get(h, h) for h in map(signed, pool)}
    monkeypatch.setattr(graph, "TOGETHER", 0)
    apart = {(r.vertex, *(r[f"t{t}"] or r.vertex for t in (4, 8, 18))) for r in graph.components_by_bound(links, [4, 8, 18], Scratch(spark)).collect()}
    assert apart == {(r.vertex, r.t4, r.t8, r.t18) for r in found.collect()}
