import numpy as np
import pytest

from furrow.llm import vector_graph as V


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), None if r is None else [None if v is None else float(v) for v in r], "y", 0) for i, r in zip(ids, x)], "vec_id bigint, x array<double>, y string, pos int")


def brute(ids, x, top):
    out = set()
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:top]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return out


def pairs(df):
    return {(r.vec_a, r.vec_b) for r in df.collect()}


def clustered(n, dim, seed, groups):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] * 6 + rng.normal(size=(n, dim))


def test_exact_within_one_block_with_dirt_and_ties(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(60, 4)), 1)
    x[10:25] = x[3]  # a group of equal vectors larger than any list
    x[30] = x[31]
    ids = rng.permutation(1000)[:60]
    rows = list(zip(ids, x.tolist()))
    dirt = [(2000, None), (2001, [1.0, 2.0]), (2002, [1.0, 2.0, 3.0, float("nan")]), (2003, [0.0] * 4), (2004, [1.0, None, 1.0, 1.0]), (2005, [1.0, 1.0, float("inf"), 1.0]), (2006, [1.0] * 5)]
    again = rows[:9] + rows[3:4] * 5
    df = frame(spark, *zip(*(rows + dirt + again)))
    graph = V.build_graph(df, dim=4)
    got = pairs(V.unordered_pairs(V.nearest(graph, 5)))
    assert got == brute(ids, x, 5)


def test_negative_zero_is_zero(spark):
    df = frame(spark, [1, 2, 3], [[0.0, 1.0], [-0.0, 1.0], [5.0, 5.0]])
    near = {(r.vec_id, r.near_id): r.distance for r in V.nearest(V.build_graph(df, dim=2), 1).collect()}
    assert near[(1, 2)] == near[(2, 1)] == 0.0
    assert (3, 1) in near


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [3.0, 4.0])]])
def test_few_rows(spark, rows):
    df = frame(spark, [r[0] for r in rows], [r[1] for r in rows])
    got = pairs(V.unordered_pairs(V.nearest(V.build_graph(df, dim=2), 5)))
    assert got == ({(1, 2)} if len(rows) == 2 else set())


def test_recall_over_many_blocks(spark):
    x = clustered(3000, 12, 3, 40)
    ids = np.arange(3000) * 7 % 3001
    df = frame(spark, ids, x)
    graph = V.build_graph(df, dim=12, block=200, orders=2, sample=1000, settle=0.001)
    got = pairs(V.unordered_pairs(V.nearest(graph, 5)))
    want = brute(ids, x, 5)
    assert len(got & want) / len(want) >= 0.97
    assert len(got & want) / len(got) >= 0.97


def test_rounds_raise_recall(spark):
    x = clustered(2000, 12, 5, 10)
    ids = np.arange(2000)
    df = frame(spark, ids, x)
    want = brute(ids, x, 5)
    trace = []
    V.build_graph(df, dim=12, block=150, orders=2, sample=500, trace=trace)
    recall = [len(pairs(V.unordered_pairs(V.nearest(g, 5))) & want) / len(want) for g in trace]
    assert len(recall) >= 3 and recall[1] > recall[0] and recall[-1] >= 0.95
    told = {r["round"]: r.recall for r in V.recall_of_rounds(trace, 5).collect()}
    assert sorted(told) == list(range(len(trace))) and told[len(trace) - 1] > told[0]
    with pytest.raises(RuntimeError):
        V.build_graph(df, dim=12, block=150, orders=2, sample=500, max_rounds=1, settle=0.0)


def test_greedy_search(spark):
    x = clustered(2000, 12, 7, 20)
    ids = np.arange(2000)
    graph = V.build_graph(frame(spark, ids, x), dim=12, block=200, orders=2)
    queries = frame(spark, [*range(0, 2000, 50), 99999], [*x[::50], [1.0] * 5]).union(frame(spark, [7], [None]))  # the last two are unusable
    found = V.greedy_search(graph, queries, 5).collect()
    hits = 0
    for q in range(0, 2000, 50):
        d = ((x - x[q]) ** 2).sum(1)
        true = set(np.argsort(d)[1:6].tolist())
        hits += len(true & {r.near_id for r in found if r.vec_id == q})
    assert len(found) == 40 * 5
    assert hits / 200 >= 0.9


def test_greedy_search_answers_every_id_and_names_copies(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 6))
    x[:100] = x[0]  # a third of all rows share one vector
    x[100:103] = x[100]
    x[110] = x[111]
    ids = rng.permutation(3000)[:300]
    graph = V.build_graph(frame(spark, ids, x), dim=6)
    asked = [*range(0, 100, 3), 100, 102, 110, 111, *range(150, 300, 10)]
    found = V.greedy_search(graph, frame(spark, [ids[i] for i in asked], x[asked]), 5).collect()
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = [ids[j] for j in np.lexsort((ids, d)) if j != i][:5]
        rows = sorted((r.distance, r.near_id) for r in found if r.vec_id == ids[i])
        assert [n for _, n in rows] == want, i
    assert len(found) == 5 * len(asked)


def test_greedy_search_where_all_rows_are_copies(spark):
    graph = V.build_graph(frame(spark, range(4), [[1.0, 2.0]] * 4), dim=2)
    found = V.greedy_search(graph, frame(spark, [0, 3], [[1.0, 2.0]] * 2), 2).collect()
    assert {(r.vec_id, r.near_id, r.distance) for r in found} == {(0, 1, 0.0), (0, 2, 0.0), (3, 0, 0.0), (3, 1, 0.0)}


def test_greedy_search_takes_vectors_from_elsewhere(spark):
    x, new = clustered(1500, 8, 2, 15), clustered(40, 8, 3, 15)
    graph = V.build_graph(frame(spark, range(1500), x), dim=8, block=200, orders=2)
    new[1] = new[0]
    found = V.greedy_search(graph, frame(spark, range(9000, 9040), new), 5, points=256).collect()
    hits = 0
    for q in range(40):
        true = set(np.argsort(((x - new[q]) ** 2).sum(1))[:5].tolist())
        hits += len(true & {r.near_id for r in found if r.vec_id == 9000 + q})
    assert len(found) == 200 and hits >= 180
    empty = V.build_graph(frame(spark, range(1), x[:1]).limit(0), dim=8)
    assert V.greedy_search(empty, frame(spark, range(3), new[:3]), 5).count() == 0
