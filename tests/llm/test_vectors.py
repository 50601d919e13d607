import numpy as np
import pytest

from quern.llm import ann, embdedup


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


def odd(d):
    return [(9001, None), (9002, [0.0] * d), (9003, [float("nan")] + [1.0] * (d - 1)), (9004, [None] + [1.0] * (d - 1)), (9005, [float("inf")] + [1.0] * (d - 1)), (9006, []), (9007, [1.0] * (d + 1))]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(40, 16))
    x = np.vstack([rng.normal(size=(700, 16)), middle[rng.integers(0, 40, 500)] + rng.normal(size=(500, 16)) * 0.12]).astype("f4")
    x = np.vstack([x, x[:20]])  # exact copies
    return list(enumerate(x))


def test_links_match_brute_force(spark, cloud, monkeypatch):
    x = np.stack([v for _, v in cloud]).astype("f8")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[near[i]].min()) if near[i].any() else label[i] for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    for large in (16_000, 150):  # the second splits cells
        monkeypatch.setattr(embdedup, "LARGE", large)
        got = {r.vec_id: r for r in embdedup.linked_vectors(frame(spark, cloud + odd(16))).collect()}
        assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
        assert [got[i].component_id for i in range(len(x))] == label.tolist()
        assert all(got[i].kept == (label[i] == i) for i in range(len(x)))
        for i, _ in odd(16):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_no_vectors(spark):
    assert embdedup.linked_vectors(frame(spark, [])).count() == 0
    got = embdedup.linked_vectors(frame(spark, odd(3)[:2])).collect()
    assert sorted(r.vec_id for r in got) == [9001, 9002]


def test_nearest_recall_and_contract(spark, cloud):
    x = np.stack([v for _, v in cloud]).astype("f8")
    table = frame(spark, cloud + odd(16))
    rows = ann.nearest(table, table.where("vec_id % 10 = 0 or vec_id > 9000")).collect()
    hits = total = 0
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, len(x), 10))
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11)) and q not in {r.vec_id for r in found}
        gap = np.sqrt(((x - x[q]) ** 2).sum(1))
        for a in found:
            assert a.score == pytest.approx(gap[a.vec_id], rel=1e-12, abs=1e-12)
        keys = [(r.score, r.vec_id) for r in found]
        assert keys == sorted(keys)
        gap[q] = np.inf
        hits += len({r.vec_id for r in found} & set(np.lexsort((np.arange(len(x)), gap))[:10].tolist()))
        total += 10
    assert hits / total >= 0.95


def test_few_candidates(spark):
    table = frame(spark, [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [0.0, 1.0]), (200, None)])
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(table, table.where("vec_id % 100 = 0")).collect())
    assert got == [(0, 1, 3), (0, 2, 100), (100, 1, 3), (100, 2, 0)]
    assert ann.nearest(table.limit(0), table).count() == 0


def test_split_lists_give_the_same(spark, cloud, monkeypatch):
    table = frame(spark, cloud)
    key = lambda f: sorted((r.query_id, r["rank"], r.vec_id) for r in f.collect())
    want = key(ann.nearest(table, table.where("vec_id % 50 = 0")))
    monkeypatch.setattr(ann, "CHUNK", 20)
    monkeypatch.setattr(ann, "QUERIES", 3)
    got = key(ann.nearest(table, table.where("vec_id % 50 = 0")))
    assert len(set(got) & set(want)) >= 0.97 * len(want)


def test_repeated_queries_and_rows(spark, cloud):
    rows = cloud[:300] + [cloud[0], cloud[0], (0, cloud[5][1])]
    table = frame(spark, rows)
    got = ann.nearest(table, table.where("vec_id % 100 = 0")).collect()
    for q in (0, 100, 200):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and len({r.vec_id for r in own}) == 10 and q not in {r.vec_id for r in own}
    x = np.stack([v for _, v in cloud[:300]]).astype("f8")
    first = min(tuple(map(float, cloud[0][1])), tuple(map(float, cloud[5][1])))  # of two vectors of an id the least
    gap = np.sqrt(((x - np.array(first, dtype="f4").astype("f8")) ** 2).sum(1))
    gap[0] = np.inf
    assert min(r.score for r in got if r.query_id == 0) == pytest.approx(gap.min(), abs=1e-9)


def test_sample_bounds_hold(cloud):
    x = np.stack([v for _, v in cloud]).astype("f8")
    ids = np.arange(len(x))
    bound = ann.known_bound(x[:50], ids[:50], x[::3], ids[::3], 10)
    for i in range(50):
        gap = ((x - x[i]) ** 2).sum(1)
        gap[i] = np.inf
        assert np.sort(gap)[9] <= bound[i] * (1 + 1e-9)
    assert np.isinf(ann.known_bound(x[:2], ids[:2], x[:5], ids[:5], 10)).all()
    near = dict(ann.scan(x[:50], ids[:50], bound, x, ids, 10))
    hits = sum(len(set(near[i]) & set(np.argsort(np.where(ids == i, np.inf, ((x - x[i]) ** 2).sum(1)))[:10])) for i in range(50))
    assert hits >= 490


def test_vectors_of_any_size_link(spark):
    rows = [(i, [s, s * (1 + 1e-3)]) for i, s in enumerate((1e200, 1e-200, 1.0, 1e308, 5e-300))] + [(9, [1.0, -1.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.linked_vectors(table).collect()}
    assert got == {i: (4, 0) for i in range(5)} | {9: (0, 9)}
