import numpy as np
import pytest

from test_vectors import as_queries, brute_force, frame, ranked
from textloom.operators import retrieve
from textloom.operators.vector_index import BoundedSearch, VectorIndex, build_index, level_ends


def table(n=400, d=6, seed=0):
    rng = np.random.default_rng(seed)
    store = rng.integers(-2, 3, (n, d)).astype(float)
    store[50:250] = store[7]  # half of the store are copies: ties by key
    store[300] = 0
    return store, np.vstack([rng.normal(size=(60, d)), np.zeros((1, d)), store[7:8]])


@pytest.mark.parametrize("broadcast_values", [4_000_000, 100])
def test_index_equals_brute_force(spark, broadcast_values):
    store, queries = table()
    index = build_index(frame(spark, "s", store).repartition(6))
    found = index.search(as_queries(frame(spark, "q", queries)), 5, broadcast_values)
    assert ranked(found) == brute_force(queries, store, 5)
    plain = retrieve.top_matches(as_queries(frame(spark, "q", queries)), frame(spark, "s", store), 5)
    assert found.dtypes == plain.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_saved_index_and_empty_sides(spark, tmp_path):
    store, queries = table(d=9)
    stored, asked = frame(spark, "s", store), as_queries(frame(spark, "q", queries))
    build_index(stored).save(str(tmp_path / "index"))
    index = VectorIndex.load(spark, str(tmp_path / "index"))
    assert ranked(index.search(asked, 3)) == brute_force(queries, store, 3)
    assert index.search(asked.where("false")).count() == 0
    assert build_index(stored.where("false")).search(asked).count() == 0
    assert build_index(stored.limit(2)).search(asked, 5).count() == 2 * len(queries)
    with pytest.raises(ValueError, match="top_n must be greater than zero"):
        index.search(asked, 0)


def test_bounds_spare_work_where_few_axes_matter():
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(64, 64)) * np.logspace(0, -2, 64)[:, None]
    rows = rng.normal(size=(6000, 64)) @ mix
    axes = np.linalg.eigh(rows.T @ rows)[1][:, ::-1]
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    search = BoundedSearch(units[:50] @ axes, 5)
    search.offer(units @ axes, [(i,) for i in range(6000)])
    scores = units[:50] @ units.T
    for query, held in enumerate(search.best):
        assert [k for _, (k,) in held] == np.argsort(-scores[query], kind="stable")[:5].tolist()
    assert search.scored < search.possible / 3 and search.multiplied < 0.6 * 64 * search.possible


def test_levels():
    assert level_ends(64) == [16, 32, 48, 64] and level_ends(1) == [1] and level_ends(0) == [0]


def test_level_rows_are_cut_before_they_become_python_objects(monkeypatch):
    from textloom.operators import vector_index

    seen = []
    monkeypatch.setattr(vector_index, "sorted", lambda x: seen.append(len(x)) or sorted(x), raising=False)
    rows = np.tile([[1.0, 0.0]], (3000, 1))
    search = BoundedSearch(np.array([[0.0, 0.0], [1.0, 0.0]]), 5)
    search.offer(rows, [(i,) for i in range(3000)])
    assert [[k for _, (k,) in held] for held in search.best] == [list(range(5))] * 2
    # At most n held ones and n new ones meet.
    assert max(seen) <= 10


def test_rows_without_main_axes_and_zero_queries():
    # Bounds settle little here; a zero query, level with every row, was followed to the end with each.
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(5000, 16))
    rows[::9] = 0
    rows[4000:4040] = rows[1]  # level with a row of an earlier batch
    units = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    queries = np.vstack([units[1:40], np.zeros((300, 16))])
    order = rng.permutation(5000)  # batches come in any order, their rows by key
    search = BoundedSearch(queries, 5)
    for part in np.split(order, 10):
        part = np.sort(part)
        search.offer(units[part], [(int(i), "x") for i in part])
    scores = np.round(queries @ units.T, 9) + 0.0
    for query, held in enumerate(search.best):
        best = np.argsort(-scores[query], kind="stable")[:5]
        assert [k[0] for _, k in held] == best.tolist()
        assert np.allclose([-s for s, _ in held], scores[query][best], atol=1e-9)
    assert search.possible == int(queries.any(axis=1).sum()) * 5000
