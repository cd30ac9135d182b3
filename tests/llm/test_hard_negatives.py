import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import hard_negatives, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, score double"


def plain(rows, every=100, n_positives=5, n_negatives=10, low=30, high=90):
    """By all pairs, in whole numbers; rows (id, vector, label)."""
    kept = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept[i] = min(kept.get(i, (label, vector)), (label, vector))
    whole = {i: (label, [max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in v]) for i, (label, v) in kept.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scores = {i: sum(map(int.__mul__, v, w)) for i, (_, w) in whole.items() if i != a and len(w) == len(v)}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if whole[i][0] == label][:n_positives]:
            fits = [i for i in order if whole[i][0] != label and low * scores[p] <= 100 * scores[i] <= high * scores[p]]
            out += [(a, p, r, n, scores[p], scores[n]) for r, n in enumerate(fits[:n_negatives], 1)]
    return sorted(out)


def result(found):
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r[0], list(r[1]), r[2]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    rows = [(i, v, (x + 1) % 10 if i % 7 == 0 else x) for i, v, x in rows]
    found = queries.op12_hard_negatives(spark, path)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert result(found) == plain(rows)


def test_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    found = connection.execute(queries.SQL["op12_hard_negatives"])
    names = [d[0] for d in found.description]
    rows = queries.op12_hard_negatives(spark, path)
    assert rows.columns == names and result(rows) == sorted(found.fetchall())


def test_edge_rows_ties_and_repeats(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)], rng.choice([1, 2, 3])) for i in range(300)]
    rows += [(i, [1.0] * 6, 2) for i in range(300, 380)]  # equal vectors: ties by id
    rows += [(i, [rng.random() for _ in range(3)], i % 2) for i in range(400, 460)]  # another length
    rows += [(600, None, 1), (601, [1.0, None], 1), (602, [float("nan")] * 6, 1), (603, [float("inf")] * 6, 2), (None, [1.0] * 6, 1)]
    rows += [(604, [1.0] * 6, None), (700, [], 1), (701, [], 2), (800, [3e9, -3e9] * 3, 1), (801, [3e9, 1.0] * 3, 2), (802, [3e9, 2.0] * 3, 1)]
    rows += [(0, [2.0] * 6, 1), (0, [2.0] * 6, 1), (100, [0.25] * 6, 3), (900, [-1.0] * 6, 9)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA).repartition(5)
    anchors = F.col("id") % 10 == 0
    assert result(hard_negatives.mine(table, anchors)) == plain(rows, every=10)
    assert result(hard_negatives.mine(table.limit(0), anchors)) == []


def test_blocks_of_anchors_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(400)]
    table = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table.collect()]
    monkeypatch.setattr(hard_negatives, "BLOCK_NUMBERS", 64)
    found = hard_negatives.mine(table, F.col("id") % 20 == 0, n_positives=3, n_negatives=4, low=50, high=95)
    assert result(found) == plain(rows, 20, 3, 4, 50, 95)


@pytest.mark.parametrize("size", [0, 1, 3, 7, 64, 100])
def test_summaries_bound_inner_products(size):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-300, 300, (50, size)) + rng.integers(-200, 200, (50, 1)) for _ in range(2))
    left, right = (hard_negatives.Summaries.of(x, [hard_negatives.summarise(x, s) for s in hard_negatives.SEGMENTS]) for x in (a, b))
    exact, widths = (a * b).sum(axis=1), []
    for (m, d), (n, e) in zip(left.levels, right.levels, strict=True):
        middle, width = (m * n).sum(axis=1), (d * e).sum(axis=1)
        assert (exact <= middle + width + 1e-6).all() and (exact >= middle - width - 1e-6).all()
        widths.append(width.mean())
    assert size < 7 or widths[1] < widths[0]


def test_summaries_spare_exact_scores():
    """Vectors around a few centres: most pairs are settled by their summaries."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 200, (40, 1, 4)).repeat(16, axis=2).reshape(40, 64)
    vectors = (centres[rng.integers(0, 40, 4000)] + rng.normal(0, 20, (4000, 64))).astype(np.int64)
    labels, ids = rng.integers(0, 2, 4000), np.arange(4000)
    whole = hard_negatives.Summaries.of(vectors, [hard_negatives.summarise(vectors, s) for s in hard_negatives.SEGMENTS])
    few = slice(0, 40)
    floors, caps = np.full((40, 1), -(1 << 62)), np.full((40, 1), 1 << 62)
    anchors = hard_negatives.Anchors(ids[few], labels[few], whole.part(few), floors, caps, 5, True)
    anchors.offer(ids, labels, whole)
    best = defaultdict(list)
    for a, row, score in anchors.found():
        best[a].append((-score, row))
    for a in range(40):
        scores = vectors @ vectors[a]
        wanted = sorted((-int(scores[i]), i) for i in ids if i != a and labels[i] == labels[a])[:5]
        assert sorted(best[a]) == wanted
    assert anchors.scored < anchors.bounded / 2 and anchors.scored <= anchors.refined
