import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from texspark.llm import top_k

VECTORS = "vec_id long, vector array<long>, label int, asks int"


def brute(rows, k):
    out = []
    width = max(len(v) for _, v in rows)
    pad = lambda v: np.array([*v, *[0] * (width - len(v))], dtype=object)
    for q in sorted({i for i, _ in rows if i % 5 == 0}):
        (query, *_) = [pad(v) for i, v in rows if i == q]
        best = sorted((-int(query @ pad(v)), i) for i, v in rows if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "width", "spread"), [(1, 4, 3), (4, 4, 3), (300, 8, 50), (300, 2, 1)])
def test_search_as_by_brute_force(spark, monkeypatch, n, width, spread):
    monkeypatch.setattr(top_k, "SHARD", 64)
    monkeypatch.setattr(top_k, "BLOCK", 16)
    monkeypatch.setattr(top_k, "PIVOTS", 3)
    monkeypatch.setattr(top_k.BallTree.__init__, "__defaults__", (True, 8))
    rng = random.Random(n + width)
    rows = [(i, [rng.randint(-spread, spread) for _ in range(width if i % 7 else width - 1)]) for i in range(n)]
    odd = [(None, [1, 2]), (n + 1, None), (n + 2, [1, None])]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows + odd], VECTORS).repartition(3)
    got = [tuple(r) for r in top_k.search(df, F.col("vec_id") % 5 == 0).collect()]
    assert sorted(got) == brute(rows, 5)


def test_balls_hold_their_vectors_and_few_leaves_are_opened():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 100
    vectors = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(2000, 16)))
    tree = top_k.BallTree(np.arange(2000), vectors)
    for (a, b), centre, radius in zip(tree.runs, tree.centres, tree.radii, strict=True):
        assert (np.sqrt(((tree.vectors[a:b] - centre) ** 2).sum(axis=1)) <= radius + 1e-9).all()
    best = tree.search(vectors[5], 5, 5, None)
    assert tree.opened < len(tree.runs) / 4
    assert best == tree.search(vectors[5], 5, 5, best[-1][0]) == sorted(((int(vectors[i] @ vectors[5]), int(i)) for i in range(2000) if i != 5), key=lambda x: (-x[0], x[1]))[:5]


def test_scores_that_doubles_do_not_hold(spark):
    rows = [(0, [1 << 28, 1])] + [(i, [1 << 29, i % 3 + i // 40]) for i in range(1, 60)]
    got = top_k.search(spark.createDataFrame(rows, "vec_id long, vector array<long>"), F.col("vec_id") % 5 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5)
    with pytest.raises(OverflowError):
        top_k.search(spark.createDataFrame([(0, [1 << 40]), (1, [1])], "vec_id long, vector array<long>"), F.col("vec_id") == 0)


def test_one_vector_asks_for_an_id(spark):
    rows = [(0, [2, 1]), (0, [1, 2]), (0, [1, 2]), (1, [0, 1]), (2, [1, 0])]
    got = top_k.search(spark.createDataFrame(rows, "vec_id long, vector array<long>"), F.col("vec_id") == 0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 2), (0, 2, 2, 1)]


def test_repeated_vectors_tie_to_smaller_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(i, [1, 1], 0, 0) for i in range(30)], VECTORS)
    got = top_k.search(df, F.col("vec_id") == 3).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 0, 2), (2, 1, 2), (3, 2, 2), (4, 4, 2), (5, 5, 2)]
    assert top_k.search(df.limit(0), F.col("vec_id") == 3).collect() == []
