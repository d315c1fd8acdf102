"""Nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adflow.llm import ann


def brute(rows, k):
    own = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in own:
        if q % 100:
            continue
        for i, y in own:
            if i != q:
                d = float(np.sqrt(((x - y) ** 2).sum()))
                out.setdefault(q, {})
                out[q][i] = min(d, out[q].get(i, np.inf))
    return {q: sorted((d, i) for i, d in near.items())[:k] for q, near in out.items()}


def test_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, 10)
    got = {}
    for r in ann.ann_report(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in near})
    assert hits / sum(map(len, want.values())) >= 0.9


def test_awkward_vectors(spark):
    rng = random.Random(17)
    rows = [(None, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []),
            (100, [1.0, 1.0]), (100, [5.0, 5.0]), (200, [1.0, 1.0]), (201, [1.0, 1.0]), (202, [1.0, 1.0]), (202, [4.0, 5.0]), (7, [1.0, 2.0, 3.0])]
    rows += [(1000 + i, [rng.random(), rng.random()]) for i in range(300)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, leaf string, id int")
    typed = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 7]
    want = brute(typed, 10)
    got = {}
    for r in ann.nearest(df, F.col("id") % 100 == 0, target=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in want[q]], abs=1e-12)


def test_blocks_of_a_hot_leaf(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 1000, 10)] + [(i, [float(i), 1.0, 0.0]) for i in range(1, 100, 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") % 100 == 0, k=3).collect()
    for r in got:
        assert r["score"] == 0 and r["vec_id"] == [i for i in range(0, 1000, 10) if i != r["query_id"]][r["rank"] - 1]
    assert len(got) == 30


def test_few_and_no_candidates(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(100, [1.0]), (1, [3.0])], schema)
    assert [tuple(r) for r in ann.ann_report(two).collect()] == [(100, 1, 1, 2.0)]
    assert ann.ann_report(spark.createDataFrame([(100, [1.0])], schema)).count() == 0
    assert ann.ann_report(spark.createDataFrame([], schema)).count() == 0


def test_recall_of_a_table_that_starts_with_copies(spark):
    """What stands first must not decide how many leaves all queries visit; no query may come back short."""
    rng = np.random.default_rng(31)
    rows = [(i + 1, [9.0] * 8) for i in range(150) if (i + 1) % 100] + [(200 + i, rng.normal(size=8).tolist()) for i in range(3000)]
    rows += [(100 * (100 + n), [50.0 * (n + 1) * (j == n) for j in range(8)]) for n in range(8)]   # far from all others
    got = {}
    for r in ann.ann_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(rows, 10)
    assert set(got) == set(want) and all(len(near) == 10 for near in got.values())
    hits = sum(len(got[q] & {i for _, i in near}) for q, near in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_a_leaf_of_one_id_is_one_item():
    tree = ann.Tree(np.array([[0.0], [0.1], [10.0], [10.1], [20.0], [20.1]]), 2)
    at = tree.place(np.array([[0.0], [10.0], [20.0]])).tolist()
    assert len(set(at)) == 3
    items = {at[0]: 1, at[1]: 4, at[2]: 20}
    assert tree.nearest_leaves(np.array([0.0]), 1) == [at[0]]
    assert set(tree.nearest_leaves(np.array([0.0]), 1, items, 6)) >= set(at)
