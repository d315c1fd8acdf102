"""Near duplicates against brute force over all pairs, and the sketch against exact similarities."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adflow.llm import near_dedup as near
from adflow.llm.base import Scratch
from adflow.llm.components import components

from .tables import awkward, documents, prose


def runs(text):
    words = "".join(c.lower() if c < "\x80" else c for c in text or "").split()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def exact(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in keys if x[i] and y[i])


def classes(rows):
    """Brute force over all pairs; texts without words stand with their copies only."""
    own = [runs(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or own[a] and own[b] and exact(own[a], own[b]) >= 0.8:
                parent[find(a)] = find(b)
    return [find(a) for a in range(len(rows))]


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_similarity_is_probability_jaccard():
    rng = random.Random(7)
    left, right = [], []
    for _ in range(150):
        base = prose(rng, rng.randint(1, 60)) if rng.random() < .7 else "de de de la la " * rng.randint(1, 12)
        left.append(base)
        right.append(edited(rng, base * rng.choice([1, 1, 2]), rng.randint(0, 4)))
    got = near.similarities(pa.array(left), pa.array(right))
    for a, b, s in zip(left, right, got, strict=True):
        assert s == pytest.approx(exact(runs(a), runs(b)), abs=1e-9)


def test_registers_agree_with_the_similarity():
    rng = random.Random(8)
    left = [prose(rng, rng.randint(3, 300)) for _ in range(200)]
    right = [edited(rng, t, len(t.split()) // 30) for t in left]
    sides = [pa.array(left), pa.array(right)]
    sign = [near.prob_minhash(*near.weighted_runs(s), 200, 192) for s in sides]
    error = (sign[0] == sign[1]).mean(axis=1) - near.similarities(*sides)
    assert abs(error.mean()) < 0.01 and np.abs(error).max() < 0.18


def test_one_run_fills_all_registers():
    out = near.prob_minhash(np.array([0]), np.array([77], np.uint64), np.array([1]), 2, 192)
    assert (out[0] == 77).all() and not out[1].any()


@pytest.mark.parametrize("block", [2048, 5])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    """With blocks of five texts, most buckets are dealt anew by finer registers and compared block by block."""
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(9)
    rows = awkward(rng)
    for k in range(12):   # families whose members are near one another, but not all of them
        base = prose(rng, rng.randint(30, 160))
        rows += [(1000 + 50 * k + i, edited(rng, base, rng.randint(0, 2)), "aa", "s") for i in range(12)]
    chain = prose(rng, 100)
    for i in range(15):   # each is near the next one only
        rows.append((3000 + i, chain, "aa", "s"))
        chain = edited(rng, chain, 1)
    got = near.near_classes(documents(spark, rows, clash=["a", "b", "key", "node"])).collect()
    assert len(got) == len(rows)
    hashes = {(r["id"], r["a"], r["b"]): r for r in got}
    assert len({(r["a"], r["b"]) for r in got}) == len({t or "" for _, t, *_ in rows})
    want = classes(rows)
    members = {}
    for n, root in enumerate(want):
        members.setdefault(root, []).append(rows[n][0])
    report = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in near.near_report(documents(spark, rows)).collect())
    least = {root: min((i for i in own if i is not None), default=None) for root, own in members.items()}
    assert report == Counter((rows[n][0], least[root], len(members[root])) for n, root in enumerate(want))
    assert hashes


def test_pairs_that_share_one_large_bucket_only(spark):
    """The texts of one large bucket, dealt anew, meet as they do in the whole bucket."""
    rng = random.Random(19)
    rows, base = [], prose(rng, 300).split()
    for i in range(60):   # a cloud: all in one bucket, most of them not alike, and twins of 0.9 among them
        other = prose(rng, 300).split()
        text = base[:200] + other[:40 + i]
        rows += [(2 * i, " ".join(text), "aa", "s"), (2 * i + 1, " ".join([*text[:-2], "zz"]), "aa", "s")]
    open_ = spark.createDataFrame([(7, 0, n, n, len(rows)) for n in range(len(rows))], "key long, band int, node long, label long, n long")
    texts = spark.createDataFrame([(n, r[1]) for n, r in enumerate(rows)], "node long, text string")
    fine = near.finer_marks(texts)
    first = near.prob_minhash(*near.weighted_runs(pa.array([r[1] for r in rows])), len(rows), 192) >> np.uint64(56)
    marks = spark.createDataFrame([(n, bytearray(m.astype(np.uint8).tobytes()), [7]) for n, m in enumerate(first)],
                                  "node long, marks binary, keys array<long>").join(fine, "node")
    whole = {tuple(r) for r in near._possible(open_, marks, 0.8).collect()}
    split = near.split_keys(texts)
    finer = split.select("node", F.col("node").alias("label"), F.posexplode("keys").alias("band", "key"))
    met = {tuple(r) for r in near._possible(near._mixed(finer), marks.drop("keys").join(split, "node"), 0.8).collect()}
    alike = {(u, v) for u, v in whole if exact(runs(rows[u][1]), runs(rows[v][1])) >= 0.8}
    assert len(alike) >= 60 and alike <= met


def test_dedup_keeps_one_row_of_each_class(spark):
    rng = random.Random(10)
    base = prose(rng, 80)
    rows = [(5, base, "aa", "s"), (5, base, "aa", "s"), (6, base + " x", "aa", "s"), (7, prose(rng, 50), "aa", "s"), (8, "", "aa", "s"), (9, None, "aa", "s")]
    got = near.near_dedup(documents(spark, rows, clash=["row", "id"]))
    assert got.columns[-2:] == ["row", "id"]
    assert sorted(r["doc_id"] for r in got.collect()) == [5, 7, 8]
    assert near.near_report(documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] \
        + [(2000 + i, 2001 + i) for i in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect()}
    parent = {n: n for e in edges for n in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {n: find(n) for n in parent}


def test_a_band_that_agrees_by_bytes_only_is_not_the_first_shared(spark):
    """Nodes 1 and 2 agree in all bytes of band 0, yet stand in other buckets there; they share that of band 1."""
    byte, fine = bytes(range(12)), bytes([7] * near.FINE)
    placed = [(11, 0, 1), (11, 0, 3), (12, 0, 2), (12, 0, 4), (21, 1, 1), (21, 1, 2)]
    open_ = spark.createDataFrame([(k, b, n, n, 2) for k, b, n in placed], "key long, band int, node long, label long, n long")
    keys = {1: [11, 21], 2: [12, 21], 3: [11, 23], 4: [12, 24]}
    other = bytes([99] * 12), bytes([8] * near.FINE)
    marks = spark.createDataFrame([(n, bytearray(byte if n < 3 else other[0]), bytearray(fine if n < 3 else other[1]), k) for n, k in keys.items()],
                                  "node long, marks binary, fine binary, keys array<long>")
    got = near._possible(open_, marks, 0.8)
    assert [tuple(r) for r in got.collect()] == [(1, 2)]
