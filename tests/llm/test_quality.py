"""Random indexing against a brute-force sum, pooling, and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa

from adflow.llm import quality

from .tables import awkward, documents


def test_contexts_are_the_sum_of_the_neighbours_index_vectors():
    texts = pa.array(["a b a c", None, "b", "", "c!! b 12"])
    rows, ends = quality.rows_of(texts)
    dims, signs = quality.index_vectors()
    table = np.zeros(quality.WORDS * quality.DIMS)
    quality.add_contexts(table, rows, ends)
    want = np.zeros((quality.WORDS, quality.DIMS))
    for t in range(len(texts)):
        own = rows[ends[t]:ends[t + 1]]
        for i, w in enumerate(own):
            for j in (i - 1, i + 1):
                if 0 <= j < len(own):
                    np.add.at(want[w], dims[own[j]], signs[own[j]])
    assert np.array_equal(table.reshape(want.shape), want)
    assert (np.diff(ends) == [4, 0, 1, 0, 4]).all()


def test_pool_does_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(quality.WORDS, quality.DIMS)).astype(np.float32)
    texts = ["a b c", None, "", "d d d d", "one"]
    together = quality.pool(pa.array(texts), table)
    for t, text in enumerate(texts):
        assert np.allclose(together[t], quality.pool(pa.array([text], pa.string()), table)[0])
    assert not together[1].any() and not together[2].any()


def test_held_out_accuracy_and_calibration(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = quality.quality_report(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert ((got.score - got.quality) ** 2).mean() < 0.04


def test_awkward_rows(spark):
    rows = awkward(random.Random(6))
    docs = documents(spark, rows, clash=["score", "predicted", "__text", "__label", "held_out"])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20, 60)] + [(3, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_without_labels_or_rows(spark):
    docs = documents(spark, [(1, "a b", None, "s"), (2, None, None, "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality_report(docs, none).collect()} == {0.5}
    good = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.99 for r in quality.quality_report(docs, good).collect())
    assert quality.quality_report(documents(spark, []), good).count() == 0
