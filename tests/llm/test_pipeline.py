"""The pipeline, stage by stage, against what each stage promises."""

import random
from collections import Counter

import corpus_pipeline as C
from adflow.llm.base import Scratch

from .tables import awkward, documents, prose
from .test_near_dedup import classes, edited
from .test_sql_operators import norm


def test_stages(spark):
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "bpe"]
    rng = random.Random(22)
    rows = awkward(rng)
    base = prose(rng, 90)
    rows += [(700 + i, edited(rng, base, 1), "aa", "s") for i in range(6)]
    docs = documents(spark, rows)
    scratch = Scratch(spark, "stages")
    out = []
    for n, (name, stage) in enumerate(C.STAGES):
        columns = docs.columns
        docs = scratch.write(stage(spark, docs, ""), name)
        out.append(docs.collect())
        if n < 4:
            assert docs.columns == columns
    lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert Counter(tuple(r)[:4] for r in out[0]) == Counter(lettered)
    assert Counter(norm(r["text"]) for r in out[1]) == Counter({norm(t): 1 for _, t, *_ in lettered})
    kept = [tuple(r)[:4] for r in out[1]]
    groups = {}
    for row, label in zip(kept, classes(kept), strict=True):
        groups.setdefault(label, []).append(row[0])
    least = {min((i for i in g if i is not None), default=None) for g in groups.values()}
    assert Counter(r["doc_id"] for r in out[2]) == Counter({i: 1 for i in least})
    assert {r["doc_id"] for r in out[3]} <= least
    assert Counter(r["doc_id"] for r in out[4]) == Counter(r["doc_id"] for r in out[3])


def test_stages_keep_columns_of_any_name(spark):
    names = ["lang_found", "_lang_found", "lang_score", "_lang_score", "row", "rid", "copy", "shuffle_key", "key", "node"]
    rng = random.Random(23)
    docs = documents(spark, [(i, prose(rng, 60), "aa", "s") for i in range(12)], clash=names)
    scratch = Scratch(spark, "clash")
    for name, stage in C.STAGES[:4]:
        docs = scratch.write(stage(spark, docs, ""), name)
        assert docs.columns[-len(names):] == names
        assert {r[n] for r in docs.collect() for n in names} <= {"x"} and (docs.count() == 12 or name == "mix_sources")


def test_run_and_an_empty_table(spark, tmp_path):
    got = C.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "source", "ids"] and got.count() > 0
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
