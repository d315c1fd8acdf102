"""Cross-parsing against a brute-force parse, and held-out accuracy."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from adflow.llm import langid

from .tables import awkward, documents


def brute_phrases(text: bytes, sample: bytes) -> int:
    at = count = 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at:at + size] in sample:
            size += 1
        at += max(1, size - 1)
        count += 1
    return count


def test_phrases_equal_a_brute_force_parse(monkeypatch):
    monkeypatch.setattr(langid, "LANE", 64)
    monkeypatch.setattr(langid, "LANES", 5)
    rng = random.Random(4)
    sample = {k: "".join(rng.choice(k) for _ in range(400)) for k in ("abc ", "bcd ", "abéx ")}
    model = tuple((k, langid.normalise(pa.array([v]))[0].tobytes()) for k, v in sorted(sample.items()))
    texts = pa.array([None, "", "a", "zz q", *["".join(rng.choice("abcdéxz 1!\n") for _ in range(rng.randint(0, 300))) for _ in range(60)]])
    data, ends = langid.normalise(texts)
    found = langid.Parser(model).phrases(data, ends)
    for t in range(len(texts)):
        text = data[ends[t]:ends[t + 1]].tobytes()
        for k, (_, own) in enumerate(model):
            assert found[k, t] == sum(brute_phrases(text[at:at + 64], own) for at in range(0, len(text), 64))


def test_many_languages_are_small():
    """100 samples of full size: a few MB a language, and all of them parsed at once."""
    rng = random.Random(14)
    model = []
    for k in range(100):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzàâçèéêëîïôùûüÿæœßäöåøñ", 30)
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(400)]
        text = " ".join(words[min(int(rng.expovariate(0.02)), 399)] for _ in range(6000))
        model.append((f"l{k:03d}", text.encode()[:langid.SAMPLE]))
    own = langid.Parser(tuple(model))
    assert own.table.dtype == own.lone_entry.dtype == "int32"
    assert own.table.nbytes + own.lone_entry.nbytes + own.lone_symbol.nbytes < 100 * 5_000_000
    text = pa.array([model[37][1][5000:9000].decode("utf-8", "ignore")])
    found = own.phrases(*langid.normalise(text))
    assert int(found[:, 0].argmin()) == 37 and found[37, 0] <= 6


def test_normalise_keeps_letters_and_single_blanks():
    data, ends = langid.normalise(pa.array(["Ab1,, C", None, "..É"]))
    assert [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)] == [b"ab c", b"", " é".encode()]


def test_held_out_accuracy_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_report(docs).where("held_out").join(docs, "doc_id")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_awkward_rows(spark):
    rows = awkward(random.Random(5))
    docs = documents(spark, rows, clash=["score", "lang_pred", "__lang"])
    model = langid.learn(docs, ~langid.held_out())
    assert [lang for lang, _ in model] == ["aa", "bb"]
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:
            assert r["lang_pred"] in ("aa", "bb")
    report = langid.language_report(docs)
    assert report.columns == ["doc_id", "held_out", "lang_pred", "score"] and report.count() == len(rows)


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "some text", None, "s"), (2, None, "aa", "s")])
    assert {(r["lang_pred"], r["score"]) for r in langid.language_report(docs).collect()} == {("und", 0.0)}
    assert langid.language_report(documents(spark, [])).count() == 0


def test_tiny_samples_are_not_cheap(spark):
    """One rare label on numbers, or on a single word, must not take the texts of other languages."""
    rng = random.Random(6)
    words = {"aa": [f"{a}{b}" for a in "bcdf" for b in ("an", "en", "ol")], "bb": [f"{a}{b}" for a in "klmn" for b in ("ik", "ut", "ar")]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(10 * n + k, text(lang, 60), lang, "s") for n in range(40) for k, lang in enumerate(words)]
    rows += [(9001, "12 34 56", "zxx", "s"), (9002, "ok", "xx", "s")]
    docs = documents(spark, rows)
    model = langid.learn(docs, F.lit(True))
    assert [lang for lang, _ in model] == ["aa", "bb", "xx"]
    for own in (model, (*model, ("zxx", b" "))):
        got = langid.identify(documents(spark, [(n, text(lang, 60), lang, "s") for n, lang in enumerate(["aa", "bb"] * 10)]), own).collect()
        assert all(r["lang_pred"] == r["lang"] for r in got)
