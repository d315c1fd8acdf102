"""Benchmark decontamination: the automaton and the operator against plain windows."""

import hashlib
import random
import re

import pytest

from adflow.llm import decontaminate as dc
from adflow.llm.base import UPPER

from .tables import awkward, documents, prose

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(UPPER, UPPER.lower())))


def brute(docs, items, window=dc.WINDOW):
    """n_words, hit positions and item ids of each text."""
    windows = {}
    for i, text in items:
        w = words(text)
        for at in range(max(len(w) - window + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[at:at + window]), set()).add(i)
    sizes = {len(t) for t in windows}
    out = []
    for text in docs:
        w = words(text)
        hit, held = set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                ids = windows.get(tuple(w[at:at + n]))
                if ids:
                    hit.update(range(at, at + n))
                    held |= ids
        out.append((len(w), hit, held - {None}))
    return out


@pytest.mark.parametrize("letters,window", [("ab", 3), ("abc", 4), ("abcdefgh", 2), ("a", 5)])
def test_automaton_against_all_windows(letters, window):
    rng = random.Random(f"{letters}{window}")
    for _ in range(60):
        items = [(i % 5, [ord(rng.choice(letters)) for _ in range(rng.randint(1, 14))]) for i in range(8)]
        automaton = dc.Automaton([(w, i) for i, w in items], window)
        text = [ord(rng.choice(letters + "z")) for _ in range(60)]
        want = set()
        for i, w in items:
            n = min(window, len(w))
            for at in range(len(w) - n + 1):
                want |= {(p, p + n, i) for p in range(len(text) - n + 1) if text[p:p + n] == w[at:at + n]}
        assert {(s, e, i) for s, e, held in automaton.hits(text) for i in held} == want


def planted(rng):
    items = [(i, prose(rng, rng.choice([1, 2, 5, 9, 10, 11, 40]))) for i in range(12)]
    items += [(3, prose(rng, 30)), (None, prose(rng, 20)), (50, None), (51, ""), (52, "!!! ..."), (53, items[6][1]),
              (54, "Ünï 日本 " + prose(rng, 12)), (None, None)]
    rows = awkward(rng)
    for n, (_, text) in enumerate(items):
        if text:
            w = text.split()
            rows.append((1000 + n, prose(rng, 30) + " \n" + " -- ".join(w).upper() + "! " + prose(rng, 5), "aa", "s"))
            rows.append((2000 + n, prose(rng, 3) + " " + " ".join(w[3:16]) + " " + " ".join(w[1:12]), None, "t"))
    return rows, items


@pytest.mark.parametrize("block,least", [(dc.BLOCK, 0), (60, 0), (dc.BLOCK, 10), (60, 10)])
def test_matches_against_all_windows(spark, block, least):
    rows, items = planted(random.Random(5))
    items = [(i, t) for i, t in items if not least or not 0 < len(words(t)) < least]
    docs = documents(spark, rows, clash=["spans", "runs", "uid", "row", "words_of"])
    table = spark.createDataFrame(items, "item_id long, text string")
    got = dc.matches(docs, table, block=block).collect()
    key = lambda r: (str(r[0]), str(r[1]), str(r[2:]))
    want = sorted([(r[0], r[1], n, sorted(hit), sorted(held)) for r, (n, hit, held) in
                   zip(rows, brute([r[1] for r in rows], items), strict=True)], key=key)
    assert sorted([(r["doc_id"], r["text"], r["n_words"],
                    [p for s in r["spans"] for p in range(s["start"], s["end"])], r["items"]) for r in got], key=key) == want
    assert all(a["end"] < b["start"] for r in got for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    assert sum(len(w[3]) > 0 for w in want) > 10
    assert {r["uid"] for r in got} == {"x"}


def test_long_item_in_stretches(spark, monkeypatch):
    rng = random.Random(6)
    item = prose(rng, 3 * dc.STRETCH + 5)
    w = item.split()
    at = dc.STRETCH - 4
    rows = [(1, " ".join(w[at:at + 10]), "aa", "s"), (2, " ".join(w[-10:]), "aa", "s"), (3, " ".join(w[at:at + 9]), "aa", "s")]
    got = dc.matches(documents(spark, rows), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {r["doc_id"]: r["items"] for r in got.collect()} == {1: [7], 2: [7], 3: []}


def test_report_and_empty_tables(spark):
    rows, items = planted(random.Random(8))
    docs = documents(spark, rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted([tuple(r) for r in dc.decontamination_report(docs, table).collect()], key=str)
    want = []
    for r, (n, hit, held) in zip(rows, brute([r[1] for r in rows], items), strict=True):
        ids = ",".join(sorted(map(str, held)))
        want.append((r[0], n, len(hit), len(held), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=str)
    none = dc.decontamination_report(docs, table.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["contaminated"] for r in none)
    assert dc.decontamination_report(docs.limit(0), table).count() == 0


def test_spans_are_cut_and_covered_documents_go(spark):
    rng = random.Random(9)
    item = prose(rng, 20)
    before, after = prose(rng, 40), prose(rng, 30)
    rows = [(1, f"{before}. {item.title()}! {after}", "aa", "s"), (2, item + " end", "aa", "s"), (3, before, "aa", "s"),
            (4, None, "aa", "s"), (5, before + "  " + item + " ...", "aa", "s")]
    docs = documents(spark, rows, clash=["row", "spans", "n_words"])
    got = dc.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: f"{before}. {after}", 3: before, 4: None, 5: before + "  "}
    assert {r["spans"] for r in got.collect()} == {"x"}
