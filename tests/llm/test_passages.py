"""Repeated passages against brute force, chains against a quadratic search."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from adflow.llm import passages as P
from adflow.llm.base import Scratch
from adflow.llm.words import word_hashes

from .tables import awkward, documents, prose


def test_chains_equal_a_quadratic_search():
    rng = random.Random(18)
    for _ in range(150):
        n = rng.randint(1, 25)
        here = np.array([rng.randrange(40) for _ in range(n)])
        there = np.array([rng.randrange(40) for _ in range(n)])
        order = sorted(range(n), key=lambda j: (there[j], here[j]))
        score = {}
        for j in order:
            before = [score[i] - P.GAP * (here[j] - here[i] + there[j] - there[i]) for i in order
                      if i in score and here[i] < here[j] and there[i] < there[j]]
            score[j] = P.SEED + max([0, *before])
        best = P.best_chains(here, there)[0]
        gained = P.SEED * len(best) - P.GAP * (here[best[-1]] - here[best[0]] + there[best[-1]] - there[best[0]])
        assert abs(gained - max(score.values())) < 1e-9
        assert all(here[a] < here[b] and there[a] < there[b] for a, b in zip(best, best[1:], strict=False))


def test_minimisers_meet_on_shared_words():
    rng = random.Random(19)
    shared = prose(rng, P.SEED + P.WINDOW - 1)
    texts = [prose(rng, rng.randint(30, 60)) + " " + shared + " " + prose(rng, rng.randint(30, 60)) for _ in range(30)]
    words, _, ends = word_hashes(pa.array([*texts, None, "", "a b", "la " * 300]))
    owner, place, value = P.minimisers(words, ends)
    found = [set(value[owner == t].tolist()) for t in range(30)]
    assert set.intersection(*found)
    assert not (np.isin([30, 31, 32], owner)).any()
    assert 3 <= (owner == 33).sum() <= 20    # a repeated word is thinned, too


def covered(rows):
    out = defaultdict(set)
    for r in rows:
        out[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        out[r["hub_doc_id"]] |= set(range(r["hub_start"], r["hub_end"]))
    return out


def test_planted_passages_are_found_and_others_left_alone(spark):
    rng = random.Random(20)
    exact, fuzzy, hot = prose(rng, 60), prose(rng, 150), prose(rng, 55)
    rows, planted = [], {}
    for i in range(40):
        a, b = prose(rng, rng.randint(20, 200)), prose(rng, rng.randint(20, 200))
        middle, size = "", 0
        if i < 4:
            middle, size = exact, 60
        elif i < 8:
            words = fuzzy.split()
            words[40] = f"changed{i}"
            words.insert(90, f"added{i}")
            del words[120]
            middle, size = " ".join(words), len(words)
        elif i < 25:
            middle, size = hot, 55
        rows.append((i, f"{a} {middle} {b}", "aa", "s"))
        if size:
            planted[i] = (len(a.split()), len(a.split()) + size)
    got = P.repeated_passages(documents(spark, rows, clash=["u", "v", "uid"])).collect()
    spans = covered(got)
    assert set(spans) == set(planted)
    for i, (s, e) in planted.items():
        assert len(set(range(s, e)) - spans[i]) <= 3 and len(spans[i] - set(range(s, e))) <= 6
    text = {i: t.split() for i, t, *_ in rows}
    for r in got:
        assert r["passage"].split() == text[r["doc_id"]][r["start_word"]:r["end_word"]]
        assert r["similarity"] >= 0.8
    assert len(got) < 40    # one row a repeat, not one a pair


def test_exact_repeats_of_the_documents_are_covered(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r["doc_id"]: r["text"].lower().split() for r in docs.select("doc_id", "text").collect()}
    seen = defaultdict(set)
    for i, w in words.items():
        for at in range(len(w) - 49):
            seen[tuple(w[at:at + 50])].add(i)
    spans = covered(P.passages_report(docs).collect())
    for i, w in words.items():
        for at in range(len(w) - 49):
            if len(seen[tuple(w[at:at + 50])]) > 1:
                assert set(range(at, at + 50)) <= spans[i]


def test_awkward_rows(spark):
    rows = awkward(random.Random(21))
    got = P.passages_report(documents(spark, rows)).collect()
    pairs = {(r["doc_id"], r["hub_doc_id"]) for r in got}
    assert {3, 4, 5} <= {i for p in pairs for i in p}      # equal, upper-cased and longer by a word
    assert P.passages_report(documents(spark, [])).count() == 0


def test_passages_put_together_from_sentences_that_occur_elsewhere(spark):
    """The seeds of the passage have other hubs, each of which holds one sentence only."""
    rng = random.Random(22)
    rows, composed = [], {}
    for k, parts in enumerate([2, 2, 2, 3, 3, 4, 4, 2, 3, 4]):
        own = [prose(rng, 52 // parts + 1) for _ in range(parts)]
        for cut in range(parts):   # also what straddles two sentences has an earlier place, too short to be a passage
            rows.append((len(rows), f"{prose(rng, 40)} {own[cut]} {prose(rng, 40)}", "aa", "s"))
            if cut:
                joint = " ".join([*own[cut - 1].split()[-8:], *own[cut].split()[:8]])
                rows.append((len(rows), f"{prose(rng, 40)} {joint} {prose(rng, 40)}", "aa", "s"))
        for _ in range(2):
            before = prose(rng, rng.randint(30, 60))
            composed[len(rows)] = (len(before.split()), len(before.split()) + sum(len(s.split()) for s in own))
            rows.append((len(rows), f"{before} {' '.join(own)} {prose(rng, 50)}", "aa", "s"))
    spans = covered(P.repeated_passages(documents(spark, rows).coalesce(1)).collect())
    assert set(spans) == set(composed)
    for i, (s, e) in composed.items():
        assert len(set(range(s, e)) - spans[i]) <= 3 and len(spans[i] - set(range(s, e))) <= 6


def patchwork(rng, parts, holders, edits, size=80):
    """Two texts that share an edited passage, each part of which occurs in ``holders`` other texts as well."""
    words = prose(rng, size).split()
    step = size // parts
    others = [f"{prose(rng, 30)} {' '.join(words[k * step:(k + 1) * step])} {prose(rng, 30)}" for k in range(parts) for _ in range(holders)]
    edited = list(words)
    for at in rng.sample(range(size), edits):
        edited[at] = f"new{rng.randrange(10 ** 9)}"
    return others, [f"{prose(rng, 30)} {' '.join(w)} {prose(rng, 30)}" for w in (words, edited)]


def test_edited_passages_put_together_from_sentences_that_occur_elsewhere(spark):
    """Every seed has another hub, in four to a hundred other texts; 80 words with 3 to 12 edits (96 to 85 % alike)."""
    rng = random.Random(24)
    rows, pairs = [], []
    for parts, holders, edits in [(4, 1, 3)] * 20 + [(4, 3, 3)] * 10 + [(4, 25, 3)] * 4 + [(3, 2, 8)] * 10 + [(2, 2, 8)] * 6 + [(4, 1, 12)] * 10:
        others, (a, b) = patchwork(rng, parts, holders, edits)
        rows += [(len(rows) + n, t, "aa", "s") for n, t in enumerate(others)]
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows) + n, t, "aa", "s") for n, t in enumerate((a, b))]
    got = {tuple(sorted((r["doc_id"], r["hub_doc_id"]))) for r in P.repeated_passages(documents(spark, rows)).collect()}
    met = sum(p in got for p in pairs) / len(pairs)
    print(f"recall {met:.3f} of {len(pairs)}")
    assert met >= 0.95


def test_leaders_of_a_seed(monkeypatch):
    """At most one match a place; twins meet, however many other places the seed has."""
    rng = np.random.default_rng(3)
    n = 150
    for rounds, direct in ((200, 2048), (3, 2048), (3, 100)):
        monkeypatch.setattr(P, "ROUNDS", rounds)
        seed = np.repeat([5, 6, 7, 9], [2 * n, 1, 2, 2 * n])
        node = np.arange(len(seed))
        sides = rng.integers(1, 256, (len(seed), 2 * P.SIDE), dtype=np.uint8)
        twins = set()
        for base in (0, 2 * n + 3):
            sides[base + n:base + 2 * n] = sides[base:base + n]
            spoiled = rng.random((n, 2 * P.SIDE)) < 0.12
            sides[base + n:base + 2 * n][spoiled] = 0
            twins |= {(base + n + i, base + i) for i in range(n)}
        a, b = P.meet(seed, node, sides, direct)
        got = set(zip(a.tolist(), b.tolist(), strict=True))
        assert len(a) == len(set(a.tolist())) and (seed[a] == seed[b]).all() and (a > b).all()
        assert len(twins & got) >= (0.97 if direct > 2 * n else 0.9) * len(twins) and len(got - twins) <= 6


def crowded(rng, n):
    """Places of two seeds with ``n`` leaders and as many twins each: a twin agrees in two words of every quarter only."""
    seed = np.repeat([4, 5, 6], [2 * n, 3, 2 * n])
    sides = rng.integers(1, 256, (len(seed), 2 * P.SIDE), dtype=np.uint8)
    twins = set()
    for base in (0, 2 * n + 3):
        sides[base + n:base + 2 * n] = sides[base:base + n]
        for at in range(0, 2 * P.SIDE, 4):
            sides[base + n:base + 2 * n, at:at + 2] = 0
        twins |= {(base + n + i, base + i) for i in range(n)}
    return seed, sides, twins


def test_leaders_beyond_the_direct_ones_are_all_compared():
    seed, sides, twins = crowded(np.random.default_rng(31), 400)
    node = np.arange(len(seed))
    whole = [m.tolist() for m in P.meet(seed, node, sides, len(seed))]
    for direct in (7, 100):
        a, b = P.meet(seed, node, sides, direct)
        assert [a.tolist(), b.tolist()] == whole
        assert twins <= set(zip(a.tolist(), b.tolist(), strict=True))


def test_squares_of_leaders_give_what_one_task_gives(spark):
    seed, sides, _ = crowded(np.random.default_rng(32), 150)
    sides[20:30] = sides[19]                 # a family
    sides[100:110, :6] = sides[99, :6]       # alike on one side only
    node = np.arange(len(seed)) // 2         # two places a text
    near = np.arange(len(seed)) << 32 | np.ascontiguousarray(sides[:, 8:]).view(np.uint32)[:, 0].astype(np.int64)
    far = np.ascontiguousarray(sides[:, :8]).view(np.int64)[:, 0]
    places = spark.createDataFrame(list(zip(seed.tolist(), node.tolist(), near.tolist(), far.tolist(), strict=True)),
                                   "seed long, u long, near long, far long")
    a, b = P.meet(seed, node, sides, len(seed))
    want = sorted((node[i], node[j], i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True))
    assert len(want) > 250
    for direct, side in ((1000, 10), (20, 16), (20, 1000), (50, 150)):
        got = P.all_matches(places, Scratch(spark, "squares"), direct, side).collect()
        assert sorted(tuple(r) for r in got) == want


def test_a_family_is_a_star():
    """Places that agree beside the seed all meet its first one."""
    sides = np.full((50, 2 * P.SIDE), 7, np.uint8)
    a, b = P.meet(np.zeros(50, np.int64), np.arange(50), sides)
    assert a.tolist() == list(range(1, 50)) and set(b.tolist()) == {0}


def test_copies_are_rows_of_their_own(spark):
    rng = random.Random(25)
    text, shared = prose(rng, 70), prose(rng, 60)
    rows = [(i, text if i % 3 else f"{prose(rng, 20)} {shared} {prose(rng, 20)}", "aa", "s") for i in range(12)]
    rows += [(50, " " + text + "\n", "aa", "s"), (51, text.upper(), "aa", "s"), (60, "too short", "aa", "s"), (61, "too short", "aa", "s")]
    got = P.repeated_passages(documents(spark, rows)).collect()
    held = {i for r in got for i in (r["doc_id"], r["hub_doc_id"])}
    assert held == {i for i, *_ in rows} - {60, 61}
    whole = [r for r in got if r["passage"] == text and r["similarity"] == 1.0 and r["doc_id"] not in (50, 51)]
    assert len(whole) >= 7 and {r["end_word"] for r in whole} == {70}


def test_recall_of_edited_passages(spark):
    """Pairs alike to 0.8 to 0.95 by single words: the share that is met, of those that the alignment on the whole texts accepts."""
    rng = random.Random(23)
    rows, pairs = [], []
    for n in range(600):
        size, share = rng.randint(50, 100), rng.uniform(0.05, 0.2)
        words = prose(rng, size).split()
        other = list(words)
        for at in rng.sample(range(size), int(share * size)):
            other[at] = f"new{rng.randrange(10 ** 9)}"
        a, b = (f"{prose(rng, 40)} {' '.join(w)} {prose(rng, 40)}" for w in (words, other))
        rows += [(2 * n, a, "aa", "s"), (2 * n + 1, b, "aa", "s")]
        x, y = (word_hashes(pa.array([t]))[0] for t in (a, b))
        places = [[(i + 40, i + 40)] for i in range(size - 1) if words[i:i + 2] == other[i:i + 2]]   # every seed of two words
        if P.passages_of(x, y, places, P.MIN_WORDS, P.SIMILARITY):
            pairs.append((2 * n, 2 * n + 1))
    got = {tuple(sorted((r["doc_id"], r["hub_doc_id"]))) for r in P.repeated_passages(documents(spark, rows)).collect()}
    met = sum(p in got for p in pairs) / len(pairs)
    print(f"recall {met:.4f} of {len(pairs)}")
    assert len(pairs) > 400 and met >= 0.98
