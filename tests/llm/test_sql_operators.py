"""Exact dedup, mixing, chat formatting and url filters: awkward rows, and DuckDB on the test tables."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from adflow.llm import chat, exact_dedup, mixing, url_filter
from adflow.llm.base import UPPER
from adflow.llm.queries import ORACLE, QUERIES

from .tables import awkward, documents, prose

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    cols = sorted(d[0] for d in cur.description)
    assert sorted(df.columns) == cols
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = Counter(tuple(r[i] for i in at) for r in cur.fetchall())
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == want


# -- exact dedup -------------------------------------------------------------------------------

def norm(text):
    return (text or "").translate(str.maketrans(UPPER, UPPER.lower()))


@pytest.mark.parametrize("first,growth", [(256, 4), (3, 2)])
def test_exact_classes(spark, first, growth):
    rng = random.Random(12)
    rows = awkward(rng)
    long = prose(rng, 3000)
    rows += [(500 + i, long + tail, "aa", "s") for i, tail in enumerate(["", "a", "b", "a", "", "ab"])]
    rows += [(600 + i, "ÉA"[: i % 3], "aa", "s") for i in range(9)]
    got = exact_dedup.radix_classes(documents(spark, rows, clash=["rest", "gid", "uid"]), first_digit=first, growth=growth).collect()
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(norm(text), []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter(
        (i, keep[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_dedup_keeps_whole_rows(spark):
    rows = awkward(random.Random(13))
    docs = documents(spark, rows, clash=["row", "rid", "nth"])
    got = exact_dedup.exact_dedup(docs)
    assert got.columns == docs.columns
    assert Counter(norm(r["text"]) for r in got.collect()) == Counter({norm(t): 1 for _, t, *_ in rows})
    assert exact_dedup.exact_dedup_report(documents(spark, [])).count() == 0


# -- mixing ------------------------------------------------------------------------------------

def test_mix_meets_the_shares(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randint(5, 60)), "aa", "big" if i % 10 else "small") for i in range(4000)]
    docs = documents(spark, rows)
    chars = {r["source"]: r["c"] for r in mixing.mix_sources(docs, {"big": 0.25, "small": 0.75}).groupBy("source").agg({"n_chars": "sum"})
             .withColumnRenamed("sum(n_chars)", "c").collect()}
    total = sum(len(t) for _, t, *_ in rows)
    assert chars["big"] / total == pytest.approx(0.25, rel=0.1)
    assert chars["small"] / total == pytest.approx(0.75, rel=0.1)


def test_copies_are_poisson(spark):
    docs = documents(spark, [(i, "abcd", "aa", "s") for i in range(4000)])
    copies = Counter(r["doc_id"] for r in mixing.mix_sources(docs, epochs=40.0).collect())   # a rate above one part
    counts = [copies.get(i, 0) for i in range(4000)]
    mean = sum(counts) / 4000
    assert mean == pytest.approx(40, abs=0.5)
    assert sum((c - mean) ** 2 for c in counts) / 4000 == pytest.approx(40, rel=0.1)


def test_mix_bears_awkward_rows(spark):
    rows = awkward(random.Random(15))
    docs = documents(spark, rows, clash=["copy", "cdf", "name", "src", "of"])
    got = mixing.mix_sources(docs)
    assert set(got.columns) == {*docs.columns, "shuffle_key"}
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert Counter(map(str, got.collect())) == Counter(map(str, again))   # the draw depends on the row alone
    assert {(r["doc_id"], r["text"]) for r in again} <= {(i, t) for i, t, *_ in rows}
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    assert mixing.mix_sources(docs, {}).where("n_chars > 0").count() == 0


def test_a_source_of_one_character_is_drawn_a_million_times(spark):
    """Rates far above a part: as many copies as the rate, numbered from 1, of the same documents on a rerun."""
    rows = [(1, "x", "aa", "tiny")] + [(10 + i, "y" * 100_000, "aa", "big") for i in range(20)]
    mixed = mixing.mix_sources(documents(spark, rows)).select("doc_id", "copy")
    tiny = mixed.where("doc_id = 1")
    n, low, high, distinct = tiny.selectExpr("count(*)", "min(copy)", "max(copy)", "count(DISTINCT copy)").first()
    assert abs(n - 1_000_000) < 6_000 and (low, high, distinct) == (1, n, n)
    plan = mixing.mix_sources(documents(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 2   # a draw, and the key of a copy


# -- chats -------------------------------------------------------------------------------------

def talk(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, pos string")


def test_snapshots_collapse(spark):
    def said(conv, *texts):
        return [(conv, n, "user" if n % 2 == 0 else "assistant", t) for n, t in enumerate(texts)]

    rows = [*said(1, "a"), *said(2, "a", "b"), *said(3, "a", "b", "c"), *said(4, "a", "x"), *said(5, "a", "b", "c"), *said(6, "c"),
            *said(7, None, None), (8, None, None, None), (None, 0, "user", "lost"), *said(3, "a", "b", "c")]
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.format_chats(talk(spark, rows)).collect()}
    assert set(got) == {3, 4, 6, 7, 8}
    assert got[4] == (2, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n")
    assert got[7][0] == 2 and got[8] == (1, "<|im_start|>\n<|im_end|>\n")
    assert chat.format_chats(talk(spark, [])).count() == 0


def test_turns_are_ordered_and_ties_are_settled(spark):
    rows = [(1, 5, "b", "2"), (1, 5, "a", "9"), (1, None, "z", "0"), (2, 1, "z", "0"), (2, 2, "a", "9")]
    got = {r["conv_id"]: r["n_turns"] for r in chat.format_chats(talk(spark, rows)).collect()}
    assert got == {1: 3}   # 2 is its prefix: z 0, a 9


# -- urls --------------------------------------------------------------------------------------

def brute_url(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = norm(rest[:end]), rest[end:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("rules", [url_filter.RULES, [("a", "", "block"), ("b.a", "/x", "allow"), ("b.a", "/x/y", "block"), ("c.b.a", "", "allow"),
                                                      ("b.a", "", "allow"), ("a", "/x/y/z", "block"), ("b.a", "/x", "block")]])
def test_urls_equal_brute_force(spark, rules):
    rng = random.Random(16)
    hosts = ["net", "example.net", "x.example.net", "example.com", "org", "A.ORG", "a", "b.a", "c.b.a", "bb.a", "b-.a", "", "d.c.b.a", "netx", "a:80"]
    paths = ["", "/", "/en/", "/en/1", "/de/x", "/fr/", "/x", "/x/y", "/x/y/z/w", "?q=/en/", "#/", "/x?a=://b.a/x"]
    rows = [(None, None), (1, ""), (2, "no scheme"), (3, "://"), (4, "a://b.a/x://c"), (None, "http://net/"), (2**60 + 1, "http://net/")]
    rows += [(10 + i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(400)]
    rows += [(7, "http://example.net/en/")] * 50   # a hot url
    pages = spark.createDataFrame([(*r, "h", "x") for r in rows], "page_id long, url string, html string, span string")
    got = url_filter.filter_urls(pages, url_filter.rules_table(spark, rules)).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_url(u, rules)) for i, u in rows)


def test_no_urls_and_bad_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(pages, url_filter.rules_table(spark, url_filter.RULES)).count() == 0
    with pytest.raises(ValueError, match="not a rule"):
        url_filter.rules_table(spark, [("", "/", "block")])
