"""URL filters as a sort-merge range join.

A host becomes the key of its labels in reverse, ``example.net`` ->
``net.example/``.  All subdomains of a rule's host then lie in one interval,
``net.example.`` to ``net.example/`` (nothing else sorts between them, as ``/``
follows ``.``), and intervals of different hosts nest or do not meet.  Urls and
rules are dealt out by ranges of the key and sorted; one sweep per range keeps
a stack of the rules whose interval is open, innermost last, and matches each
url's path against those rules only.

Range limits come from a bounded sample of (key, hash of the row's number), so a
host or url that fills a third of the table is cut over several ranges; a rule is
copied to each range that its interval meets: at most one copy per range and
level of nesting beyond the rules themselves.  The limits decide where a row is
handled, never what it gets.

Defined results: a null url, or one without ``://``, has an empty host and path
and fits no rule; hosts are lower-cased in A-Z only; the longest fitting rule
(host plus path) wins, then the one with the longer host, then ``block``; where
none fits, the verdict is ``default``; repeated rows each get their row; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adflow.llm.base import UPPER, arrow_map, ascii_lower, partitions

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SAMPLED_PER_RANGE = 64   # rows sampled for the limits, for each range


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def reversed_host(host: Column) -> Column:
    return F.concat_ws(".", F.reverse(F.split(host, "\\.")))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    for host, path, verdict in rules:
        if not host or "/" in host or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {(host, path, verdict)}")
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[str, str, dict[str, str], list[int]]] = []  # end of the interval, host, verdict by path, path lengths
    now = None
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("span", "key", "end", "page_id", "host", "path", "rules")]
        for span, key, end, page_id, host, path, rules in zip(*columns, strict=True):
            if span != now:
                stack, now = [], span
            while stack and stack[-1][0] < key:
                stack.pop()
            if end is not None:
                stack.append((end, host, {r["path"]: r["verdict"] for r in rules}, sorted({len(r["path"]) for r in rules})))
                continue
            best: tuple = (-1, -1, None, None)
            for _, of, by_path, lengths in stack:
                for n in lengths:
                    verdict = by_path.get(path[:n]) if n <= len(path) else None
                    if verdict and (len(of) + n, len(of)) > best[:2]:
                        best = (len(of) + n, len(of), of + path[:n], verdict)
            out.append((page_id, host, path, best[2], best[3]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5,
                                            [pa.int64(), *[pa.string()] * 4], strict=True)],
            ["page_id", "host", "path", "rule", "verdict"])


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages(page_id, url)`` under ``rules(host, path, verdict)``."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"),
                        F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    urls = urls.withColumn("key", F.concat(reversed_host(F.col("host")), F.lit("/")))
    n = partitions(spark)
    rows = pages.count()   # from the footers of the files
    sample = sorted((r["key"], r["salt"]) for r in urls.select("key", "salt")
                    .sample(min(1.0, SAMPLED_PER_RANGE * n / max(rows, 1)), seed=7).collect())
    limits = [sample[i * len(sample) // n] for i in range(1, n)] if sample else []

    @F.pandas_udf("int")
    def span(keys: pd.Series, salts: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(limits, kv) for kv in zip(keys, salts, strict=True)], dtype="int32")

    low, high = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1).cast("long")
    # one row per rule host: all its paths open and close together
    by_host = (rules.groupBy(ascii_lower(F.col("host")).alias("host"), "path")
               .agg(F.max("verdict").alias("verdict")).groupBy("host")
               .agg(F.collect_list(F.struct("path", "verdict")).alias("rules"))
               .withColumn("key", F.concat(reversed_host(F.col("host")), F.lit(".")))
               .withColumn("end", F.concat(reversed_host(F.col("host")), F.lit("/"))))
    opened = (by_host.withColumn("span", F.explode(F.sequence(span("key", low), span("end", high))))
              .select("span", "key", "end", F.lit(None).cast("long").alias("page_id"), "host",
                      F.lit(None).cast("string").alias("path"), "rules"))
    dealt = urls.select(span("key", "salt").alias("span"), "key", F.lit(None).cast("string").alias("end"),
                        "page_id", "host", "path", F.lit(None).cast(opened.schema["rules"].dataType).alias("rules"))
    swept = arrow_map(dealt.unionByName(opened).repartition(n, "span")
                      .sortWithinPartitions("span", "key", F.col("end").isNull()),
                      _sweep, "page_id long, host string, path string, rule string, verdict string")
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _sql() -> str:
    lower = UPPER.lower()
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    order = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    rule = " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{h}{p}'" for h, p, _ in order)
    verdict = " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{v}'" for h, p, v in order)
    return f"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM p
"""


ORACLE = _sql()
