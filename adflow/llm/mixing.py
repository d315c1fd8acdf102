"""Mixing sources to target weights by Poisson replication.

Every document is repeated ``n ~ Poisson(rate of its source)`` times, where the
rate is what the source's target share of the output needs:
``rate = share * epochs * all characters / characters of the source``.  ``n`` is
the inverse of the Poisson distribution at a uniform number hashed from the
seed and the document, so a rerun (or a lost task) draws the same copies.  A
rate above ``PART`` is split into equal parts with a draw each; sums of Poisson
draws are Poisson, and no table of the distribution grows long.  A row's work is
one digest a part, and one row a copy; arrays hold ``RUN`` of either.

One aggregation gives the sources' sizes; one equi-join brings each row its
source's distribution (a hot source is a skewed probe side, which adaptive
execution splits); one exchange by a hashed key deals the copies out over all
partitions, and a sort by that key orders them: a global shuffle without a
sampling pass.

Defined results: a null source is a source of its own; null and empty texts
weigh nothing but are drawn like the rest of their source; a source without any
character has rate 1; a source that ``shares`` does not name has share 0; rows
with a null id draw by their text; repeated rows draw alike; an empty table
gives an empty table; an input column named ``copy`` or ``shuffle_key`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adflow.llm.base import Scratch, with_outputs

PART = 16.0   # largest mean of one draw
RUN = 4096    # parts, and copies, that one array holds
SEED = 20240601


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of ``parts`` joined by colons."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text",
                 shares: dict[str, float] | None = None, epochs: float = 1.0,
                 scratch: Scratch | None = None) -> DataFrame:
    """``source, chars, rate``: mean repetitions per source.  Without ``shares``, all sources get the same share."""
    spark = docs.sparkSession
    sizes = (docs.groupBy(F.col(source_col).alias("source"))
             .agg(F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("chars")))
    sizes = (scratch or Scratch(spark, "mixing")).write(sizes, "sizes")
    total, n = sizes.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.count(F.lit(1))).first()
    if shares is None:
        share = F.lit(1.0 / max(n, 1))
    else:
        given = spark.createDataFrame(list(shares.items()), "name string, share double")
        sizes = sizes.join(given, F.col("source") == F.col("name"), "left")
        share = F.coalesce("share", F.lit(0.0))
    rate = F.when(F.col("chars") > 0, share * F.lit(float(total) * epochs) / F.col("chars")).otherwise(F.lit(1.0))
    return sizes.select("source", "chars", rate.alias("rate"))


def poisson_table(rate: Column) -> Column:
    """Cumulative Poisson probabilities 0, 1, 2, ... far enough that what is left is below 1e-17."""
    last = F.ceil(rate + 14 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    step = lambda a, k: F.struct(
        (a["p"] * rate / k).alias("p"),
        F.array_append(a["cdf"], F.element_at(a["cdf"], -1) + a["p"] * rate / k).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["cdf"])


def mix_sources(docs: DataFrame, shares: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` plus ``copy`` (from 1) and ``shuffle_key``, in the order of the key per partition."""
    rates = source_rates(docs, source_col, text_col, shares, epochs)
    rates = (rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("long"))
             .withColumn("cdf", poisson_table(F.col("rate") / F.col("parts")))
             .select(F.col("source").alias("of"), "parts", "cdf"))
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.col(text_col)), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("src"), name.alias("name"))
    rows = rows.join(rates, F.col("src").eqNullSafe(F.col("of")))
    zero = F.lit(0).cast("long")
    # one digest a part: it is the element that the sum goes over, so no reader of it repeats it
    among = lambda first, last: F.aggregate(
        F.transform(F.sequence(first, last), lambda j: uniform(F.lit(seed), j, F.col("name"))), zero,
        lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)))
    drawn = F.aggregate(F.sequence(zero, F.expr(f"(parts - 1) div {RUN}")), zero,
                        lambda n, k: n + among(k * RUN + 1, F.least((k + 1) * RUN, F.col("parts"))))
    # a generator keeps the count out of filters and join conditions
    rows = rows.select("row", "name", F.explode(F.array(drawn)).alias("n"))
    rows = rows.select("row", "name", "n", F.explode(F.sequence(zero, F.expr(f"(n - 1) div {RUN}"))).alias("run"))
    copies = F.array_repeat(F.lit(True), F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN).cast("int"))
    rows = rows.select("row", "name", "run", F.posexplode(copies).alias("at", "one"))
    rows = rows.select("row", "name", (F.col("run") * RUN + F.col("at") + 1).cast("int").alias("nth"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.lit("order"), F.col("nth").cast("string"),
                            F.col("name")).cast("binary"))
    rows = rows.select("row", "nth", key.alias("key")).repartition("key").sortWithinPartitions("key")
    return with_outputs(rows, "row", {"copy": F.col("nth"), "shuffle_key": F.col("key")})


ORACLE = f"""
WITH sizes AS (
  SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN chars > 0 THEN (1.0 / (SELECT count(*) FROM sizes))::DOUBLE
         * (SELECT sum(chars) FROM sizes) / chars ELSE 1.0 END AS rate FROM sizes),
parts AS (SELECT source, rate, greatest(1, ceil(rate / {PART}))::INT AS parts FROM rates),
probs AS (
  SELECT source, parts, k, exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1) AS p
  FROM parts, (SELECT unnest(range(0, 120)) AS k)),
cdf AS (
  SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM probs),
draws AS (
  SELECT d.*, j, ('0x' || substr(md5('{SEED}:' || j || ':' || coalesce(d.doc_id::VARCHAR, 'text:' || d.text, '')), 1, 13))::BIGINT
         / {float(1 << 52)} AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, p.parts + 1)) AS js(j)),
counts AS (
  SELECT doc_id, text, lang, source, n_chars, j, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM draws.source AND c <= u) AS n
  FROM draws),
totals AS (
  SELECT doc_id, text, lang, source, n_chars, sum(n)::INT AS n FROM counts GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, nth::INT AS copy,
       md5('{SEED}:order:' || nth || ':' || coalesce(doc_id::VARCHAR, 'text:' || text, '')) AS shuffle_key
FROM totals, unnest(range(1, n + 1)) AS c(nth)
"""
