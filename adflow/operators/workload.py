"""Workload generation: a per-second rate curve expanded into random ad events.

Row ``i`` of the curve is second ``i`` of the run; that second gets
``value`` events (none when it is 0 or negative; at most ``largest`` if the caller
gives one), each
with a uniformly chosen ad and event type and ``ts = start + i`` seconds.  The
choices are a deterministic hash of ``(i, k)`` computed on the executors, so a
rerun (or a retried task) produces the same events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adflow.operators.series import grid_from_bounds

# Event types of the generator and the hash constants
# (Lehmer / MINSTD multipliers modulo the Mersenne prime 2^31 - 1).
EVENT_TYPES = ("view", "click", "purchase")
HASH_MODULUS = 2_147_483_647
HASH_A = 48_271
HASH_B = 69_621
AD_SALT = 12_345
TYPE_SALT = 54_321


def _mix(i: Column, k: Column, a: int, b: int, salt: int) -> Column:
    m = F.lit(HASH_MODULUS)
    return F.pmod(F.pmod(i, m) * F.lit(a) + k * F.lit(b) + F.lit(salt), m)


def ad_choice(i: Column, k: Column, n_ads: int) -> Column:
    return F.pmod(_mix(i, k, HASH_A, HASH_B, AD_SALT), F.lit(n_ads))


def type_choice(i: Column, k: Column) -> Column:
    idx = F.pmod(_mix(i, k, HASH_B, HASH_A, TYPE_SALT), F.lit(len(EVENT_TYPES)))
    return F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), (idx + 1).cast("int"))


def events_per_interval(events: DataFrame, ts: str, interval_s: int) -> DataFrame:
    """A rate curve ``(i, ts, value)`` from event times: events per interval,
    zero-filled between the first and the last interval."""
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(interval_s)).cast("long")
    counts = events.groupBy(bucket.alias("__h")).agg(F.count(F.lit(1)).cast("int").alias("value"))
    # offsets 0..(last - first) carried with the first interval: no join with a bounds row
    bounds = counts.agg(F.min("__h").alias("__base"), F.max("__h").alias("__last")).select(
        "__base", F.lit(0).cast("long").alias("start"), (F.col("__last") - F.col("__base")).alias("end"))
    offsets = grid_from_bounds(bounds, by=["__base"], step=1)
    g = offsets.select(F.col("ts").alias("i"), (F.col("__base") + F.col("ts")).alias("__h"))
    return g.join(counts, on="__h", how="left").select(
        "i", (F.col("__h") * F.lit(interval_s)).alias("ts"),
        F.coalesce(F.col("value"), F.lit(0)).alias("value"))


def expand_workload(curve: DataFrame, ads: DataFrame, largest: int | None = None,
                    start_ms: int = 0, n_ads: int | None = None) -> DataFrame:
    """Curve ``(i, value)`` + ads ``(ad_num 0..n-1, ad_id)`` -> events
    ``(second, k, ts, ad_id, et)``.  An ad number without an ad is an error."""
    if n_ads is None:
        n_ads = ads.count()
    if n_ads <= 0:
        raise ValueError("no ads to choose from")
    n = F.col("value") if largest is None else F.least(F.col("value"), F.lit(largest))
    per_second = curve.where(n > 0).select(
        F.col("i").cast("long").alias("second"),
        F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("k"))
    chosen = per_second.select(
        "second", "k",
        (F.lit(start_ms) + F.col("second") * 1000).alias("ts"),
        ad_choice(F.col("second"), F.col("k"), n_ads).alias("ad_num"),
        type_choice(F.col("second"), F.col("k")).alias("et"),
    )
    dim = ads.select(F.col("ad_num").cast("long"), "ad_id")
    ad = F.when(F.col("ad_id").isNull(), F.raise_error(F.format_string("no ad numbered %d", F.col("ad_num")))
                .cast("string")).otherwise(F.col("ad_id"))
    return chosen.join(dim, on="ad_num", how="left").select("second", "k", "ts", ad.alias("ad_id"), "et")


def events_per_second(generated: DataFrame) -> DataFrame:
    return generated.groupBy("second").agg(F.count(F.lit(1)).alias("events"))
