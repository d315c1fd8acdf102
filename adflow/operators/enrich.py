"""Campaign enrichment: ad id -> campaign id, missing -> 'UNKNOWN', one row out per row in.

One plan for every size and for streams: a left equi-join without hints.  Spark
broadcasts the campaign table when its size is under the session's threshold
(by file statistics, or at run time) and splits a hot ad of the probe side
otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"


def assert_unique(dim: DataFrame, key: str = "ad_id") -> None:
    dup = dim.groupBy(key).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"campaign table is not unique on {key}: {dup[0][key]!r}")


def enrich(df: DataFrame, campaigns: DataFrame, unknown: str = UNKNOWN) -> DataFrame:
    """Left-join ``campaign_id`` onto ``df`` by ``ad_id``; output ``campaign_id`` first.

    The dimension must be unique on ``ad_id``: :func:`adflow.sources.campaigns.load_campaigns`
    checks that where it is loaded.
    """
    joined = df.join(campaigns.select("ad_id", "campaign_id"), on="ad_id", how="left")
    rest = [c for c in df.columns if c != "ad_id"]
    return joined.select(
        F.coalesce(F.col("campaign_id"), F.lit(unknown)).alias("campaign_id"),
        "ad_id",
        *rest,
    )
