"""Campaign table builder: ads numbered 0..n-1, ``ads_per`` consecutive ads per campaign.

Ids are 16 lowercase-hex characters of ``sha2(seed:kind:number, 256)``: stable
across runs (the reference draws them at random) and computed on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adflow.operators.enrich import assert_unique

DEFAULT_SEED = "adflow"
N_CAMPAIGNS = 100
ADS_PER_CAMPAIGN = 10


def make_id(kind: str, number: Column, seed: str = DEFAULT_SEED) -> Column:
    key = F.concat(F.lit(f"{seed}:{kind}:"), number.cast("string"))
    return F.substring(F.sha2(key, 256), 1, 16)


def campaigns_for(ads: DataFrame, number_col: str = "ad_num",
                  ads_per: int = ADS_PER_CAMPAIGN, seed: str = DEFAULT_SEED) -> DataFrame:
    """Map ad numbers to ``(ad_num, ad_id, campaign_num, campaign_id)``."""
    n = F.col(number_col).cast("long")
    campaign_num = F.floor(n / F.lit(ads_per)).cast("long")
    return ads.select(
        n.alias("ad_num"),
        make_id("ad", n, seed).alias("ad_id"),
        campaign_num.alias("campaign_num"),
        make_id("campaign", campaign_num, seed).alias("campaign_id"),
    )


def build_campaigns(spark: SparkSession, n_campaigns: int = N_CAMPAIGNS,
                    ads_per: int = ADS_PER_CAMPAIGN, seed: str = DEFAULT_SEED) -> DataFrame:
    ads = spark.range(n_campaigns * ads_per).select(F.col("id").alias("ad_num"))
    return campaigns_for(ads, "ad_num", ads_per, seed)


def campaign_set(dim: DataFrame) -> DataFrame:
    return dim.select("campaign_id").distinct()


def load_campaigns(spark: SparkSession, path: str) -> DataFrame:
    """The stored table ``(ad_id, campaign_id)``; an ad that is in it twice is an error."""
    dim = spark.read.schema("ad_id string, campaign_id string").parquet(path)
    assert_unique(dim)
    return dim


def save_campaigns(dim: DataFrame, path: str) -> None:
    """Replace the stored table (the store is emptied first, as in the reference)."""
    dim.select("ad_id", "campaign_id").write.mode("overwrite").parquet(path)


def add_campaigns(dim: DataFrame, path: str, version: int) -> None:
    """Add ads (or new campaigns of known ads) as ``version``; a version is written once."""
    assert_unique(dim)
    dim.select("ad_id", "campaign_id").write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={int(version)}")


def current_campaigns(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The table as it is now (or was at version ``upto``): of an ad in several versions, the latest counts."""
    rows = spark.read.schema("ad_id string, campaign_id string, version long").parquet(path)
    if upto is not None:
        rows = rows.where(F.col("version") <= upto)
    return rows.groupBy("ad_id").agg(F.max_by("campaign_id", "version").alias("campaign_id"))
