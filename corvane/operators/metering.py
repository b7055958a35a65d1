"""Usage by key and month, and quota decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import PAID_TIERS, QUOTAS


def period(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM")


def period_end(ts: Column) -> Column:
    """Start of the next month, as seconds since the epoch."""
    return F.unix_timestamp(F.add_months(F.trunc(ts.cast("timestamp"), "month"), 1).cast("timestamp"))


def usage(requests: DataFrame, key: str = "key_hash", ts: str = "ts") -> DataFrame:
    return requests.groupBy(F.col(key).alias("key_hash"), period(F.col(ts)).alias("period")).agg(F.count(F.lit(1)).alias("used"))


def monthly_quota(tier: Column, override: Column) -> Column:
    out = F.lit(None).cast("long")
    for k, v in QUOTAS.items():
        out = F.when(tier == k, F.lit(v)).otherwise(out)
    return F.coalesce(override, out)


def quota_decision(used: DataFrame, keys: DataFrame) -> DataFrame:
    """limit, allowed (the next request), used after it, and remaining for each key and period."""
    rows = used.join(keys.select("key_hash", "tier", "quota_override"), "key_hash")
    limit = monthly_quota(F.col("tier"), F.col("quota_override"))
    rows = rows.withColumn("limit", limit).withColumn("allowed", F.col("used") < F.col("limit"))
    rows = rows.withColumn("used_after", F.col("used") + F.col("allowed").cast("int"))
    return rows.withColumn("remaining", F.greatest(F.lit(0), F.col("limit") - F.col("used_after"))).withColumn("alerts_allowed", F.col("tier").isin(*PAID_TIERS)).drop("quota_override")


def find_key(keys: DataFrame, token: str) -> DataFrame:
    """The key of a token; only its SHA-256 is stored."""
    return keys.where(F.col("key_hash") == F.sha2(F.lit(token).cast("binary"), 256))
