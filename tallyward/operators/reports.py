"""Report and queue queries over decisions, features and profiles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.functions.governance import autonomy_tier


def fraud_performance(decisions: DataFrame, snapshots: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row for a half-open window of decision times; of equally frequent patterns the first by name is the top."""
    joined = decisions.where((F.col("decided_at") >= start) & (F.col("decided_at") < end)).select("snapshot_id", "decision", "identified_pattern").join(snapshots.select("snapshot_id", "is_synthetic_fraud"), "snapshot_id", "left")
    is_ = lambda d: F.count_if(F.col("decision") == d)
    n = F.count(F.lit(1))
    return joined.agg(n.alias("transactions_reviewed"), is_("BLOCK").alias("block_count"), is_("ESCALATE").alias("escalate_count"), is_("ALLOW").alias("allow_count"), F.round(F.count_if("is_synthetic_fraud") / F.nullif(n, F.lit(0)), 4).alias("fraud_rate"), F.mode("identified_pattern", True).alias("top_fraud_pattern"))


def recent_decisions(decisions: DataFrame, now: Column, hours: int) -> DataFrame:
    """Decisions per user and kind in the last 1 to 720 hours before now."""
    if not 1 <= hours <= 720:
        raise ValueError("hours must be from 1 to 720")
    return decisions.where((F.col("decided_at") >= now - F.make_dt_interval(hours=F.lit(hours))) & (F.col("decided_at") <= now)).groupBy("user_id", "decision").agg(F.count(F.lit(1)).alias("n"))


def profiles(base: DataFrame, trusted: DataFrame) -> DataFrame:
    """Baselines with the number of trusted devices."""
    n = trusted.groupBy("user_id").agg(F.count_distinct("device_id").alias("trusted_device_count"))
    return base.join(n, "user_id", "left").withColumn("trusted_device_count", F.coalesce("trusted_device_count", F.lit(0).cast("bigint")))


def review_queue(decisions: DataFrame, n: int) -> DataFrame:
    """The oldest unreviewed suggestions."""
    tier = autonomy_tier(F.col("decision"), F.col("confidence_score"), F.col("amount"))
    return decisions.withColumn("tier", tier).where("tier = 'SUGGEST' and not human_reviewed").orderBy("decided_at", "decision_id").limit(n)


def any_one(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One row, by the smallest hash of seed and key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key).cast("binary")), key).limit(1)


def stratified(rows: DataFrame, per_stratum: int, seed: int = 0) -> DataFrame:
    """As many fraud as legitimate rows, by smallest hash of id and seed: the same sample each time.

    Each stratum is cut by a top-n, which tasks start on their own rows; no stratum is sorted as a whole.
    """
    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), "transaction_id").cast("binary")), F.col("transaction_id")]
    fraud = F.coalesce("is_synthetic_fraud", F.lit(False))
    return rows.where(fraud).orderBy(*order).limit(per_stratum).unionByName(rows.where(~fraud).orderBy(*order).limit(per_stratum))


def daily(decisions: DataFrame) -> DataFrame:
    """Per day and decision: count, mean confidence, judge score and latency."""
    return decisions.groupBy(F.date_trunc("day", "decided_at").alias("day"), "decision").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence_score").alias("mean_confidence"), F.avg("judge_score").alias("mean_judge"), F.avg("latency_ms").alias("mean_latency_ms"))


def ranked_within(df: DataFrame, key: str, value: str, tie: str, n: int) -> DataFrame:
    """The n highest rows of each key, with their rank."""
    w = Window.partitionBy(key).orderBy(F.col(value).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
