"""From transactions to feature rows: baselines, velocity, last place, devices, score."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.risk import scored, with_travel
from tallyward.operators.location import with_guarded, with_lag
from tallyward.operators.velocity import trailing


def new_device(tx: DataFrame, trusted: DataFrame) -> DataFrame:
    """tx with is_new_device: not among the user's trusted devices; a missing or empty device is not new."""
    known = trusted.select("user_id", "device_id", F.lit(True).alias("_known")).distinct()
    device = F.col("device_id").cast("string")
    is_new: Column = F.col("_known").isNull() & device.isNotNull() & (device != "")
    return tx.join(known, ["user_id", "device_id"], "left").withColumn("is_new_device", is_new).drop("_known")


def features(tx: DataFrame, base: DataFrame, trusted: DataFrame, guarded: bool = True) -> DataFrame:
    """One feature row per transaction.

    Baselines and devices are joined by user; Spark broadcasts them when they are small and shuffles them when not.
    The trailing count and the last place share one partitioning by user.
    """
    placed = (with_guarded if guarded else with_lag)(tx)
    full = new_device(trailing(placed, "15min").join(base, "user_id", "left"), trusted)
    return scored(with_travel(full))
