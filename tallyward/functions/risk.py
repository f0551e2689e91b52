"""The two-tier risk score: a weighted sum of four signals, and hard rules that flag on their own."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import haversine_km, implied_kmh, impossible_travel, minutes_between, nonzero

#: Fixed values of the scoring rules.
WEIGHTS = {"velocity": 0.30, "amount": 0.25, "geo": 0.25, "device": 0.20}
FLAG_ABOVE, AMOUNT_HARD, VELOCITY_HARD = 0.60, 0.95, 1.0
VELOCITY_MAX, GEO_MAX_KM, ZSCORE_MAX = 5.0, 500.0, 3.0
DEFAULT_AVG, DEFAULT_STDDEV = 50.0, 20.0


def zscore(amount: Column, avg: Column, stddev: Column) -> Column:
    """Missing baselines count as the defaults; a standard deviation that isn't positive gives 0."""
    sd = F.coalesce(stddev, F.lit(DEFAULT_STDDEV))
    return F.when(sd > 0, (F.coalesce(amount, F.lit(0.0)) - F.coalesce(avg, F.lit(DEFAULT_AVG))) / sd).otherwise(F.lit(0.0))


def signals(velocity: Column, z: Column, km: Column, new_device: Column) -> dict[str, Column]:
    """The four signals in [0, 1]. NaN sorts above all numbers and would saturate: rows are validated beforehand."""
    return {
        "velocity": F.least(velocity / VELOCITY_MAX, F.lit(1.0)),
        "amount": F.least(F.abs(z) / ZSCORE_MAX, F.lit(1.0)),
        "geo": F.least(F.coalesce(km, F.lit(0.0)) / GEO_MAX_KM, F.lit(1.0)),
        "device": F.when(new_device, 1.0).otherwise(0.0),
    }


def score(s: dict[str, Column]) -> Column:
    parts = [s[k] * w for k, w in WEIGHTS.items()]
    return F.round(F.least(sum(parts[1:], parts[0]), F.lit(1.0)), 4)


def flag(risk: Column, geo_hard: Column, s: dict[str, Column]) -> Column:
    return (risk > FLAG_ABOVE) | geo_hard | (s["amount"] >= AMOUNT_HARD) | (s["velocity"] >= VELOCITY_HARD)


def with_travel(df: DataFrame) -> DataFrame:
    """Adds geo_km, minutes and suspect_location from the row's place and prev_lat, prev_lon, prev_ts.

    A coordinate of 0 is missing. A previous time at or after the row's own voids both distance and time: the row came
    late. A missing previous time keeps the distance.
    """
    km = haversine_km(F.col("prev_lat"), F.col("prev_lon"), nonzero(F.col("latitude")), nonzero(F.col("longitude")))
    df = df.withColumn("minutes", F.when(km.isNotNull(), minutes_between(F.col("prev_ts"), F.col("transaction_ts")))).withColumn("geo_km", km)
    late = F.coalesce(F.col("minutes") <= 0, F.lit(False))
    df = df.withColumn("geo_km", F.when(~late, F.col("geo_km"))).withColumn("minutes", F.when(~late, F.col("minutes")))
    return df.withColumn("suspect_location", impossible_travel(F.col("geo_km"), implied_kmh(F.col("geo_km"), F.col("minutes"))))


def scored(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature rows: df needs amount, avg_amount, stddev_amount, velocity_15min, is_new_device and with_travel's columns; those of keep come along."""
    df = df.withColumn("z", zscore(F.col("amount"), F.col("avg_amount"), F.col("stddev_amount")))
    s = signals(F.col("velocity_15min"), F.col("z"), F.col("geo_km"), F.col("is_new_device"))
    df = df.withColumns({f"signal_{k}": v for k, v in s.items()})
    s = {k: F.col(f"signal_{k}") for k in s}
    df = df.withColumn("risk_score_raw", score(s))
    placed = F.col("prev_lat").isNotNull() & nonzero(F.col("latitude")).isNotNull() & nonzero(F.col("longitude")).isNotNull()
    return df.select(
        "transaction_id", "user_id", "transaction_ts", "velocity_15min", F.coalesce("amount", F.lit(0.0)).alias("txn_amount"),
        F.coalesce("avg_amount", F.lit(DEFAULT_AVG)).alias("user_avg_amount"), F.coalesce("stddev_amount", F.lit(DEFAULT_STDDEV)).alias("user_stddev_amount"),
        F.round("z", 4).alias("amount_zscore"), F.when(placed, F.col("prev_city")).alias("prev_transaction_city"),
        F.when(placed, F.col("prev_ts")).alias("prev_transaction_ts"), F.round(nonzero(F.col("geo_km")), 2).alias("geo_distance_km"), F.round(nonzero(F.col("minutes")), 2).alias("time_since_last_txn_min"),
        "is_new_device", "device_id", "city", "country", nonzero(F.col("latitude")).alias("latitude"), nonzero(F.col("longitude")).alias("longitude"),
        "suspect_location", "risk_score_raw", flag(F.col("risk_score_raw"), F.col("suspect_location"), s).alias("is_flagged_for_review"), "is_synthetic_fraud", "fraud_pattern", *keep,
    )


#: The fact row's columns. Of the velocities only one is filled, as the rules use no other.
FACT_COLUMNS = (
    "snapshot_id user_surrogate_key transaction_id user_id computed_at velocity_5min velocity_15min velocity_1hr velocity_24hr txn_amount user_avg_amount user_stddev_amount amount_zscore prev_transaction_city prev_transaction_ts "
    "geo_distance_km time_since_last_txn_min is_new_device device_id risk_score_raw is_flagged_for_review is_synthetic_fraud fraud_pattern"
).split()


def fact_row(features: DataFrame, now: Column) -> DataFrame:
    """Feature rows as the fact table has them. Keys follow from the transaction and the user, so a replay has the same."""
    key = lambda what, c: F.md5(F.concat_ws(":", F.lit(what), F.col(c).cast("string")).cast("binary"))
    none = {f"velocity_{x}": F.lit(None).cast("bigint") for x in ("5min", "1hr", "24hr")}
    return features.withColumns({"snapshot_id": key("snapshot", "transaction_id"), "user_surrogate_key": key("user", "user_id"), "computed_at": now, **none}).select(*FACT_COLUMNS)


def triggers(s: dict[str, Column], geo_hard: Column, flagged: Column) -> Column:
    """Why a row was flagged: one hard rule alone, several, the weighted score only, or none."""
    hard = {"geo": geo_hard, "amount": s["amount"] >= AMOUNT_HARD, "velocity": s["velocity"] >= VELOCITY_HARD}
    n = sum((h.cast("int") for h in hard.values()), F.lit(0))
    out = F.when(~flagged, "none").when(n == 0, "weighted").when(n > 1, "multiple")
    for name, h in hard.items():
        out = out.when(h, name)
    return out
