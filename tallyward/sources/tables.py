"""Domain inputs read from the given tables: transactions, baselines, devices, decisions.

Cities are a fixed list: home by user, now and then a foreign one. Devices, labels and decisions follow from ids, so
that every run sees the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cities chosen for this engine's inputs: city, country, latitude, longitude; the first ten are homes.
CITIES = (
    ("Portland", "US", 45.52, -122.68), ("Phoenix", "US", 33.45, -112.07), ("Dallas", "US", 32.78, -96.80), ("Minneapolis", "US", 44.98, -93.27), ("Philadelphia", "US", 39.95, -75.17),
    ("Charlotte", "US", 35.23, -80.84), ("Detroit", "US", 42.33, -83.05), ("Salt Lake City", "US", 40.76, -111.89), ("Nashville", "US", 36.16, -86.78), ("Kansas City", "US", 39.10, -94.58),
    ("Toronto", "CA", 43.65, -79.38), ("Lisbon", "PT", 38.72, -9.14), ("Nairobi", "KE", -1.29, 36.82), ("Lima", "PE", -12.05, -77.04), ("Seoul", "KR", 37.57, 126.98),
    ("Oslo", "NO", 59.91, 10.75), ("Auckland", "NZ", -36.85, 174.76), ("Cape Town", "ZA", -33.92, 18.42),
)
HOMES = 10
#: The same, for SQL; i counts from 0.
CITIES_SQL = "(VALUES " + ", ".join(f"({i}, '{c}', '{k}', CAST({a} AS DOUBLE), CAST({o} AS DOUBLE))" for i, (c, k, a, o) in enumerate(CITIES)) + ") AS cities(i, city, country, lat, lon)"
PATTERN_BY_ID = ("VELOCITY_SPIKE", "AMOUNT_ANOMALY", "GEO_JUMP", "NEW_DEVICE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def city_part(index, field: str):
    """A field of the city with this index: a lookup in a literal array, no join."""
    return F.element_at(F.array(*[F.lit(c[("city", "country", "lat", "lon").index(field)]) for c in CITIES]), (index + 1).cast("int"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with device, place and labels, one per event."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    city = F.when(F.col("event_id") % 20 == 0, 10 + F.col("event_id") % 8).otherwise(F.col("user_id") % 10)
    pattern = F.element_at(F.array(*map(F.lit, PATTERN_BY_ID)), (F.col("event_id") % 4 + 1).cast("int"))
    fraud = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("transaction_id"), "user_id", F.col("value").alias("amount"), F.col("ts").cast("timestamp").alias("transaction_ts"), F.col("event_type").alias("merchant_category"),
        (F.col("user_id") * 10 + k % 3).alias("device_id"), *[city_part(city, c).alias(n) for c, n in (("city", "city"), ("country", "country"), ("lat", "latitude"), ("lon", "longitude"))],
        fraud.alias("is_synthetic_fraud"), F.when(fraud, pattern).alias("fraud_pattern"),
    )


TRANSACTIONS_SQL = f"""tx AS (
  SELECT event_id AS transaction_id, user_id, value AS amount, ts AS transaction_ts, event_type AS merchant_category,
         user_id * 10 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 AS device_id,
         city, country, lat AS latitude, lon AS longitude, event_type = 'error' AS is_synthetic_fraud,
         CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'VELOCITY_SPIKE' WHEN 1 THEN 'AMOUNT_ANOMALY' WHEN 2 THEN 'GEO_JUMP' ELSE 'NEW_DEVICE' END END AS fraud_pattern
  FROM events JOIN {CITIES_SQL} ON i = CASE WHEN event_id % 20 = 0 THEN 10 + event_id % 8 ELSE user_id % 10 END)"""


def bad_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transactions with rows that the validator must set aside."""
    t, i = transactions(spark, sf_dir), F.col("transaction_id")
    return t.withColumn("amount", F.when(i % 97 == 0, F.lit(float("nan"))).when(i % 89 == 0, F.lit(-1.0)).otherwise(F.col("amount"))).withColumn("fraud_pattern", F.when(i % 83 == 0, "TELEPORT").otherwise(F.col("fraud_pattern")))


def baselines(tx: DataFrame) -> DataFrame:
    """Per user: mean and sample standard deviation; a missing mean is 0, a missing or zero deviation 1."""
    return tx.groupBy("user_id").agg(F.coalesce(F.avg("amount"), F.lit(0.0)).alias("avg_amount"), F.coalesce(F.nullif(F.stddev_samp("amount"), F.lit(0.0)), F.lit(1.0)).alias("stddev_amount"))


BASELINES_SQL = """base AS (SELECT user_id, coalesce(avg(amount), 0.0) AS avg_amount, coalesce(nullif(stddev_samp(amount), 0.0), 1.0) AS stddev_amount FROM tx GROUP BY user_id)"""


def trusted_devices(tx: DataFrame) -> DataFrame:
    """(user_id, device_id) of trusted devices: all but each user's third."""
    return tx.where("device_id % 10 < 2").select("user_id", "device_id").distinct()


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per transaction, with confidence, tier inputs, judge score and what the agent saw."""
    t, i = transactions(spark, sf_dir), F.col("transaction_id")
    wrong = F.element_at(F.array(*map(F.lit, PATTERN_BY_ID)), (i % 3 + 1).cast("int"))
    decision = F.when(i % 10 < 6, "ALLOW").when(i % 10 < 9, "BLOCK").otherwise("ESCALATE")
    return t.select(
        i.alias("decision_id"), i.alias("snapshot_id"), "transaction_id", "user_id", F.col("amount"), decision.alias("decision"),
        F.when(i % 13 != 0, 0.5 + (i % 50) / F.lit(100.0)).alias("confidence_score"), F.when(i % 7 != 0, (i % 100) / F.lit(100.0)).alias("judge_score"),
        wrong.alias("identified_pattern"), F.when(i % 5 != 0, F.concat_ws(", ", F.lower(wrong), F.lit("GEO_JUMP"))).alias("elevated_patterns"),
        F.col("transaction_ts").alias("decided_at"), (i % 3 == 0).alias("human_reviewed"), (i % 1000).alias("latency_ms"), "is_synthetic_fraud", "fraud_pattern",
    )


DECISIONS_SQL = """dec AS (
  SELECT transaction_id AS decision_id, transaction_id AS snapshot_id, transaction_id, user_id, amount,
         CASE WHEN transaction_id % 10 < 6 THEN 'ALLOW' WHEN transaction_id % 10 < 9 THEN 'BLOCK' ELSE 'ESCALATE' END AS decision,
         CASE WHEN transaction_id % 13 <> 0 THEN 0.5::DOUBLE + (transaction_id % 50) / 100.0::DOUBLE END AS confidence_score,
         CASE WHEN transaction_id % 7 <> 0 THEN (transaction_id % 100) / 100.0::DOUBLE END AS judge_score,
         w AS identified_pattern, CASE WHEN transaction_id % 5 <> 0 THEN lower(w) || ', GEO_JUMP' END AS elevated_patterns,
         transaction_ts AS decided_at, transaction_id % 3 = 0 AS human_reviewed, transaction_id % 1000 AS latency_ms, is_synthetic_fraud, fraud_pattern
  FROM (SELECT *, CASE transaction_id % 3 WHEN 0 THEN 'VELOCITY_SPIKE' WHEN 1 THEN 'AMOUNT_ANOMALY' ELSE 'GEO_JUMP' END AS w FROM tx))"""
