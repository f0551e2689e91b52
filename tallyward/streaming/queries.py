"""Streams run over the given tables to their end, as registered queries; their results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward import queries as batch
from tallyward.sources.io import file_system, moved, shared_folder, written
from tallyward.sources.tables import bad_transactions, baselines, transactions, trusted_devices
from tallyward.sources.topics import VELOCITY_LIMIT, append_to_topic, committed, topic_stream
from tallyward.streaming.engine import last_places, latest_windows, place_stream, stop_in_order, table_stream, to_batches, velocity_stream
from tallyward.streaming.features import as_messages, feature_stream, known_users

#: Rows of one trigger, about: a user's rows of a trigger are in memory together.
TRIGGER_ROWS = 1_000_000
#: The column that says which part of a stream's input a row is in.
PART = "stream_part"


def _cuts(tx: DataFrame, rows: int) -> list[int]:
    """Times (microseconds) that cut tx into ranges of about `rows` rows."""
    n = -(-tx.count() // rows)
    at = F.unix_micros("transaction_ts")
    found = tx.agg(F.percentile_approx(at, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(10_000))).first()[0] if n > 1 else []
    return sorted(set(found or []))


def _ranged(tx: DataFrame, rows: int) -> DataFrame:
    """tx with its part: ranges of time of about `rows` rows, numbered in order; rows without a time are in the first."""
    at = F.unix_micros("transaction_ts")
    return tx.withColumn(PART, F.coalesce(sum(((at > cut).cast("int") for cut in _cuts(tx, rows)), F.lit(0)), F.lit(0)))


def _in_turn(rows: DataFrame, stream_of, mode: str = "append") -> str:
    """Run a stream over the parts of rows (PART) one after the other, a trigger each; the folder of all this.

    All parts are written in one pass, out of the stream's sight. A part's folder is moved into its input when the trigger
    before has written what it made: no trigger looks for input then, so each finds its part whole and alone, and the
    order rests neither on files' times nor on how a store moves folders.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "stream")
    rows.write.partitionBy(PART).parquet(f"{folder}/parts")
    fs, at = file_system(spark, f"{folder}/parts")
    left = sorted((int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(at) if x.isDirectory()), reverse=True)

    def following() -> None:
        if left:
            part = left.pop()
            moved(spark, f"{folder}/parts/{PART}={part}", f"{folder}/in/{part}")

    if not left:  # no rows: still a stream, over an empty part
        rows.drop(PART).write.parquet(f"{folder}/in/0")
    following()
    stream = spark.readStream.schema(rows.drop(PART).schema).parquet(f"{folder}/in/*")
    stop_in_order([to_batches(stream_of(stream), f"{folder}/out", f"{folder}/check", mode, trigger="0 seconds", empty_batches=False, after=following)])
    return folder


def _windows_of(rows: DataFrame) -> DataFrame:
    """The last counts of the 15-minute windows of a velocity stream over the parts of rows, under the 10-minute watermark."""
    folder = _in_turn(rows, velocity_stream, "update")
    found = latest_windows(rows.sparkSession.read.parquet(f"{folder}/out"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def streamed_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding 15-minute counts from a stream in update mode, under the rule's watermark: windows that it passes are let go.

    The stream takes ranges of time one after the other, so no row comes late.
    """
    tx = transactions(spark, sf_dir).select("transaction_id", "user_id", "transaction_ts")
    return _windows_of(_ranged(tx, min(TRIGGER_ROWS, max(1, -(-tx.count() // 3)))))


def late_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every 50th row coming after all others: it still counts in windows that the watermark hasn't passed."""
    tx = transactions(spark, sf_dir).select("transaction_id", "user_id", "transaction_ts")
    return _windows_of(tx.withColumn(PART, (F.col("transaction_id") % 50 == 0).cast("int")))


def two_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, windows, places): both streams at once in one session, each with its own checkpoint, on a 1-second trigger.

    They are stopped when all input is through; whatever they wrote is whole by then.
    """
    tx = transactions(spark, sf_dir).select("transaction_id", "user_id", "latitude", "longitude", "city", "transaction_ts")
    folder = shared_folder(spark, "streams")
    tx.write.parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema(tx.schema).parquet(f"{folder}/in")
    running = [
        to_batches(velocity_stream(stream()), f"{folder}/windows", f"{folder}/windows-check", "update", trigger="1 second"),
        to_batches(place_stream(stream()), f"{folder}/places", f"{folder}/places-check", trigger="1 second", empty_batches=False),
    ]
    stop_in_order(running)
    windows = latest_windows(spark.read.parquet(f"{folder}/windows")).groupBy("user_id").agg(F.sum("n").alias("windows"))
    places = spark.read.parquet(f"{folder}/places").groupBy("user_id").agg(F.count(F.lit(1)).alias("places"))
    return windows.join(places, "user_id", "full_outer")


def streamed_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guarded last place by keyed state, from ranges of time that the stream takes one after the other."""
    tx = transactions(spark, sf_dir).select("transaction_id", "user_id", "latitude", "longitude", "city", "transaction_ts")
    return locations_of(tx).select("transaction_id", "prev_city", F.timestamp_micros("prev_at").cast("timestamp_ntz").alias("prev_ts"))


def _features_of(tx: DataFrame, base: DataFrame, trusted: DataFrame, trigger_rows: int = TRIGGER_ROWS) -> DataFrame:
    """feature_stream over tx as messages, range of time by range of time."""
    known = written(known_users(base, trusted), "users")  # read by every trigger
    folder = _in_turn(as_messages(_ranged(tx, trigger_rows), PART), lambda stream: feature_stream(stream, known))
    return tx.sparkSession.read.parquet(f"{folder}/out").drop("batch")


def streamed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows from the scoring stream: the same as feature_snapshots."""
    tx = transactions(spark, sf_dir).drop("merchant_category")
    found = _features_of(tx, baselines(tx), trusted_devices(tx), min(TRIGGER_ROWS, max(1, -(-tx.count() // 3))))
    return batch.as_snapshots(found.drop("error_reason"))


def streamed_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(transaction_id, user_id, error_reason) of the rows that the scoring stream sets aside, and how many of each user's rows it scored."""
    tx = bad_transactions(spark, sf_dir).drop("merchant_category")
    found = _features_of(tx, baselines(transactions(spark, sf_dir)), trusted_devices(tx))
    scored = found.where("error_reason is null and risk_score_raw is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("scored"))
    return found.where("error_reason is not null").select("transaction_id", "user_id", "error_reason").join(scored, "user_id", "left")


def limited_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(transaction_id, user_id, amount, transaction_ts) of a topic read under the velocity stream's limit and written batch by batch to a committed table.

    The stream is stopped half-way and started again from its checkpoint: nothing is lost or comes twice.
    """
    tx = transactions(spark, sf_dir).select("transaction_id", "user_id", "amount", F.col("transaction_ts").cast("string").alias("transaction_ts"))
    folder = shared_folder(spark, "topic")
    at = F.col("transaction_id")
    messages = lambda rows: rows.select(F.col("user_id").cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))
    for half in (tx.where(at % 2 == 0), tx.where(at % 2 == 1)):
        append_to_topic(messages(half), f"{folder}/topic")
        running = table_stream(topic_stream(spark, f"{folder}/topic", "velocity", VELOCITY_LIMIT), f"{folder}/table", f"{folder}/check")
        stop_in_order([running])
    found = committed(spark, f"{folder}/table", "partition int, offset bigint, key string, value string")
    return found.select(F.from_json("value", "transaction_id bigint, user_id bigint, amount double, transaction_ts string").alias("r")).select("r.transaction_id", "r.user_id", "r.amount", F.col("r.transaction_ts").cast("timestamp_ntz").alias("transaction_ts"))


def looked_up_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last believed place, looked up in the state that the place stream leaves; users who never came have nulls."""
    tx = transactions(spark, sf_dir).select("transaction_id", "user_id", "latitude", "longitude", "city", "transaction_ts")
    folder = _in_turn(_ranged(tx, TRIGGER_ROWS), place_stream)
    users = tx.select("user_id").distinct().unionAll(tx.agg((F.max("user_id") + 1).alias("user_id")))
    return last_places(spark, f"{folder}/check", users).select("user_id", "city", F.timestamp_micros("at").cast("timestamp_ntz").alias("at_time"))


def locations_of(tx: DataFrame, trigger_rows: int = TRIGGER_ROWS) -> DataFrame:
    """place_stream over tx, range of time by range of time."""
    folder = _in_turn(_ranged(tx, trigger_rows), place_stream)
    return tx.sparkSession.read.parquet(f"{folder}/out")


_AT = "(epoch_us(transaction_ts) // 60000000) * 60"
LATE_SQL = f"""WITH {batch.TX}, w AS (SELECT transaction_id % 50 = 0 AS late, user_id, unnest(generate_series({_AT} - 840, {_AT}, 60)) AS s FROM tx),
m AS (SELECT max(epoch_us(transaction_ts)) - 600000000 AS mark FROM tx WHERE transaction_id % 50 <> 0)
SELECT user_id, make_timestamp(s * 1000000) AS window_start, make_timestamp((s + 900) * 1000000) AS window_end, count(*) AS n FROM w, m WHERE NOT late OR (s + 900) * 1000000 > mark GROUP BY ALL"""
TWO_SQL = f"WITH {batch.TX} SELECT user_id, count(*) * 15 AS windows, count(*) AS places FROM tx GROUP BY user_id"

DEAD_SQL = f"""WITH {batch.TX}, {batch.BAD}, c AS (SELECT user_id, count(*) AS scored FROM bad WHERE {batch.BAD_REASON} IS NULL GROUP BY user_id)
SELECT transaction_id, user_id, {batch.BAD_REASON} AS error_reason, scored FROM bad LEFT JOIN c USING (user_id) WHERE {batch.BAD_REASON} IS NOT NULL"""
#: The fold's place after each user's last row.
PLACES_SQL = batch.sql(
    "SELECT u.user_id, b_city AS city, b_ts AS at_time FROM (SELECT DISTINCT user_id FROM tx UNION ALL SELECT max(user_id) + 1 FROM tx) u LEFT JOIN (SELECT * FROM fold QUALIFY n = max(n) OVER (PARTITION BY user_id)) f ON f.user_id = u.user_id",
    batch.TX, batch.TRAIL, batch.GUARDED,
)

QUERIES = {f.__name__: f for f in (streamed_velocity, streamed_locations, late_velocity, two_streams, streamed_features, streamed_dead_letters, looked_up_places, limited_topic)}
ORACLES = {"streamed_velocity": batch.ORACLES["sliding_velocity"], "streamed_locations": batch.ORACLES["guarded_locations"], "late_velocity": LATE_SQL, "two_streams": TWO_SQL, "streamed_features": batch.ORACLES["feature_snapshots"], "streamed_dead_letters": DEAD_SQL, "looked_up_places": PLACES_SQL, "limited_topic": f"WITH {batch.TX} SELECT transaction_id, user_id, amount, transaction_ts FROM tx"}
