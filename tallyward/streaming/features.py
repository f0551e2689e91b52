"""The scoring stream: parsed messages become feature rows in one pass, good and bad ones told apart.

Messages are parsed, checked, and joined with baselines and devices (tables); then each user's state, a list of recent
times and the last believed place, gives the trailing count and the place that a row is compared with; then the row is
scored. A row that breaks a rule goes through without touching the state and comes out as a dead letter.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallyward.functions.risk import scored, with_travel
from tallyward.functions.validation import transaction_error
from tallyward.operators.velocity import SECONDS
from tallyward.sources.io import parse_events
from tallyward.streaming.packs import PackProcessor, as_bytes, counted, packed, placed, unpacked

#: How long a user's state is kept after it was last written.
STATE_TTL_MS = 86_400_000
#: Recent times are kept as long as the 15 minutes that are counted and the 10 that a row may come late.
WINDOW_US, LATE_US = SECONDS["15min"] * 1_000_000, 600 * 1_000_000
#: Types of the parsed columns; the time is read from text.
MESSAGE = (
    "transaction_id bigint, user_id bigint, device_id bigint, amount double, city string, latitude double, longitude double, "
    "country string, transaction_ts string, is_synthetic_fraud boolean, fraud_pattern string"
)
#: What the state adds to a row.
ADDED = "velocity_15min bigint, prev_lat double, prev_lon double, prev_city string, prev_at bigint"


class UserHistory(PackProcessor):
    """Users' recent times and last believed places, each with a time to live.

    The rows of one group and trigger are taken in time order, and so are in memory together. A count covers the rows up
    to and including the same moment, of this trigger and of the recent times; a row that comes late is counted among what
    is known of its time by then. Rows with an error_reason get nulls and change nothing.
    """

    def __init__(self, columns: list[str], ttl_ms: int = STATE_TTL_MS) -> None:
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle) -> None:
        self.place = handle.getValueState("place", "users binary", ttlDurationMs=self.ttl_ms)
        self.recent = handle.getValueState("recent", "users binary", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        table, now = self.given(rows), timerValues.getCurrentProcessingTimeInMs()
        names = [*self.columns, "velocity_15min", "prev_lat", "prev_lon", "prev_city", "prev_at"]
        fine = pc.is_null(table.column("error_reason"))
        good, bad = table.filter(fine), table.filter(pc.invert(fine))
        if good.num_rows:
            counts, times = counted(good, self.held(self.recent, now), WINDOW_US, WINDOW_US + LATE_US, now + self.ttl_ms)
            good = good.append_column("velocity_15min", pa.array(counts, mask=good.column("at").is_null().to_numpy()))
            found, after = placed(good, self.held(self.place, now), now + self.ttl_ms)
            self.keep(self.recent, times)
            self.keep(self.place, after)
            yield Row(pack=as_bytes(found.select(names)))
        if bad.num_rows:
            for name, kind in zip(names[len(self.columns) :], (pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64()), strict=True):
                bad = bad.append_column(name, pa.nulls(bad.num_rows, kind))
            yield Row(pack=as_bytes(bad.select(names)))


def with_history(rows: DataFrame, ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    """rows (transaction_id, user_id, latitude, longitude, city, transaction_ts, error_reason, ...) with ADDED."""
    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    timed = packed(rows.withColumn("at", F.unix_micros("transaction_ts")))
    packs = timed.groupBy("pack_group").transformWithState(UserHistory(rows.columns, ttl_ms), outputStructType="pack binary", outputMode="Append", timeMode="ProcessingTime")
    return unpacked(packs, f"{kinds}, {ADDED}")


def known_users(base: DataFrame, trusted: DataFrame) -> DataFrame:
    """(user_id, avg_amount, stddev_amount, devices): each user's baseline and trusted devices in one row, as feature_stream takes them."""
    devices = trusted.where("user_id is not null").groupBy("user_id").agg(F.collect_set("device_id").alias("devices"))
    return base.where("user_id is not null").join(devices, "user_id", "full_outer")


def feature_stream(messages: DataFrame, known: DataFrame, ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    """Feature rows of messages (value: JSON), with error_reason; a dead letter has only its ids, its time and its reason filled.

    known is a table of known_users(); the join with it holds no state, and is one a trigger for baselines and devices.
    """
    parsed = parse_events(messages, schema=MESSAGE)
    checked = parsed.withColumn("error_reason", transaction_error(F.col("amount"), F.col("fraud_pattern")))
    device = F.col("device_id").cast("string")
    is_new = ~F.coalesce(F.array_contains("devices", F.col("device_id")), F.lit(False)) & device.isNotNull() & (device != "")
    joined = checked.join(known, "user_id", "left").withColumn("is_new_device", is_new).drop("devices")
    rows = with_history(joined, ttl_ms).withColumn("prev_ts", F.timestamp_micros("prev_at")).drop("prev_at")
    out = scored(with_travel(rows), keep=("error_reason",))
    ids = ("transaction_id", "user_id", "transaction_ts", "error_reason")
    return out.select(*[F.col(c) if c in ids else F.when(F.col("error_reason").isNull(), F.col(c)).alias(c) for c in out.columns])


def as_messages(tx: DataFrame, *beside: str) -> DataFrame:
    """Transactions as a topic's messages: key, and the row as JSON with times to the microsecond; columns of `beside` stay columns."""
    row = F.struct(*[c for c in tx.columns if c not in beside])
    return tx.select(F.col("user_id").cast("string").alias("key"), F.to_json(row, {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}).alias("value"), *beside)
