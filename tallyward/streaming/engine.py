"""Streaming: velocity windows, and the guarded last place as keyed state, written in idempotent micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyward.operators.velocity import SECONDS, SLIDES, WATERMARK
from tallyward.sources.io import file_system
from tallyward.sources.topics import CommittedTable
from tallyward.streaming.features import STATE_TTL_MS
from tallyward.streaming.packs import PackProcessor, as_bytes, as_table, one, packed, placed, unpacked, windowed

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


class OpenPanes(PackProcessor):
    """Counts of users' rows in panes as long as a slide, for as long as the watermark leaves one of a pane's windows open.

    Rows change windows that the watermark hasn't passed, and no others. Panes that it passes are let go when a group's
    next rows come, or else by a timer.
    """

    def __init__(self, slide: int, panes: int) -> None:
        self.slide, self.panes = slide, panes

    def init(self, handle) -> None:
        self.handle, self.counts = handle, handle.getValueState("panes", "users binary")

    def hold(self, table: pa.Table) -> None:
        self.keep(self.counts, table)
        if table.num_rows:
            self.handle.registerTimer((pc.min(table.column("pane")).as_py() + self.panes) * self.slide // 1000)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        found, held = windowed(self.given(rows), self.held(self.counts), self.slide, self.panes, mark * 1000 if mark > 0 else None)
        self.hold(held)
        if found.num_rows:
            yield Row(pack=as_bytes(found))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        table = self.held(self.counts)
        if table is not None:
            ends = (one(table.column("pane")).to_numpy() + self.panes) * self.slide
            self.hold(table.filter(pa.array(ends > timerValues.getCurrentWatermarkInMs() * 1000)))
        return iter([])


def velocity_stream(events: DataFrame, name: str = "15min", watermark: str = WATERMARK) -> DataFrame:
    """Sliding counts with a watermark, in update mode: rows later than it are dropped from windows that it has passed.

    State is panes, which windows are summed from: a row is in one pane, and in as many windows as slides go into one.
    """
    slide = SLIDES[name] * 1_000_000
    kind = dict(events.dtypes)["user_id"]
    rows = events.withWatermark("transaction_ts", watermark).select("user_id", F.unix_micros("transaction_ts").alias("at"))
    packs = packed(rows).groupBy("pack_group").transformWithState(OpenPanes(slide, SECONDS[name] // SLIDES[name]), outputStructType="pack binary", outputMode="Update", timeMode="EventTime")
    at = lambda us: F.timestamp_micros(F.col("first") * slide + us)
    return unpacked(packs, f"user_id {kind}, first bigint, n bigint").select("user_id", at(0).alias("window_start"), at(SECONDS[name] * 1_000_000).alias("window_end"), "n")


class LastPlace(PackProcessor):
    """Users' last believed places, each with a time to live; gives each row the place that it is compared with.

    All of a group's rows of a trigger are taken in time order, null times first, so they are in memory together. A row
    that comes after later ones is compared with what is believed by then; its time lies before the base's, and the
    comparison voids itself.
    """

    def __init__(self, ttl_ms: int = STATE_TTL_MS) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.places = handle.getValueState("place", "users binary", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        found, after = placed(self.given(rows), self.held(self.places, now), now + self.ttl_ms)
        self.keep(self.places, after)
        yield Row(pack=as_bytes(found.select(["transaction_id", "user_id", "prev_lat", "prev_lon", "prev_city", "prev_at"])))


def place_stream(events: DataFrame, ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    """(transaction_id, user_id, prev_lat, prev_lon, prev_city, prev_at) for a stream of transactions, by keyed state.

    Ids of any size and missing ones stay themselves.
    """
    kinds = dict(events.dtypes)
    slim = events.select("transaction_id", "user_id", "latitude", "longitude", "city", F.unix_micros("transaction_ts").alias("at"))
    packs = packed(slim).groupBy("pack_group").transformWithState(LastPlace(ttl_ms), outputStructType="pack binary", outputMode="Append", timeMode="ProcessingTime")
    return unpacked(packs, f"transaction_id {kinds['transaction_id']}, user_id {kinds['user_id']}, prev_lat double, prev_lon double, prev_city string, prev_at bigint")


def held_rows(spark: SparkSession, checkpoint: str, variable: str, schema: str) -> DataFrame:
    """The rows that a state variable holds for all groups, with user ids as text."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
    value = "value.value.users" if "value" in state.schema["value"].dataType.names else "value.users"

    def rows(batches):
        for batch in batches:
            for value in batch.column("pack"):
                table = as_table(value.as_py())
                yield from table.set_column(table.schema.get_field_index("user_id"), "user_id", table.column("user_id").cast(pa.string())).to_batches()

    return state.select(F.col(value).alias("pack")).mapInArrow(rows, schema).withColumnRenamed("user_id", "_user")


def last_places(spark: SparkSession, checkpoint: str, users: DataFrame) -> DataFrame:
    """(user_id, lat, lon, city, at) for every row of users (user_id), looked up in the state that a place stream left at its checkpoint.

    The checkpoint is read as a table: no stream need run. A user without state has nulls.
    """
    state = held_rows(spark, checkpoint, "place", "user_id string, lat double, lon double, city string, at bigint, expires bigint")
    return users.join(state, F.col("user_id").cast("string") == F.col("_user"), "left").drop("_user", "expires")


def last_counts(spark: SparkSession, checkpoint: str, users: DataFrame) -> DataFrame:
    """(user_id, n) for every row of users: the count of the user's last window that a velocity stream still holds, 0 without one."""
    state = held_rows(spark, checkpoint, "panes", "user_id string, pane bigint, n bigint")
    latest = state.groupBy("_user").agg(F.max_by("n", "pane").alias("n"))  # the last window begins with the last pane
    return users.join(latest, F.col("user_id").cast("string") == F.col("_user"), "left").select("user_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@contextmanager
def settings(spark: SparkSession, checkpoint: str, **more: str) -> Iterator[None]:
    """Settings that a query takes along when it starts within.

    A checkpoint on a local disk is written through Hadoop's FileSystem: the default, FileContext, starts a process for
    each look at a local file, which takes longer than a small trigger's own work.
    """
    wanted = ROCKSDB | more
    if file_system(spark, checkpoint)[0].getScheme() == "file":
        wanted["spark.sql.streaming.checkpointFileManagerClass"] = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def to_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: str | None = None, empty_batches: bool = True, after: Callable[[], None] | None = None) -> StreamingQuery:
    """Write each micro-batch under its number, so that a batch that runs again overwrites what it wrote.

    Without a trigger interval, all there is is read and the query ends. The state store is RocksDB. Empty batches move
    watermarks on; state with a time to live would ask for another one for ever, and needs empty_batches=False. `after`
    is called when a batch has been written; the next one looks for input after that.
    """

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={i}")
        if after:
            after()

    with settings(stream.sparkSession, checkpoint, **{"spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower()}):
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
        return writer.foreachBatch(write).start()


def table_stream(stream: DataFrame, path: str, checkpoint: str, trigger: str = "0 seconds") -> StreamingQuery:
    """Write each micro-batch to a committed table: whole and once, or not at all."""
    stream.sparkSession.dataSource.register(CommittedTable)
    with settings(stream.sparkSession, checkpoint):
        return stream.writeStream.format("tallyward_table").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def latest_windows(batches: DataFrame) -> DataFrame:
    """The last count of each window from update-mode batches: a later batch's count stands."""
    return batches.groupBy("user_id", "window_start", "window_end").agg(F.max_by("n", "batch").alias("n"))


def stop_in_order(running: list[StreamingQuery]) -> None:
    """Let each query take in what there is, then stop them all; an error of any comes up once all are stopped."""
    try:
        for query in running:
            query.processAllAvailable()
    finally:
        for query in running:
            query.stop()
