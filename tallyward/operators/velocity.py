"""Transaction velocity: trailing counts, and sliding windows for batch and stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Window lengths with their slides, the watermark, and the count above which a user is flagged.
WINDOWS = {"5min": ("5 minutes", "1 minute"), "15min": ("15 minutes", "1 minute"), "1hr": ("1 hour", "5 minutes"), "24hr": ("24 hours", "30 minutes")}
SECONDS = {"5min": 300, "15min": 900, "1hr": 3_600, "24hr": 86_400}
WATERMARK, FLAG_ABOVE = "10 minutes", 5


#: Stretches of time that one task counts at once are so many times as long as the longest window.
STRETCH = 16


def trailing(tx: DataFrame, *names: str) -> DataFrame:
    """tx with velocity_<name>: the user's transactions in the time up to and including this one's moment.

    Users are cut into stretches of time, each a group of its own, so that a user of very many rows is many tasks. The
    rows within a window's length of a stretch's end are in the next one too, to be counted there only.
    """
    most = max(SECONDS[n] for n in names) * 1_000_000
    length = STRETCH * most
    own = F.floor(F.col("_at") / length)
    both = F.array(own, F.when(F.pmod(F.col("_at"), F.lit(length)) >= length - most, own + 1))
    # rows without a time have no stretch (null), and are counted among themselves
    out = tx.withColumn("_at", F.unix_micros("transaction_ts")).withColumn("_n", F.explode(F.when(F.col("_at").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.array_compact(both))))
    for name in names:
        w = Window.partitionBy("user_id", "_n").orderBy("_at").rangeBetween(-SECONDS[name] * 1_000_000, 0)
        out = out.withColumn(f"velocity_{name}", F.count(F.lit(1)).over(w))
    return out.where(F.col("_n").eqNullSafe(own)).drop("_at", "_n")


def sliding(tx: DataFrame, name: str = "15min") -> DataFrame:
    """(user_id, window_start, window_end, n) of one window length; for streams, put a watermark on tx first."""
    length, slide = WINDOWS[name]
    counts = tx.groupBy("user_id", F.window("transaction_ts", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


#: The slides in seconds.
SLIDES = {"5min": 60, "15min": 60, "1hr": 300, "24hr": 1_800}


def paned(tx: DataFrame, name: str = "15min") -> DataFrame:
    """sliding() for a whole table: rows are counted in panes as long as a slide, and panes summed into windows.

    Only panes go into each of the windows that hold them; a pane's rows were one row by then.
    """
    slide = SLIDES[name] * 1_000_000
    panes = tx.where("transaction_ts is not null").groupBy("user_id", F.floor(F.unix_micros("transaction_ts") / slide).alias("pane")).agg(F.count(F.lit(1)).alias("n"))
    first = F.explode(F.sequence(F.col("pane") - (SECONDS[name] // SLIDES[name] - 1), F.col("pane"))).alias("first")
    sums = panes.select("user_id", "n", first).groupBy("user_id", "first").agg(F.sum("n").alias("n"))
    at = lambda us: F.timestamp_micros(us)
    return sums.select("user_id", at(F.col("first") * slide).alias("window_start"), at(F.col("first") * slide + SECONDS[name] * 1_000_000).alias("window_end"), "n")


def sliding_all(tx: DataFrame) -> DataFrame:
    """All four window lengths of a whole table, one below the other, with window_name."""
    parts = [paned(tx, name).select(F.lit(name).alias("window_name"), "*") for name in WINDOWS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flagged_users(tx: DataFrame, above: int = FLAG_ABOVE) -> DataFrame:
    """Per user: the count at their latest transaction, and whether it is over the threshold."""
    v = trailing(tx, "15min")
    last = F.max_by("velocity_15min", F.struct("transaction_ts", "transaction_id"))
    return v.groupBy("user_id").agg(last.alias("velocity_15min"), (last > above).alias("flagged"))
