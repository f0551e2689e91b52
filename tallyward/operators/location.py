"""The user's last known place: by plain lag, and guarded against poisoning.

The guard: a place reached by impossible travel never becomes the base for the next comparison. So each row depends on
which earlier rows were believed, and a lag can't say it. The guarded version reads each user's rows in time order and
carries one place from row to row: partitions are sorted by user and time, and memory holds an Arrow batch and one
place, however many rows a user has. A user's rows stay in one task, since each depends on the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import asin, cos, radians, sin, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.functions.geo import EARTH_KM, JET_KMH, JUMP_KM, SPEED_LEAST_KM, haversine_km
from tallyward.sources.tables import CITIES

PREVIOUS = ("prev_lat", "prev_lon", "prev_city", "prev_ts")


def with_lag(tx: DataFrame) -> DataFrame:
    """tx with the place and time of the user's transaction before."""
    w = Window.partitionBy("user_id").orderBy("transaction_ts", "transaction_id")
    before = tx.withColumn("_b", F.lag(F.struct(F.col("latitude").alias("prev_lat"), F.col("longitude").alias("prev_lon"), F.col("city").alias("prev_city"), F.col("transaction_ts").alias("prev_ts"))).over(w))
    return before.select(*tx.columns, "_b.*")


def suspect(base: tuple | None, lat: float, lon: float, at: int) -> bool:
    """Whether a move from base (lat, lon, city, microseconds) is impossible."""
    if base is None:
        return False
    minutes = (at - base[3]) / 60e6
    if minutes <= 0:
        return False
    a, b = radians(base[0]), radians(lat)
    chord = sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(radians(lon - base[1]) / 2) ** 2
    km = 2 * EARTH_KM * asin(sqrt(min(1.0, chord)))
    return km >= JUMP_KM or km >= SPEED_LEAST_KM and km / (minutes / 60) > JET_KMH


def advance(base: tuple | None, lat: float | None, lon: float | None, city: str | None, at: int | None) -> tuple | None:
    """The base after a row: the row's own place if it has one and is believed. A coordinate of 0 is missing."""
    if not lat or not lon or lat != lat or lon != lon or at is None or suspect(base, lat, lon, at):
        return base
    return lat, lon, city, at


def impossible(lat0: np.ndarray, lon0: np.ndarray, at0: np.ndarray, lat: np.ndarray, lon: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each move is impossible, as suspect() has it."""
    a, b = np.radians(lat0), np.radians(lat)
    chord = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon - lon0) / 2) ** 2
    km, minutes = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, chord))), (at - at0) / 60e6
    with np.errstate(divide="ignore", invalid="ignore"):
        return (minutes > 0) & ((km >= JUMP_KM) | (km >= SPEED_LEAST_KM) & (km / (minutes / 60) > JET_KMH))


def steps(lat: np.ndarray, lon: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the move from each row to the next is impossible."""
    return impossible(lat[:-1], lon[:-1], at[:-1], lat[1:], lon[1:], at[1:])


def bases(new_user: np.ndarray, lat: np.ndarray, lon: np.ndarray, at: np.ndarray, known: np.ndarray, held: tuple | None) -> tuple[np.ndarray, int]:
    """For each row, which row it is compared with (-1: none, the number of rows: the place held before); and the last base.

    Where a row follows a believed one of its user by a possible step, it is believed too: such stretches are taken at
    once, and only rows beside missing places and impossible steps are looked at one by one.
    """
    n = len(at)
    follows = np.zeros(n, bool)
    follows[1:] = known[1:] & known[:-1] & ~new_user[1:] & ~steps(lat, lon, at)
    breaks = np.append(np.flatnonzero(~follows), n)
    out = np.empty(n, np.int64)
    place = lambda b: held if b == n else (lat[b], lon[b], None, at[b])
    base, i = (n if held else -1), 0
    while i < n:
        if follows[i] and base == i - 1:
            end = int(breaks[np.searchsorted(breaks, i)])
            out[i:end] = np.arange(i - 1, end - 1)
            base, i = end - 1, end
            continue
        if new_user[i]:
            base = -1
        out[i] = base
        if known[i] and not suspect(place(base) if base >= 0 else None, lat[i], lon[i], at[i]):
            base = i
        i += 1
    return out, base


def with_guarded(tx: DataFrame) -> DataFrame:
    """tx with the believed place and time that each row is compared with.

    Every row of tx comes back once, with all its columns, rows that repeat a transaction_id or have none included.
    """
    columns = tx.columns
    kinds = {c: k for c, k in tx.dtypes}
    taken = [columns.index(c) for c in ("user_id", "latitude", "longitude", "city")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            users, lat_col, lon_col, city = (batch.column(i) for i in taken)
            moment = batch.column(batch.num_columns - 1)
            lat, lon = (np.asarray(c.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)) for c in (lat_col, lon_col))
            at = moment.fill_null(0).to_numpy(zero_copy_only=False)
            known = (lat != 0) & (lon != 0) & ~np.isnan(lat) & ~np.isnan(lon) & moment.is_valid().to_numpy(zero_copy_only=False)
            keys = users.to_pylist()
            new_user = np.array([a != b for a, b in zip(keys, [user, *keys[:-1]], strict=True)], bool)
            if new_user[0]:
                held = None
            of, last = bases(new_user, lat, lon, at, known, held)
            pick = pa.array(np.maximum(of, 0), mask=of < 0)
            before = held or (None,) * 4
            taken_from = lambda values, kind, old: pa.concat_arrays([values.cast(kind), pa.array([old], kind)]).take(pick)  # noqa: B023, E731
            yield pa.record_batch([*batch.columns[:-1], taken_from(lat_col, pa.float64(), before[0]), taken_from(lon_col, pa.float64(), before[1]), taken_from(city, pa.string(), before[2]), taken_from(moment, pa.int64(), before[3])], names=[*columns, "_lat", "_lon", "_city", "_at"])
            user = keys[-1]
            if last < 0:
                held = None
            elif last < batch.num_rows:
                held = (lat[last].item(), lon[last].item(), city[last].as_py(), at[last].item())

    ordered = tx.withColumn("_moment", F.unix_micros("transaction_ts")).repartition("user_id").sortWithinPartitions("user_id", "_moment", "transaction_id")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", _lat double, _lon double, _city string, _at bigint"
    found = ordered.mapInArrow(fold, schema)
    return found.select(*columns, F.col("_lat").alias("prev_lat"), F.col("_lon").alias("prev_lon"), F.col("_city").alias("prev_city"), F.timestamp_micros("_at").alias("prev_ts"))


def far_cities(people: DataFrame, least_km: float = 5000.0) -> DataFrame:
    """(user_id, city index) of the cities at least so far from home: the fixed list, filtered in each row."""
    all_cities = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("lat"), F.lit(o).alias("lon")) for i, (_, _, a, o) in enumerate(CITIES)])
    each = people.select("user_id", "home_latitude", "home_longitude", F.explode(all_cities).alias("c"))
    return each.where(haversine_km(F.col("home_latitude"), F.col("home_longitude"), F.col("c.lat"), F.col("c.lon")) >= least_km).select("user_id", F.col("c.i").alias("city"))
