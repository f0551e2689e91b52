"""Great-circle distance, implied speed and the geographic hard rule, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Fixed values of the rule: a jump alone, or a speed over a least distance.
JUMP_KM, JET_KMH, SPEED_LEAST_KM = 3000.0, 900.0, 100.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points; null if any coordinate is null."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    chord = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    # least() skips nulls, so the clamp stands behind a null check
    return F.when(chord.isNotNull(), F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) * (2 * EARTH_KM))


def implied_kmh(km: Column, minutes: Column) -> Column:
    """Null if the distance or the time is null, or the time isn't positive."""
    return F.when(minutes > 0, km / (minutes / 60.0))


def impossible_travel(km: Column, kmh: Column) -> Column:
    """True for a far jump, or for a speed beyond a jet's over more than noise; a null distance is false."""
    return F.coalesce((km >= JUMP_KM) | (F.coalesce(kmh > JET_KMH, F.lit(False)) & (km >= SPEED_LEAST_KM)), F.lit(False))


def minutes_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 60_000_000.0


def nonzero(x: Column) -> Column:
    """Zero counts as missing, as it does for coordinates and stored distances."""
    return F.when(x != 0, x)
