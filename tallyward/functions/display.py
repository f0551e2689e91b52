"""Display formats, report windows and period keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names by which a number shows as a percentage.
PERCENT = ("rate", "pct", "percent", "share")


def shown(name: str, kind: str, value: Column) -> Column:
    """A value as reports show it; null as a dash."""
    low = name.lower()
    if kind == "boolean":
        text = F.when(value, "yes").otherwise("no")
    elif kind in ("double", "float") and any(p in low for p in PERCENT):
        text = F.format_string("%.2f%%", value * 100)
    elif kind in ("double", "float"):
        text = F.format_number(value, 2)
    elif kind in ("bigint", "int", "smallint", "tinyint"):
        text = F.format_number(value, 0)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "—").otherwise(text)


def period_start(fired: Column, frequency: Column) -> Column:
    """Start of the half-open report window that ends when it fires; unknown frequencies count as daily."""
    hours = F.when(frequency == "hourly", 1).when(frequency == "weekly", 168).otherwise(24)
    return fired - F.make_dt_interval(hours=hours)


def period_key(fired: Column, frequency: Column) -> Column:
    """The period that a firing stands for: firings with one key are one run."""
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), fired), F.weekofyear(fired))
    return F.when(frequency == "hourly", F.date_format(fired, "yyyy-MM-dd'T'HH")).when(frequency == "weekly", week).otherwise(F.date_format(fired, "yyyy-MM-dd"))
