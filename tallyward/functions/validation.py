"""Row checks as columns: the first broken rule's name, or null. Bad rows are set aside; the batch goes on."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the data contract.
PATTERNS = ("VELOCITY_SPIKE", "AMOUNT_ANOMALY", "GEO_JUMP", "NEW_DEVICE")
DECISIONS = ("ALLOW", "BLOCK", "ESCALATE")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def first_error(rules: dict[str, Column]) -> Column:
    """Name of the first rule, in order, that isn't true."""
    out = F.when(F.lit(False), "")
    for name, good in rules.items():
        out = out.when(~F.coalesce(good, F.lit(False)), name)
    return out


def pattern_known(pattern: Column) -> Column:
    return pattern.isNull() | pattern.isin(*PATTERNS, "NONE")


def transaction_error(amount: Column, pattern: Column) -> Column:
    """For rows before scoring: an amount may be missing (it counts as 0), else it is finite and not negative."""
    known = F.coalesce(amount, F.lit(0.0))
    return first_error({"amount_not_finite": finite(known), "amount_negative": known >= 0, "pattern_unknown": pattern_known(pattern)})


def feature_error(amount: Column, risk: Column, z: Column, pattern: Column) -> Column:
    """For feature rows."""
    return first_error({"amount_not_finite": finite(amount), "amount_negative": amount >= 0, "risk_not_probability": finite(risk) & risk.between(0, 1), "zscore_not_finite": finite(z), "pattern_unknown": pattern_known(pattern)})


def decision_error(decision: Column, confidence: Column) -> Column:
    """ALLOW and BLOCK need a confidence in [0, 1]; ESCALATE may leave it out."""
    probability = finite(confidence) & confidence.between(0, 1)
    return first_error({"decision_unknown": decision.isin(*DECISIONS), "confidence_missing": (decision == "ESCALATE") | confidence.isNotNull(), "confidence_not_probability": confidence.isNull() | probability})


def split_quarantine(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with error_reason)."""
    marked = df.withColumn("error_reason", error)
    return marked.where("error_reason is null").drop("error_reason"), marked.where("error_reason is not null")


def append_checked(rows: DataFrame, reason: Column, path: str) -> None:
    """Append the rows without an error to a table; a failed write leaves it as it was."""
    good, _ = split_quarantine(rows, reason)
    good.select(*rows.columns).write.mode("append").parquet(path)
