"""Named reports: parameterised statements run under the guard, and their display."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.display import shown
from tallyward.plans.guard import run

SHOWN_ROWS = 50
CATALOG = {
    "fraud_performance": (
        "Daily fraud operations",
        # the column names and the half-open window are the report's contract
        """WITH decided AS (
             SELECT snapshot_id, decision, identified_pattern FROM decisions.fact_decisions
             WHERE decided_at >= :window_start AND decided_at < :window_end
           ), seen AS (
             SELECT decided.*, labelled.is_synthetic_fraud FROM decided
             LEFT JOIN features.fact_feature_snapshots AS labelled USING (snapshot_id)
           )
           SELECT count(1) AS transactions_reviewed,
                  count(if(decision = 'BLOCK', 1, NULL)) AS block_count,
                  count(if(decision = 'ESCALATE', 1, NULL)) AS escalate_count,
                  count(if(decision = 'ALLOW', 1, NULL)) AS allow_count,
                  round(count(if(is_synthetic_fraud, 1, NULL)) / nullif(count(1), 0), 4) AS fraud_rate,
                  mode(identified_pattern, true) AS top_fraud_pattern
           FROM seen""",
    )
}


def run_report(spark: SparkSession, name: str, tables: Mapping[str, DataFrame], window_start: str, window_end: str) -> DataFrame:
    """A report of the catalogue over a half-open window given by ISO times; they are bound as values."""
    args = {k: datetime.fromisoformat(v) for k, v in (("window_start", window_start), ("window_end", window_end))}
    return run(spark, CATALOG[name][1], tables, args=args)


def displayed(df: DataFrame) -> DataFrame:
    """All columns as reports show them, 50 rows at most."""
    return df.limit(SHOWN_ROWS).select(*[shown(n, k, F.col(n)).alias(n) for n, k in df.dtypes])


def metrics(df: DataFrame) -> DataFrame:
    """(metric, value) of a one-row result, labelled and shown."""
    labels = F.array(*[F.lit(c.replace("_", " ").strip().capitalize()) for c in df.columns])
    values = F.array(*[shown(n, k, F.col(n)) for n, k in df.dtypes])
    return df.limit(1).select(F.explode(F.map_from_arrays(labels, values)).alias("metric", "value"))


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def chart_for(hint: str | None, dtypes: list[tuple[str, str]], n_rows: int) -> tuple[str, str | None, str | None]:
    """(kind, x, y): the hint proposes, the shape disposes. One row, or no number, is no chart."""
    numbers = [n for n, k in dtypes if k.startswith(NUMERIC)]
    others = [n for n, k in dtypes if not k.startswith(NUMERIC)]
    if n_rows < 2 or not numbers or (hint or "") in ("", "none", "table", "metric"):
        return "none", None, None
    return hint or "bar", others[0] if others else numbers[0], numbers[0]
