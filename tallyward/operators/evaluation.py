"""Decision quality: confusion, patterns, calibration, the judge, triggers and rule sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.governance import fraud_probability, outcome_correct, surfaced_patterns

BINS = 5


def share(n: Column, d: Column) -> Column:
    return n / F.nullif(d, F.lit(0))


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def _confusion() -> dict[str, Column]:
    decided, block, fraud = F.col("decision") != "ESCALATE", F.col("decision") == "BLOCK", F.coalesce("is_synthetic_fraud", F.lit(False))
    tp, fp, fn, tn = (F.count_if(decided & c) for c in (block & fraud, block & ~fraud, ~block & fraud, ~block & ~fraud))
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    p, r = F.nullif(precision, F.lit(0.0)), F.nullif(recall, F.lit(0.0))
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": precision, "recall": recall, "false_positive_rate": share(fp, fp + tn), "f1": 2 * p * r / (p + r)}


def confusion(decisions: DataFrame) -> DataFrame:
    """tp, fp, fn, tn with BLOCK as positive and escalations left out, and the rates; null where a divisor is 0."""
    return decisions.agg(*_named(_confusion()))


def _escalations(cost: float = 1.0) -> dict[str, Column]:
    n = F.count_if(F.col("decision") == "ESCALATE")
    return {"escalation_rate": share(n, F.count(F.lit(1))), "escalations": n, "escalation_cost": n * cost}


def escalations(decisions: DataFrame, cost: float = 1.0) -> DataFrame:
    return decisions.agg(*_named(_escalations(cost)))


def per_pattern(decisions: DataFrame) -> DataFrame:
    """Per true pattern, over fraud rows: caught, named, detected, mislabelled, missed, and their shares."""
    truth = F.upper(F.trim(F.coalesce("fraud_pattern", F.lit("UNKNOWN"))))
    named = F.upper(F.trim(F.coalesce("identified_pattern", F.lit("NONE")))) == truth
    seen = F.array_contains(surfaced_patterns(F.col("elevated_patterns"), F.col("identified_pattern")), truth)
    counts = decisions.where("is_synthetic_fraud").groupBy(truth.alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision").isin("BLOCK", "ESCALATE")).alias("caught"), F.count_if(named).alias("primary_correct"),
        F.count_if(seen).alias("detected"), F.count_if(seen & ~named).alias("mislabeled"), F.count_if(~seen).alias("missed"),
    )
    return counts.select("*", *[share(F.col(c), F.col("n")).alias(name) for c, name in (("caught", "recall"), ("primary_correct", "pattern_id_accuracy"), ("detected", "detection_rate"), ("mislabeled", "mislabeled_rate"), ("missed", "missed_rate"))])


def _probability() -> tuple[Column, Column]:
    """The stated probability of fraud (null without one) and what came out."""
    return fraud_probability(F.col("decision"), F.col("confidence_score")), F.when(F.col("is_synthetic_fraud"), 1.0).otherwise(0.0)


def _brier() -> dict[str, Column]:
    p, o = _probability()
    return {"brier_score": F.round(F.avg((p - o) * (p - o)), 4), "n": F.count(p)}


def brier(decisions: DataFrame) -> DataFrame:
    return decisions.agg(*_named(_brier()))


def reliability(decisions: DataFrame, bins: int = BINS) -> DataFrame:
    """Mean prediction and fraud rate in equal bins; the last is closed, empty ones are left out."""
    i = sum(((F.col("p") >= k / bins).cast("int") for k in range(1, bins)), F.lit(0))
    label = F.element_at(F.array(*[F.lit(f"[{k / bins:.1f},{(k + 1) / bins:.1f})") for k in range(bins)]), i + 1)
    p, o = _probability()
    return decisions.select(p.alias("p"), o.alias("o")).where(F.col("p").between(0, 1)).groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 3).alias("mean_predicted"), F.round(F.avg("o"), 3).alias("observed_fraud_rate"))


def _judge_agreement() -> dict[str, Column]:
    judged, right = F.col("judge_score").isNotNull() & (F.col("decision") != "ESCALATE"), outcome_correct(F.col("decision"), F.col("is_synthetic_fraud"))
    good, bad = (F.avg(F.when(judged & c, F.col("judge_score"))) for c in (right, ~right))
    return {"mean_judge_on_correct": good, "mean_judge_on_incorrect": bad, "n_correct": F.count_if(judged & right), "n_incorrect": F.count_if(judged & ~right), "agreement_gap": good - bad}


def judge_agreement(decisions: DataFrame) -> DataFrame:
    """Mean judge score of right and wrong decisions and the gap; a judge that follows quality has a positive one."""
    return decisions.agg(*_named(_judge_agreement()))


def _costs() -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "mean_latency_ms": F.floor(F.sum("latency_ms") / F.count("latency_ms")), "mean_judge_score": F.avg("judge_score")}


def costs(decisions: DataFrame) -> DataFrame:
    """Whole-number mean latency and the mean judge score of judged rows."""
    return decisions.agg(*_named(_costs()))


def _figures(block: Column, columns: dict[str, Column]) -> Column:
    return F.array(*[F.struct(block.alias("block"), F.lit(name).alias("metric"), c.cast("double").alias("value")) for name, c in columns.items()])


def scorecard(decisions: DataFrame) -> DataFrame:
    """All figures as (block, metric, value).

    One aggregate over the decisions gives the blocks of all rows; patterns and bins, a block each, are two more.
    """
    blocks = {"classification": _confusion(), "escalation": _escalations(), "calibration": _brier(), "judge": _judge_agreement(), "cost": _costs()}
    rows = decisions.agg(F.concat(*[_figures(F.lit(block), columns) for block, columns in blocks.items()]).alias("figures")).select(F.inline("figures"))
    for prefix, df in (("pattern ", per_pattern(decisions)), ("reliability ", reliability(decisions))):
        key, *names = df.columns
        rows = rows.unionAll(df.select(F.inline(_figures(F.concat(F.lit(prefix), key), {n: F.col(n) for n in names}))))
    return rows


def trigger_table(rows: DataFrame, trigger: Column) -> DataFrame:
    """Rows and precision per exclusive cause of a flag."""
    return rows.groupBy(trigger.alias("trigger")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_synthetic_fraud").cast("double")).alias("precision"))


def rule_sweep(rows: DataFrame, jumps: Sequence[float]) -> DataFrame:
    """Flag rate, precision and recall if the distance rule began at each of these kilometres, in one pass."""
    fraud = F.coalesce("is_synthetic_fraud", F.lit(False))
    flagged = lambda km: F.col("other_hard") | F.coalesce(F.col("geo_km") >= km, F.lit(False))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(fraud).alias("fraud"), *[F.count_if(flagged(km)).alias(f"f{i}") for i, km in enumerate(jumps)], *[F.count_if(flagged(km) & fraud).alias(f"t{i}") for i, km in enumerate(jumps)])
    rules = F.explode(F.array(*[F.struct(F.lit(float(km)).alias("jump_km"), F.col(f"f{i}").alias("flagged"), F.col(f"t{i}").alias("hits")) for i, km in enumerate(jumps)])).alias("r")
    swept = counts.select("n", "fraud", rules).select("n", "fraud", "r.*")
    return swept.select("jump_km", "flagged", share(F.col("flagged"), F.col("n")).alias("flag_rate"), share(F.col("hits"), F.col("flagged")).alias("precision"), share(F.col("hits"), F.col("fraud")).alias("recall"))
