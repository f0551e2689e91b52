"""Column rules at their boundaries."""

import math

import pytest
from pyspark.sql import functions as F

from tallyward.functions import display, geo, governance, privacy, risk, validation


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_haversine(spark):
    rows = [(42.36, -71.06, 51.5074, -0.1278), (10.0, 10.0, 10.0, 10.0), (None, 0.0, 1.0, 1.0), (0.0, 0.0, 0.0, 180.0)]
    got = [v[0] for v in values(spark, "a double, b double, c double, d double", rows, geo.haversine_km(*map(F.col, "abcd")))]
    assert 5200 < got[0] < 5350 and got[1] == 0 and got[2] is None and got[3] == pytest.approx(math.pi * 6371)


@pytest.mark.parametrize(("km", "kmh", "fires"), [(5265.0, 7900.0, True), (5265.0, None, True), (1400.0, 58.0, False), (500.0, None, False), (2.0, 1440.0, False), (800.0, 800.0, False), (None, None, False), (3000.0, None, True), (100.0, 900.1, True)])
def test_impossible_travel(spark, km, kmh, fires):
    assert values(spark, "km double, kmh double", [(km, kmh)], geo.impossible_travel(F.col("km"), F.col("kmh"))) == [(fires,)]


def test_speed_needs_positive_time(spark):
    rows = [(5265.0, 40.0), (100.0, 0.0), (100.0, -5.0), (100.0, None), (None, 5.0)]
    got = [v[0] for v in values(spark, "km double, m double", rows, geo.implied_kmh(F.col("km"), F.col("m")))]
    assert got[0] == pytest.approx(7897.5) and got[1:] == [None] * 4


def test_score_weights(spark):
    rows = [(0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0), (0.8, 0.8, 0.8, 0.0), (1.0, 0.0, 0.0, 0.0)]
    s = {k: F.col(c) for k, c in zip(("velocity", "amount", "geo", "device"), "abcd", strict=True)}
    assert [v[0] for v in values(spark, "a double, b double, c double, d double", rows, risk.score(s))] == [0.0, 1.0, 0.64, 0.3]


def test_validation(spark):
    rows = [(40.0, None), (float("nan"), None), (-1.0, None), (float("inf"), "GEO_JUMP"), (1.0, "TELEPORT"), (None, "NONE")]
    got = [v[0] for v in values(spark, "x double, p string", rows, validation.transaction_error(F.col("x"), F.col("p")))]
    assert got == [None, "amount_not_finite", "amount_negative", "amount_not_finite", "pattern_unknown", None]
    rows = [("ALLOW", None), ("ESCALATE", None), ("BLOCK", 1.01), ("MAYBE", 0.5), ("BLOCK", 1.0), (None, 0.5)]
    got = [v[0] for v in values(spark, "d string, c double", rows, validation.decision_error(F.col("d"), F.col("c")))]
    assert got == ["confidence_missing", None, "confidence_not_probability", "decision_unknown", None, "decision_unknown"]


def test_tiers(spark):
    rows = [("ESCALATE", 0.99, 1.0), ("ALLOW", None, 1.0), ("ALLOW", 0.74, 1.0), ("BLOCK", 0.75, 1.0), ("ALLOW", 0.75, 500.0), ("ALLOW", 0.75, 500.01)]
    got = [v[0] for v in values(spark, "d string, c double, a double", rows, governance.autonomy_tier(*map(F.col, "dca")))]
    assert got == ["SUGGEST", "SUGGEST", "SUGGEST", "NOTIFY_ONLY", "AUTO_APPROVE", "NOTIFY_ONLY"]


def test_conditions(spark):
    texts = ["$step_1.count >= 20", "$trigger.kind == 'a b'", "$x > 1", "$step_1.n > 2 and x", "$step_2 != true", None]
    got = values(spark, "t string", [(t,) for t in texts], governance.condition_parts(F.col("t")).alias("c"))
    assert [g[0] and tuple(g[0]) for g in got] == [("$step_1.count", ">=", "20"), ("$trigger.kind", "==", "a b"), None, None, ("$step_2", "!=", "true"), None]
    rows = [("25", ">=", "20"), ("abc", ">", "3"), ("abc", "==", "abc"), (None, "<", "1")]
    assert [v[0] for v in values(spark, "l string, o string, r string", rows, governance.compare(*map(F.col, "lor")))] == [True, None, True, None]


def test_patterns_and_errors(spark):
    got = values(spark, "e string, l string", [("geo_jump, new_device", "NONE"), (None, "geo_jump"), (" ,", None)], governance.surfaced_patterns(F.col("e"), F.col("l")))
    assert [g[0] for g in got] == [["GEO_JUMP", "NEW_DEVICE"], ["GEO_JUMP"], []]
    got = values(spark, "m string", [("invalid login: connection lost",), ("read timed out",), ("odd",), (None,)], governance.error_class(F.col("m")))
    assert [g[0] for g in got] == ["PERMANENT", "TRANSIENT", "PERMANENT", "PERMANENT"]


def test_redaction(spark):
    body = '{"Full_Name": "Ann", "a": [{"email": "x@y", "n": 1}], "in": "{\\"name\\": \\"Bob\\"}"}'
    got = values(spark, "j string", [(body,), ("no json",), (None,)], privacy.redact_json(F.col("j")))
    assert "Ann" not in got[0][0] and "x@y" not in got[0][0] and "Bob" not in got[0][0] and '"n": 1' in got[0][0]
    assert got[1:] == [("no json",), (None,)]
    steps = spark.createDataFrame([(1, "Annabel met Ann"), (2, "Ann")], "t int, s string")
    found = spark.createDataFrame([(1, "Ann"), (1, "Annabel")], "t int, value string")
    out = {r.t: r.s for r in privacy.scrub_traces(steps, "t", "s", found).collect()}
    assert "Ann" not in out[1] and out[2] == "Ann"


def test_display(spark):
    rows = [(0.4567, 1234567, True, None)]
    got = values(spark, "r double, n bigint, b boolean, x string", rows, display.shown("fraud_rate", "double", F.col("r")), display.shown("n", "bigint", F.col("n")), display.shown("b", "boolean", F.col("b")), display.shown("x", "string", F.col("x")))
    assert got == [("45.67%", "1,234,567", "yes", "—")]
