"""Registered queries of the engine and, for each, SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions import display, geo, governance, privacy, risk, validation
from tallyward.operators import enrichment, evaluation, indexes, location, reports, retrieval, velocity, warehouse
from tallyward.plans import guard
from tallyward.plans import reports as named
from tallyward.sources import io
from tallyward.sources.tables import BASELINES_SQL, CITIES_SQL, DECISIONS_SQL, TRANSACTIONS_SQL, bad_transactions, baselines, city_part, decisions, table, transactions, trusted_devices

QUERIES: dict = {}
ORACLES: dict = {}

TX, BASE, DEC = TRANSACTIONS_SQL, BASELINES_SQL, DECISIONS_SQL
TRUSTED = "trusted AS (SELECT DISTINCT user_id, device_id FROM tx WHERE device_id % 10 < 2)"
TRAIL = """trail AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY transaction_ts RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) AS velocity_15min FROM tx)"""
KM = "CASE WHEN {0} IS NOT NULL THEN 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))) END"
LAGGED = """lagged AS (SELECT *, lag(latitude) OVER w AS prev_lat, lag(longitude) OVER w AS prev_lon, lag(city) OVER w AS prev_city, lag(transaction_ts) OVER w AS prev_ts
  FROM trail WINDOW w AS (PARTITION BY user_id ORDER BY transaction_ts, transaction_id))"""
#: One step of the guarded fold per recursion: base_* is what row n is compared with.
GUARDED = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY transaction_ts, transaction_id) AS n FROM trail),
fold AS (
  SELECT user_id, n, transaction_id, CAST(NULL AS DOUBLE) AS prev_lat, CAST(NULL AS DOUBLE) AS prev_lon, CAST(NULL AS VARCHAR) AS prev_city, CAST(NULL AS TIMESTAMP) AS prev_ts,
         latitude AS b_lat, longitude AS b_lon, city AS b_city, transaction_ts AS b_ts FROM numbered WHERE n = 1
  UNION ALL
  SELECT user_id, n, transaction_id, b_lat, b_lon, b_city, b_ts,
         CASE WHEN bad THEN b_lat ELSE latitude END, CASE WHEN bad THEN b_lon ELSE longitude END, CASE WHEN bad THEN b_city ELSE city END, CASE WHEN bad THEN b_ts ELSE transaction_ts END
  FROM (SELECT s.user_id, s.n, s.transaction_id, s.latitude, s.longitude, s.city, s.transaction_ts, f.b_lat, f.b_lon, f.b_city, f.b_ts,
               (epoch_us(s.transaction_ts) - epoch_us(f.b_ts)) > 0 AND (km >= 3000 OR km >= 100 AND km / ((epoch_us(s.transaction_ts) - epoch_us(f.b_ts)) / 3600000000.0::DOUBLE) > 900) AS bad
        FROM fold f JOIN numbered s ON s.user_id = f.user_id AND s.n = f.n + 1, LATERAL (SELECT {KM.format("f.b_lat", "f.b_lon", "s.latitude", "s.longitude")} AS km) x)),
lagged AS (SELECT trail.*, prev_lat, prev_lon, prev_city, prev_ts FROM trail JOIN fold USING (transaction_id))"""
SCORED = f"""travel AS (SELECT *, {KM.format("prev_lat", "prev_lon", "latitude", "longitude")} AS km0, (epoch_us(transaction_ts) - epoch_us(prev_ts)) / 60000000.0::DOUBLE AS min0 FROM lagged),
moved AS (SELECT *, CASE WHEN min0 <= 0 THEN NULL ELSE km0 END AS km, CASE WHEN min0 <= 0 THEN NULL ELSE min0 END AS mins FROM travel),
joined AS (SELECT m.*, b.avg_amount, b.stddev_amount, t.device_id IS NULL AS is_new_device,
                  coalesce(km >= 3000 OR (km >= 100 AND mins > 0 AND km / (mins / 60.0) > 900), false) AS suspect_location
           FROM moved m LEFT JOIN base b USING (user_id) LEFT JOIN trusted t ON t.user_id = m.user_id AND t.device_id = m.device_id),
sig AS (SELECT *, CASE WHEN stddev_amount > 0 THEN (amount - avg_amount) / stddev_amount ELSE 0 END AS z FROM joined),
sigs AS (SELECT *, least(velocity_15min / 5.0::DOUBLE, 1.0) AS s_v, least(abs(z) / 3.0, 1.0) AS s_a, least(coalesce(km, 0.0) / 500.0, 1.0) AS s_g, CASE WHEN is_new_device THEN 1.0 ELSE 0.0 END::DOUBLE AS s_d FROM sig),
scored AS (SELECT *, round(least(s_v * 0.3::DOUBLE + s_a * 0.25::DOUBLE + s_g * 0.25::DOUBLE + s_d * 0.2::DOUBLE, 1.0), 4) AS risk FROM sigs),
flagged AS (SELECT *, risk > 0.6 OR suspect_location OR s_a >= 0.95 OR s_v >= 1.0 AS flag FROM scored)"""
FEATURES = "SELECT transaction_id, user_id, velocity_15min, round(z, 4) AS amount_zscore, prev_city AS prev_transaction_city, round(nullif(km, 0), 2) AS geo_distance_km, round(nullif(mins, 0), 2) AS time_since_last_txn_min, is_new_device, suspect_location, risk AS risk_score_raw, flag AS is_flagged_for_review FROM flagged"


def sql(select: str, *ctes: str) -> str:
    recursive = "RECURSIVE " if any("UNION ALL\n" in c for c in ctes) else ""
    return f"WITH {recursive}{', '.join(ctes)} {select}" if ctes else select


def query(oracle: str | None, *ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle, *ctes)
        return f

    return register


def feature_rows(spark: SparkSession, d: str, guarded: bool) -> DataFrame:
    tx = transactions(spark, d)
    return as_snapshots(enrichment.features(tx, baselines(tx), trusted_devices(tx), guarded))


def as_snapshots(rows: DataFrame) -> DataFrame:
    return rows.select("transaction_id", "user_id", "velocity_15min", "amount_zscore", "prev_transaction_city", "geo_distance_km", "time_since_last_txn_min", "is_new_device", "suspect_location", "risk_score_raw", "is_flagged_for_review")


# ---- features and scores


@query(FEATURES, TX, BASE, TRUSTED, TRAIL, GUARDED, SCORED)
def feature_snapshots(spark, d):
    """Flagship: one scored feature row per transaction, with the guarded last place."""
    return feature_rows(spark, d, True)


@query(FEATURES, TX, BASE, TRUSTED, TRAIL, LAGGED, SCORED)
def feature_snapshots_lag(spark, d):
    """The same with the plain last place."""
    return feature_rows(spark, d, False)


@query("SELECT transaction_id, prev_city, prev_ts FROM lagged", TX, TRAIL, GUARDED)
def guarded_locations(spark, d):
    return location.with_guarded(transactions(spark, d)).select("transaction_id", "prev_city", F.col("prev_ts").cast("timestamp_ntz").alias("prev_ts"))


@query("SELECT transaction_id, prev_city, prev_ts FROM lagged", TX, TRAIL, LAGGED)
def previous_locations(spark, d):
    return location.with_lag(transactions(spark, d)).select("transaction_id", "prev_city", F.col("prev_ts").cast("timestamp_ntz").alias("prev_ts"))


@query(f"SELECT transaction_id, round({KM.format('prev_lat', 'prev_lon', 'latitude', 'longitude')}, 3) AS km FROM lagged", TX, TRAIL, LAGGED)
def travel_distances(spark, d):
    t = location.with_lag(transactions(spark, d))
    return t.select("transaction_id", F.round(geo.haversine_km(*map(F.col, ("prev_lat", "prev_lon", "latitude", "longitude"))), 3).alias("km"))


@query(f"SELECT transaction_id, round(CASE WHEN m > 0 THEN km / (m / 60.0) END, 2) AS kmh, coalesce(km >= 3000 OR (m > 0 AND km / (m / 60.0) > 900 AND km >= 100), false) AS impossible FROM (SELECT transaction_id, {KM.format('prev_lat', 'prev_lon', 'latitude', 'longitude')} AS km, (epoch_us(transaction_ts) - epoch_us(prev_ts)) / 60000000.0::DOUBLE AS m FROM lagged)", TX, TRAIL, LAGGED)
def implied_speeds(spark, d):
    t = location.with_lag(transactions(spark, d))
    km, m = geo.haversine_km(*map(F.col, ("prev_lat", "prev_lon", "latitude", "longitude"))), geo.minutes_between(F.col("prev_ts"), F.col("transaction_ts"))
    t = t.select("transaction_id", km.alias("km"), geo.implied_kmh(km, m).alias("kmh"))
    return t.select("transaction_id", F.round("kmh", 2).alias("kmh"), geo.impossible_travel(F.col("km"), F.col("kmh")).alias("impossible"))


@query("SELECT transaction_id, round(CASE WHEN stddev_amount > 0 THEN (amount - avg_amount) / stddev_amount ELSE 0 END, 4) AS z FROM tx JOIN base USING (user_id)", TX, BASE)
def amount_zscores(spark, d):
    tx = transactions(spark, d)
    return tx.join(baselines(tx), "user_id").select("transaction_id", F.round(risk.zscore(F.col("amount"), F.col("avg_amount"), F.col("stddev_amount")), 4).alias("z"))


@query("SELECT tx.transaction_id, t.device_id IS NULL AS is_new_device FROM tx LEFT JOIN trusted t ON t.user_id = tx.user_id AND t.device_id = tx.device_id", TX, TRUSTED)
def new_devices(spark, d):
    tx = transactions(spark, d)
    return enrichment.new_device(tx, trusted_devices(tx)).select("transaction_id", "is_new_device")


@query("SELECT DISTINCT tx.user_id, tx.device_id FROM tx WHERE NOT EXISTS (SELECT 1 FROM trusted t WHERE t.user_id = tx.user_id AND t.device_id = tx.device_id)", TX, TRUSTED)
def untrusted_devices(spark, d):
    tx = transactions(spark, d)
    return tx.select("user_id", "device_id").distinct().join(trusted_devices(tx), ["user_id", "device_id"], "left_anti")


@query("SELECT user_id, round(avg_amount, 6) AS avg_amount, round(stddev_amount, 6) AS stddev_amount FROM base", TX, BASE)
def user_baselines(spark, d):
    return baselines(transactions(spark, d)).select("user_id", F.round("avg_amount", 6).alias("avg_amount"), F.round("stddev_amount", 6).alias("stddev_amount"))


@query("SELECT user_id, count(*) AS n_devices, string_agg(device_id::VARCHAR, ',' ORDER BY device_id) AS devices FROM trusted GROUP BY user_id", TX, TRUSTED)
def trusted_device_sets(spark, d):
    t = trusted_devices(transactions(spark, d)).groupBy("user_id").agg(F.sort_array(F.collect_set("device_id")).alias("s"))
    return t.select("user_id", F.size("s").cast("bigint").alias("n_devices"), F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("devices"))


# ---- velocity


@query("SELECT transaction_id, velocity_15min FROM trail", TX, TRAIL)
def trailing_velocity(spark, d):
    return velocity.trailing(transactions(spark, d), "15min").select("transaction_id", "velocity_15min")


@query("SELECT transaction_id, " + ", ".join(f"count(*) OVER (PARTITION BY user_id ORDER BY transaction_ts RANGE BETWEEN INTERVAL {s} SECONDS PRECEDING AND CURRENT ROW) AS velocity_{n}" for n, s in velocity.SECONDS.items()) + " FROM tx", TX)
def trailing_velocity_all(spark, d):
    return velocity.trailing(transactions(spark, d), *velocity.SECONDS).select("transaction_id", *[f"velocity_{n}" for n in velocity.SECONDS])


def _windows(name: str, length: int, slide: int) -> str:
    first = f"(epoch_us(transaction_ts) // {slide * 1_000_000}) * {slide}"
    return f"SELECT '{name}' AS window_name, user_id, make_timestamp(s * 1000000) AS window_start, make_timestamp((s + {length}) * 1000000) AS window_end, count(*) AS n FROM (SELECT user_id, unnest(generate_series({first} - {length} + {slide}, {first}, {slide})) AS s FROM tx) GROUP BY ALL"


SLIDES = {"5min": 60, "15min": 60, "1hr": 300, "24hr": 1800}


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("SELECT * EXCLUDE (window_name) FROM (" + _windows("15min", 900, 60) + ")", TX)
def sliding_velocity(spark, d):
    return _ntz(velocity.paned(transactions(spark, d)))


@query(" UNION ALL ".join(f"({_windows(n, velocity.SECONDS[n], s)})" for n, s in SLIDES.items()), TX)
def sliding_velocity_all(spark, d):
    return _ntz(velocity.sliding_all(transactions(spark, d)))


@query("SELECT user_id, arg_max(velocity_15min, row(transaction_ts, transaction_id)) AS velocity_15min, arg_max(velocity_15min, row(transaction_ts, transaction_id)) > 5 AS flagged FROM trail GROUP BY user_id", TX, TRAIL)
def velocity_flags(spark, d):
    return velocity.flagged_users(transactions(spark, d))


# ---- checks and quarantine

BAD = "bad AS (SELECT * REPLACE (CASE WHEN transaction_id % 97 = 0 THEN 'NaN'::DOUBLE WHEN transaction_id % 89 = 0 THEN -1.0 ELSE amount END AS amount, CASE WHEN transaction_id % 83 = 0 THEN 'TELEPORT' ELSE fraud_pattern END AS fraud_pattern) FROM tx)"
BAD_REASON = "CASE WHEN isnan(amount) OR isinf(amount) THEN 'amount_not_finite' WHEN amount < 0 THEN 'amount_negative' WHEN fraud_pattern NOT IN ('VELOCITY_SPIKE', 'AMOUNT_ANOMALY', 'GEO_JUMP', 'NEW_DEVICE', 'NONE') THEN 'pattern_unknown' END"


@query(f"SELECT transaction_id, {BAD_REASON} AS error_reason FROM bad WHERE {BAD_REASON} IS NOT NULL", TX, BAD)
def quarantine(spark, d):
    _, bad = validation.split_quarantine(bad_transactions(spark, d), validation.transaction_error(F.col("amount"), F.col("fraud_pattern")))
    return bad.select("transaction_id", "error_reason")


@query(f"SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(*) FILTER (WHERE {BAD_REASON} IS NOT NULL) AS n_quarantined, count(*) FILTER (WHERE {BAD_REASON} IS NULL AND amount > 400) AS n_large FROM bad", TX, BAD)
def batch_counters(spark, d):
    e = bad_transactions(spark, d).withColumn("e", validation.transaction_error(F.col("amount"), F.col("fraud_pattern")))
    return e.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.count_if(F.col("e").isNotNull()).alias("n_quarantined"), F.count_if(F.col("e").isNull() & (F.col("amount") > 400)).alias("n_large"))


@query("""SELECT decision_id, CASE WHEN confidence_score IS NULL AND decision <> 'ESCALATE' THEN 'confidence_missing' WHEN confidence_score > 0.97 THEN 'confidence_not_probability' END AS error_reason
  FROM dec WHERE (confidence_score IS NULL AND decision <> 'ESCALATE') OR confidence_score > 0.97""", TX, DEC)
def decision_errors(spark, d):
    c = F.when(F.col("confidence_score") > 0.97, F.col("confidence_score") + 1).otherwise(F.col("confidence_score"))
    return decisions(spark, d).select("decision_id", validation.decision_error(F.col("decision"), c).alias("error_reason")).where("error_reason is not null")


TEXT = "CASE WHEN event_id % 7 = 0 THEN 'broken {' WHEN event_id % 11 = 0 THEN '{}' END"


@query("SELECT event_id::VARCHAR AS transaction_id, user_id::VARCHAR AS user_id, value AS amount, ts AS transaction_ts FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def parsed_events(spark, d):
    e = table(spark, d, "events")
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("user_id"), F.col("value").alias("amount"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("transaction_ts")))
    raw = e.select(F.when(F.col("event_id") % 7 == 0, "broken {").when(F.col("event_id") % 11 == 0, "{}").otherwise(body).alias("value"))
    return io.parse_events(raw).select("transaction_id", "user_id", "amount", F.col("transaction_ts").cast("timestamp_ntz").alias("transaction_ts"))


# ---- governance and traces


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN 'SUGGEST' WHEN o_orderkey % 13 = 0 OR 0.5::DOUBLE + (o_orderkey % 50) / 100.0::DOUBLE < 0.75 THEN 'SUGGEST' WHEN o_orderkey % 10 >= 6 THEN 'NOTIFY_ONLY' WHEN o_totalprice / 200 <= 500 THEN 'AUTO_APPROVE' ELSE 'NOTIFY_ONLY' END AS tier FROM orders")
def autonomy_tiers(spark, d):
    k = F.col("o_orderkey")
    decision = F.when(k % 10 < 6, "ALLOW").when(k % 10 < 9, "BLOCK").otherwise("ESCALATE")
    return table(spark, d, "orders").select("o_orderkey", governance.autonomy_tier(decision, F.when(k % 13 != 0, 0.5 + (k % 50) / F.lit(100.0)), F.col("o_totalprice") / 200).alias("tier"))


@query("SELECT decision_id, CASE WHEN decision <> 'ESCALATE' THEN (decision = 'BLOCK') = is_synthetic_fraud END AS correct, round(CASE decision WHEN 'BLOCK' THEN confidence_score WHEN 'ALLOW' THEN 1 - confidence_score END, 6) AS p_fraud FROM dec", TX, DEC)
def decision_outcomes(spark, d):
    return decisions(spark, d).select("decision_id", governance.outcome_correct(F.col("decision"), F.col("is_synthetic_fraud")).alias("correct"), F.round(governance.fraud_probability(F.col("decision"), F.col("confidence_score")), 6).alias("p_fraud"))


@query("SELECT decision_id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN elevated_patterns IS NULL THEN [] ELSE [upper(split_part(elevated_patterns, ', ', 1)), 'GEO_JUMP'] END, [identified_pattern]))), ',') AS surfaced FROM dec", TX, DEC)
def surfaced(spark, d):
    return decisions(spark, d).select("decision_id", F.array_join(governance.surfaced_patterns(F.col("elevated_patterns"), F.col("identified_pattern")), ",").alias("surfaced"))


@query("SELECT c_custkey, '[REDACTED:' || substr(sha256(c_name), 1, 12) || ']' AS who FROM customer")
def pseudonyms(spark, d):
    return table(spark, d, "customer").select("c_custkey", privacy.pseudonym(F.col("c_name")).alias("who"))


@query("""SELECT c_custkey, '[REDACTED:' || substr(sha256(c_name), 1, 12) || ']' AS who, c_mktsegment AS segment, '[REDACTED:' || substr(sha256(c_custkey::VARCHAR), 1, 12) || ']' AS phone FROM customer""")
def redacted_profiles(spark, d):
    inner = F.to_json(F.struct(F.col("c_custkey").alias("phone")))
    body = F.to_json(F.struct(F.col("c_name").alias("full_name"), F.struct(F.col("c_mktsegment").alias("segment"), inner.alias("note")).alias("detail")))
    r = table(spark, d, "customer").select("c_custkey", privacy.redact_json(body).alias("j"))
    return r.select("c_custkey", F.get_json_object("j", "$.full_name").alias("who"), F.get_json_object("j", "$.detail.segment").alias("segment"), F.get_json_object(F.get_json_object("j", "$.detail.note"), "$.phone").alias("phone"))


FIRST = "regexp_extract(text, '[A-Za-z]{4,}', 0)"


@query(f"""SELECT c.conv_id, c.turn, CASE WHEN f.value = '' THEN c.text ELSE replace(c.text, f.value, '[REDACTED:' || substr(sha256(f.value), 1, 12) || ']') END AS text
  FROM conversations c JOIN (SELECT conv_id, {FIRST} AS value FROM conversations WHERE turn = 0) f USING (conv_id)""")
def scrubbed_traces(spark, d):
    """The first longer word of a conversation stands for a person's name, hidden wherever the conversation has it."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    names = c.where("turn = 0").select("conv_id", F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("value"))
    return privacy.scrub_traces(c.join(names.select("conv_id").distinct(), "conv_id", "left_semi"), "conv_id", "text", names)


@query(None)
def scrubbed_overlaps(spark, d):
    """Every conversation's first words, and the pairs and runs of three that they make, hidden wherever they stand: values that overlap."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    w = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: F.length(x) > 2), 1, 4)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(w, lambda _, i: F.array_join(F.slice(w, i + 1, n), " "))))
    values = c.where("turn <= 1").select("conv_id", F.explode(runs).alias("value"))
    return privacy.scrub_traces(c, "conv_id", "text", values)


@query("SELECT conv_id AS decision_id, turn AS step_number, CASE role WHEN 'user' THEN 'INPUT' WHEN 'assistant' THEN CASE WHEN turn % 4 = 3 THEN 'HANDOFF' ELSE 'REASONING' END WHEN 'tool' THEN 'TOOL_OUTPUT' ELSE 'OTHER' END AS step_type, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN CASE WHEN turn % 4 = 3 THEN 'orchestrator' ELSE 'single_agent' END ELSE 'single_agent' END AS agent_name, len(text)::BIGINT AS n FROM conversations")
def trace_rows(spark, d):
    c = table(spark, d, "conversations")
    name = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), "orchestrator")
    kind = governance.step_type(F.col("role"), F.lit(False), name)
    payload = F.parse_json(F.to_json(F.struct(F.length("text").alias("n"))))
    return c.select(F.col("conv_id").alias("decision_id"), F.col("turn").alias("step_number"), kind.alias("step_type"), F.coalesce(name, F.when(kind == "INPUT", "user").otherwise("single_agent")).alias("agent_name"), F.variant_get(payload, "$.n", "bigint").alias("n"))


ERRORS = ("Connection reset by peer", "invalid credentials: connection closed", "HTTP 503 Service Unavailable", "division by zero", "rate limit exceeded", "permission denied")
CLASSES = ("TRANSIENT", "PERMANENT", "TRANSIENT", "PERMANENT", "TRANSIENT", "PERMANENT")


@query("SELECT event_id, CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END AS error_class FROM events")
def error_classes(spark, d):
    message = F.element_at(F.array(*map(F.lit, ERRORS)), (F.col("event_id") % len(ERRORS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", governance.error_class(message).alias("error_class"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN value >= 20 WHEN 1 THEN event_type = 'click' WHEN 2 THEN NULL ELSE user_id < 50 END AS holds FROM events")
def conditions(spark, d):
    when = F.element_at(F.array(F.lit("$step_1.value >= 20"), F.lit("$trigger.kind == 'click'"), F.lit("$step_1.value > 2 and more"), F.lit("$trigger.user < 50")), (F.col("event_id") % 4 + 1).cast("int"))
    left = F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).when(F.col("event_id") % 4 == 1, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    e = table(spark, d, "events").select("event_id", left.alias("l"), governance.condition_parts(when).alias("c"))
    return e.select("event_id", governance.compare(F.col("l"), F.col("c.op"), F.col("c.literal")).alias("holds"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H') WHEN 1 THEN strftime(ts, '%G-W%V') ELSE strftime(ts, '%Y-%m-%d') END AS period, CASE event_id % 3 WHEN 0 THEN ts - INTERVAL 1 HOUR WHEN 1 THEN ts - INTERVAL 7 DAY ELSE ts - INTERVAL 1 DAY END AS window_start FROM events")
def report_periods(spark, d):
    e = table(spark, d, "events").withColumn("f", F.element_at(F.array(F.lit("hourly"), F.lit("weekly"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int")))
    return e.select("event_id", display.period_key(F.col("ts"), F.col("f")).alias("period"), display.period_start(F.col("ts"), F.col("f")).cast("timestamp_ntz").alias("window_start"))


@query("SELECT event_id, format('{:,}', event_id) AS shown_count, printf('%.2f%%', user_id / 1000.0::DOUBLE * 100) AS shown_rate, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS shown_flag, CASE WHEN event_id % 5 = 0 THEN '—' ELSE event_type END AS shown_text FROM events")
def display_values(spark, d):
    e = table(spark, d, "events")
    show = display.shown
    return e.select("event_id", show("n", "bigint", F.col("event_id")).alias("shown_count"), show("fraud_rate", "double", F.col("user_id") / F.lit(1000.0)).alias("shown_rate"), show("ok", "boolean", F.col("event_id") % 2 == 0).alias("shown_flag"), show("t", "string", F.when(F.col("event_id") % 5 != 0, F.col("event_type"))).alias("shown_text"))


# ---- joins, history and upserts


@query("SELECT d.decision_id, d.decision, s.is_synthetic_fraud FROM dec d LEFT JOIN (SELECT * FROM tx WHERE transaction_id % 9 <> 0) s ON d.snapshot_id = s.transaction_id", TX, DEC)
def decisions_with_snapshots(spark, d):
    s = transactions(spark, d).where("transaction_id % 9 <> 0").select(F.col("transaction_id").alias("snapshot_id"), F.col("is_synthetic_fraud").alias("fraud"))
    return decisions(spark, d).join(s, "snapshot_id", "left").select("decision_id", "decision", F.col("fraud").alias("is_synthetic_fraud"))


@query("SELECT d.decision, t.country, count(*) AS n, round(avg(d.confidence_score), 6) AS mean_confidence FROM dec d JOIN tx t USING (transaction_id) GROUP BY ALL", TX, DEC)
def decisions_by_country(spark, d):
    joined = decisions(spark, d).select("transaction_id", "decision", "confidence_score").join(transactions(spark, d).select("transaction_id", "country"), "transaction_id")
    return joined.groupBy("decision", "country").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence_score"), 6).alias("mean_confidence"))


@query("""SELECT o_orderkey, o_custkey, version FROM orders JOIN (
  SELECT c_custkey, 1 AS version, DATE '1970-01-01' AS valid_from, DATE '1998-01-01' AS valid_to FROM customer
  UNION ALL SELECT c_custkey, 2, DATE '1998-01-01', DATE '9999-12-31' FROM customer) h ON c_custkey = o_custkey AND valid_from <= o_orderdate AND valid_to > o_orderdate""")
def orders_as_of(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    day = lambda x: F.lit(x).cast("date")
    history = c.select("o_custkey", F.explode(F.array(F.struct(F.lit(1).alias("version"), day("1970-01-01").alias("valid_from"), day("1998-01-01").alias("valid_to")), F.struct(F.lit(2).alias("version"), day("1998-01-01").alias("valid_from"), day("9999-12-31").alias("valid_to")))).alias("v")).select("o_custkey", "v.*")
    orders = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return warehouse.as_of(orders, history, "o_custkey", "day").select("o_orderkey", "o_custkey", "version")


STAGING = "staged AS (SELECT event_id, user_id, value, ts AS computed_at FROM events UNION ALL SELECT event_id, user_id, value + 1, ts + INTERVAL 1 HOUR FROM events WHERE event_id % 3 = 0)"


def _staged(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp_ntz").alias("computed_at"))
    again = e.where("event_id % 3 = 0").select("event_id", "user_id", (F.col("value") + 1).alias("value"), (F.col("computed_at") + F.expr("INTERVAL 1 HOUR")).alias("computed_at"))
    return e, again


@query("SELECT event_id, user_id, value, computed_at FROM staged QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY computed_at DESC NULLS LAST, value DESC) = 1", STAGING)
def latest_versions(spark, d):
    e, again = _staged(spark, d)
    return warehouse.latest_version(e.unionByName(again), "event_id", "computed_at", "value")


@query("SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS value, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS computed_at FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def upserted(spark, d):
    e, again = _staged(spark, d)
    return warehouse.upsert(e.where("event_id % 2 = 0"), again.unionByName(again), "event_id", "computed_at", "value")


@query("SELECT event_id, user_id, value, computed_at, r.inserted, r.replaced FROM (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY computed_at DESC NULLS LAST, value DESC) = 1 UNION ALL SELECT event_id, user_id, value, ts FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 0), (SELECT count(*) FILTER (WHERE event_id % 2 <> 0) AS inserted, count(*) FILTER (WHERE event_id % 2 = 0) AS replaced FROM events WHERE event_id % 3 = 0) r", "staged AS (SELECT event_id, user_id, value + 1 AS value, ts + INTERVAL 1 HOUR AS computed_at FROM events WHERE event_id % 3 = 0)")
def merged_facts(spark, d):
    """A stored fact table after staged rows, some of them twice, are merged into the buckets they touch, and then again; with the first merge's counts."""
    e, again = _staged(spark, d)
    folder = io.shared_folder(spark, "facts")
    warehouse.create_facts(e.where("event_id % 2 = 0"), f"{folder}/facts", "event_id")
    merge = lambda: warehouse.merge_staged(spark, f"{folder}/staging", f"{folder}/facts", "event_id", "computed_at", "value")
    warehouse.stage(again, f"{folder}/staging")
    warehouse.stage(again, f"{folder}/staging")
    inserted, replaced = merge()
    warehouse.stage(again, f"{folder}/staging")  # a replay
    merge()
    return spark.read.parquet(f"{folder}/facts").select("event_id", "user_id", "value", "computed_at", F.lit(inserted).cast("bigint").alias("inserted"), F.lit(replaced).cast("bigint").alias("replaced"))


@query("SELECT decision_id, human_reviewed OR decision_id % 4 = 0 AS human_reviewed, decision_id % 4 = 0 AND human_reviewed AS review_conflict, CASE WHEN decision_id % 4 = 0 AND NOT human_reviewed THEN 'ann' END AS reviewer FROM dec", TX, DEC)
def reviewed(spark, d):
    dec = decisions(spark, d)
    verdicts = dec.where("decision_id % 4 = 0").select("decision_id", F.lit("ann").alias("reviewer"), F.lit("ALLOW").alias("human_decision"))
    return warehouse.review(dec, verdicts.unionByName(verdicts.withColumn("reviewer", F.lit("bob")))).select("decision_id", "human_reviewed", "review_conflict", "reviewer")


@query("SELECT decision_id, CASE WHEN decision_id % 6 = 0 THEN 0.5 ELSE judge_score END AS judge_score FROM dec", TX, DEC)
def annotated(spark, d):
    dec = decisions(spark, d)
    return warehouse.annotate(dec, dec.where("decision_id % 6 = 0").select("decision_id", F.lit(0.5).alias("judge_score")), "decision_id").select("decision_id", "judge_score")


@query("SELECT r_regionkey, r_name, NULL::VARCHAR AS note FROM region")
def widened_regions(spark, d):
    return warehouse.widened(table(spark, d, "region").select("r_regionkey", "r_name"), note="string", r_name="string")


@query(f"SELECT user_id, i AS city FROM (SELECT DISTINCT user_id FROM tx) u JOIN (SELECT i AS h, lat AS hlat, lon AS hlon FROM {CITIES_SQL}) ON h = user_id % 10 JOIN {CITIES_SQL} ON {KM.format('hlat', 'hlon', 'lat', 'lon')} >= 5000", TX)
def far_cities(spark, d):
    people = transactions(spark, d).select("user_id").distinct()
    home = F.col("user_id") % 10
    return location.far_cities(people.select("user_id", city_part(home, "lat").alias("home_latitude"), city_part(home, "lon").alias("home_longitude")))


@query("SELECT user_id, transaction_id, city, amount FROM tx QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY transaction_ts DESC, transaction_id) = 1", TX)
def latest_per_user(spark, d):
    return io.latest_by_key(transactions(spark, d), "user_id", "transaction_ts", "transaction_id").select("user_id", "transaction_id", "city", "amount")


@query("SELECT user_id FROM tx WHERE amount > 100 EXCEPT SELECT user_id FROM tx WHERE country <> 'US' UNION SELECT user_id FROM tx WHERE is_synthetic_fraud INTERSECT SELECT user_id FROM tx WHERE amount > 200", TX)
def user_sets(spark, d):
    t = transactions(spark, d)
    u = lambda c: t.where(c).select("user_id")
    return u("amount > 100").subtract(u("country <> 'US'")).union(u("is_synthetic_fraud").intersect(u("amount > 200"))).distinct()


# ---- evaluation


CONFUSION = """SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS false_positive_rate,
  2.0 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / ((tp / nullif(tp + fp, 0)) + (tp / nullif(tp + fn, 0))) AS f1
  FROM (SELECT count(*) FILTER (WHERE decision = 'BLOCK' AND is_synthetic_fraud) AS tp, count(*) FILTER (WHERE decision = 'BLOCK' AND NOT is_synthetic_fraud) AS fp,
               count(*) FILTER (WHERE decision = 'ALLOW' AND is_synthetic_fraud) AS fn, count(*) FILTER (WHERE decision = 'ALLOW' AND NOT is_synthetic_fraud) AS tn FROM dec)"""


@query(CONFUSION, TX, DEC)
def confusion(spark, d):
    return evaluation.confusion(decisions(spark, d))


ESCALATIONS = "SELECT count(*) FILTER (WHERE decision = 'ESCALATE') / nullif(count(*), 0) AS escalation_rate, count(*) FILTER (WHERE decision = 'ESCALATE') AS escalations, count(*) FILTER (WHERE decision = 'ESCALATE') * 1.0::DOUBLE AS escalation_cost FROM dec"


@query(ESCALATIONS, TX, DEC)
def escalations(spark, d):
    return evaluation.escalations(decisions(spark, d))


SEEN = "coalesce(elevated_patterns LIKE '%' || lower(fraud_pattern) || ',%' OR (elevated_patterns IS NOT NULL AND fraud_pattern = 'GEO_JUMP'), false) OR identified_pattern = fraud_pattern"


PER_PATTERN = f"""SELECT *, caught / n AS recall, primary_correct / n AS pattern_id_accuracy, detected / n AS detection_rate, mislabeled / n AS mislabeled_rate, missed / n AS missed_rate FROM (
  SELECT fraud_pattern AS pattern, count(*) AS n, count(*) FILTER (WHERE decision <> 'ALLOW') AS caught, count(*) FILTER (WHERE identified_pattern = fraud_pattern) AS primary_correct,
         count(*) FILTER (WHERE {SEEN}) AS detected, count(*) FILTER (WHERE ({SEEN}) AND identified_pattern <> fraud_pattern) AS mislabeled, count(*) FILTER (WHERE NOT ({SEEN})) AS missed
  FROM dec WHERE is_synthetic_fraud GROUP BY fraud_pattern)"""


@query(PER_PATTERN, TX, DEC)
def per_pattern(spark, d):
    return evaluation.per_pattern(decisions(spark, d))


PAIRS = "pairs AS (SELECT CASE decision WHEN 'BLOCK' THEN confidence_score ELSE 1 - confidence_score END AS p, CASE WHEN is_synthetic_fraud THEN 1.0 ELSE 0.0 END::DOUBLE AS o FROM dec WHERE decision <> 'ESCALATE' AND confidence_score IS NOT NULL)"


BRIER = "SELECT round(avg((p - o) * (p - o)), 4) AS brier_score, count(*) AS n FROM pairs"


@query(BRIER, TX, DEC, PAIRS)
def brier(spark, d):
    return evaluation.brier(decisions(spark, d))


RELIABILITY = "SELECT CASE WHEN p >= 0.8 THEN '[0.8,1.0)' WHEN p >= 0.6 THEN '[0.6,0.8)' WHEN p >= 0.4 THEN '[0.4,0.6)' WHEN p >= 0.2 THEN '[0.2,0.4)' ELSE '[0.0,0.2)' END AS bin, count(*) AS n, round(avg(p), 3) AS mean_predicted, round(avg(o), 3) AS observed_fraud_rate FROM pairs GROUP BY ALL"


@query(RELIABILITY, TX, DEC, PAIRS)
def reliability(spark, d):
    return evaluation.reliability(decisions(spark, d))


JUDGED = """SELECT round(a, 9) AS mean_judge_on_correct, round(b, 9) AS mean_judge_on_incorrect, n_correct, n_incorrect, round(a - b, 9) AS agreement_gap FROM (
  SELECT avg(judge_score) FILTER (WHERE r) AS a, avg(judge_score) FILTER (WHERE NOT r) AS b, count(*) FILTER (WHERE r) AS n_correct, count(*) FILTER (WHERE NOT r) AS n_incorrect
  FROM (SELECT judge_score, (decision = 'BLOCK') = is_synthetic_fraud AS r FROM dec WHERE judge_score IS NOT NULL AND decision <> 'ESCALATE'))"""


@query(JUDGED, TX, DEC)
def judge_agreement(spark, d):
    j = evaluation.judge_agreement(decisions(spark, d))
    return j.select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in j.dtypes])


COSTS = "SELECT count(*) AS n, sum(latency_ms)::BIGINT // count(latency_ms) AS mean_latency_ms, round(avg(judge_score), 9) AS mean_judge_score FROM dec"


@query(COSTS, TX, DEC)
def decision_costs(spark, d):
    return evaluation.costs(decisions(spark, d)).withColumn("mean_judge_score", F.round("mean_judge_score", 9))


@query("""SELECT 'escalation' AS block, 'escalations' AS metric, count(*) FILTER (WHERE decision = 'ESCALATE')::DOUBLE AS value FROM dec
  UNION ALL SELECT 'classification', 'tp', count(*) FILTER (WHERE decision = 'BLOCK' AND is_synthetic_fraud)::DOUBLE FROM dec
  UNION ALL SELECT 'cost', 'n', count(*)::DOUBLE FROM dec UNION ALL SELECT 'calibration', 'n', count(*)::DOUBLE FROM pairs""", TX, DEC, PAIRS)
def scorecard_counts(spark, d):
    return evaluation.scorecard(decisions(spark, d)).where("concat(block, '.', metric) in ('escalation.escalations', 'classification.tp', 'cost.n', 'calibration.n')")


def _unpivoted(block, sql, key=None):
    """SQL that turns a block's row or rows into (block, metric, value)."""
    values = f"SELECT {key or 'NULL'} AS k, COLUMNS(* {f'EXCLUDE {key}' if key else ''})::DOUBLE FROM ({sql})"
    return f"SELECT {block} AS block, metric, round(value, 9) AS value FROM ({values}) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE k)))"


SCORECARD = " UNION ALL ".join([_unpivoted(f"'{block}'", sql) for block, sql in (("classification", CONFUSION), ("escalation", ESCALATIONS), ("calibration", BRIER), ("judge", JUDGED), ("cost", COSTS))]
                               + [_unpivoted("'pattern ' || k", PER_PATTERN, "pattern"), _unpivoted("'reliability ' || k", RELIABILITY, "bin")])


@query(SCORECARD, TX, DEC, PAIRS)
def scorecard(spark, d):
    """Every figure of the scorecard."""
    return evaluation.scorecard(decisions(spark, d)).withColumn("value", F.round("value", 9))


def _attributed(spark, d):
    tx = transactions(spark, d)
    df = enrichment.new_device(velocity.trailing(location.with_lag(tx), "15min").join(baselines(tx), "user_id", "left"), trusted_devices(tx))
    df = risk.with_travel(df)
    s = risk.signals(F.col("velocity_15min"), risk.zscore(F.col("amount"), F.col("avg_amount"), F.col("stddev_amount")), F.col("geo_km"), F.col("is_new_device"))
    return df, s


@query("""SELECT CASE WHEN NOT flag THEN 'none' WHEN h = 0 THEN 'weighted' WHEN h > 1 THEN 'multiple' WHEN suspect_location THEN 'geo' WHEN s_a >= 0.95 THEN 'amount' ELSE 'velocity' END AS trigger, count(*) AS n, round(avg(is_synthetic_fraud::INT), 9) AS precision
  FROM (SELECT *, suspect_location::INT + (s_a >= 0.95)::INT + (s_v >= 1.0)::INT AS h FROM flagged) GROUP BY ALL""", TX, BASE, TRUSTED, TRAIL, LAGGED, SCORED)
def trigger_attribution(spark, d):
    df, s = _attributed(spark, d)
    g = F.col("suspect_location")
    t = evaluation.trigger_table(df, risk.triggers(s, g, risk.flag(risk.score(s), g, s)))
    return t.withColumn("precision", F.round("precision", 9))


@query("""SELECT jump_km, count(*) FILTER (WHERE f) AS flagged, count(*) FILTER (WHERE f) / count(*) AS flag_rate, count(*) FILTER (WHERE f AND is_synthetic_fraud) / nullif(count(*) FILTER (WHERE f), 0) AS precision, count(*) FILTER (WHERE f AND is_synthetic_fraud) / nullif(count(*) FILTER (WHERE is_synthetic_fraud), 0) AS recall
  FROM (SELECT jump_km, is_synthetic_fraud, s_a >= 0.95 OR s_v >= 1.0 OR coalesce(km >= jump_km, false) AS f FROM flagged, (VALUES (2000.0::DOUBLE), (3000.0), (4000.0)) j(jump_km)) GROUP BY jump_km""", TX, BASE, TRUSTED, TRAIL, LAGGED, SCORED)
def rule_sweep(spark, d):
    df, s = _attributed(spark, d)
    return evaluation.rule_sweep(df.withColumn("other_hard", (s["amount"] >= risk.AMOUNT_HARD) | (s["velocity"] >= risk.VELOCITY_HARD)), (2000.0, 3000.0, 4000.0))


@query("""SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS tp, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS fp, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS fn, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS tn FROM labels""")
def label_confusion(spark, d):
    l = table(spark, d, "labels")  # noqa: E741
    as_decisions = l.select(F.when(F.col("toxic") == 1, "BLOCK").otherwise("ALLOW").alias("decision"), (F.col("quality") == 0).alias("is_synthetic_fraud"))
    return evaluation.confusion(as_decisions).select("tp", "fp", "fn", "tn")


# ---- reports, queues and samples

WINDOW = ("2024-01-05T00:00:00", "2024-01-20T00:00:00")
IN_WINDOW = "decided_at >= TIMESTAMP '2024-01-05' AND decided_at < TIMESTAMP '2024-01-20'"
PERFORMANCE = f"""SELECT count(*) AS transactions_reviewed, count(*) FILTER (WHERE d.decision = 'BLOCK') AS block_count, count(*) FILTER (WHERE d.decision = 'ESCALATE') AS escalate_count, count(*) FILTER (WHERE d.decision = 'ALLOW') AS allow_count,
  round(count(*) FILTER (WHERE t.is_synthetic_fraud) / nullif(count(*), 0), 4) AS fraud_rate, (SELECT identified_pattern FROM dec WHERE {IN_WINDOW} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_fraud_pattern
  FROM dec d LEFT JOIN tx t ON t.transaction_id = d.snapshot_id WHERE {IN_WINDOW}"""


def _snapshots(spark, d):
    return transactions(spark, d).withColumnRenamed("transaction_id", "snapshot_id")


@query(PERFORMANCE, TX, DEC)
def fraud_performance(spark, d):
    at = lambda x: F.lit(x).cast("timestamp")
    return reports.fraud_performance(decisions(spark, d), _snapshots(spark, d), *map(at, WINDOW))


@query(PERFORMANCE, TX, DEC)
def fraud_performance_guarded(spark, d):
    """The same report as a named statement with bound times, through the guard."""
    tables = {"decisions.fact_decisions": decisions(spark, d), "features.fact_feature_snapshots": _snapshots(spark, d)}
    return named.run_report(spark, "fraud_performance", tables, *WINDOW)


@query("SELECT user_id, decision, count(*) AS n FROM dec WHERE decided_at >= TIMESTAMP '2024-01-20' - INTERVAL 72 HOUR AND decided_at <= TIMESTAMP '2024-01-20' GROUP BY ALL", TX, DEC)
def recent_decisions(spark, d):
    return reports.recent_decisions(decisions(spark, d), F.lit("2024-01-20").cast("timestamp"), 72)


@query("SELECT b.user_id, round(avg_amount, 6) AS avg_amount, count(t.device_id) AS trusted_device_count FROM base b LEFT JOIN trusted t USING (user_id) GROUP BY ALL", TX, BASE, TRUSTED)
def user_profiles(spark, d):
    tx = transactions(spark, d)
    return reports.profiles(baselines(tx), trusted_devices(tx)).select("user_id", F.round("avg_amount", 6).alias("avg_amount"), "trusted_device_count")


@query("SELECT decision_id, decided_at FROM dec WHERE NOT human_reviewed AND (decision = 'ESCALATE' OR confidence_score IS NULL OR confidence_score < 0.75) ORDER BY decided_at, decision_id LIMIT 20", TX, DEC)
def review_queue(spark, d):
    return reports.review_queue(decisions(spark, d), 20).select("decision_id", F.col("decided_at").cast("timestamp_ntz").alias("decided_at"))


STRATUM = "(SELECT transaction_id, is_synthetic_fraud FROM tx WHERE {} is_synthetic_fraud ORDER BY md5('0:' || transaction_id), transaction_id LIMIT 25)"


@query(f"{STRATUM.format('')} UNION ALL {STRATUM.format('NOT')}", TX)
def stratified_sample(spark, d):
    return reports.stratified(transactions(spark, d), 25).select("transaction_id", "is_synthetic_fraud")


@query("SELECT date_trunc('day', decided_at)::TIMESTAMP AS day, decision, count(*) AS n, round(avg(confidence_score), 6) AS mean_confidence, round(avg(judge_score), 6) AS mean_judge, round(avg(latency_ms), 6) AS mean_latency_ms FROM dec GROUP BY ALL", TX, DEC)
def daily_decisions(spark, d):
    r = reports.daily(decisions(spark, d))
    return r.select(F.col("day").cast("timestamp_ntz").alias("day"), "decision", "n", *[F.round(c, 6).alias(c) for c in ("mean_confidence", "mean_judge", "mean_latency_ms")])


@query("SELECT c_mktsegment AS tier, count(*) AS n, round(avg(c_acctbal), 6) AS mean_balance FROM customer GROUP BY ALL")
def tier_summary(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean_balance"))


@query("SELECT user_id, transaction_id, amount, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, transaction_id) AS rank FROM tx) WHERE rank <= 3", TX)
def top_amounts(spark, d):
    return reports.ranked_within(transactions(spark, d), "user_id", "amount", "transaction_id", 3).select("user_id", "transaction_id", "amount", "rank")


@query("SELECT decision, human_reviewed, count(*) AS n, round(avg(confidence_score), 6) AS mean_confidence FROM dec GROUP BY CUBE (decision, human_reviewed)", TX, DEC)
def guarded_cube(spark, d):
    """Any SELECT over the allowed tables: here a CTE, a subquery and a cube."""
    statement = """WITH x AS (SELECT * FROM decisions.fact_decisions WHERE decision_id IN (SELECT decision_id FROM decisions.fact_decisions))
        SELECT decision, human_reviewed, count(*) AS n, round(avg(confidence_score), 6) AS mean_confidence FROM x GROUP BY CUBE (decision, human_reviewed)"""
    return guard.run(spark, statement, {"decisions.fact_decisions": decisions(spark, d)})


@query("SELECT user_id, n, rank FROM (SELECT user_id, n, rank() OVER (ORDER BY n DESC, user_id) AS rank FROM (SELECT user_id, count(*) AS n FROM dec GROUP BY user_id)) WHERE rank <= 200", TX, DEC)
def guarded_ranking(spark, d):
    statement = """SELECT user_id, n, rank() OVER (ORDER BY n DESC, user_id) AS rank FROM
        (SELECT user_id, count(*) AS n FROM decisions.fact_decisions GROUP BY user_id ORDER BY n DESC, user_id LIMIT 200) ORDER BY rank"""
    return guard.run(spark, statement, {"decisions.fact_decisions": decisions(spark, d)})


# ---- retrieval

CHUNKS = r"""words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents)"""


@query(None)
def document_chunks(spark, d):
    """Chunks of the documents by paragraphs (lines) within 180 words, tagged with source and language."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("pattern"), F.coalesce("lang", F.lit("")).alias("section"), F.coalesce("text", F.lit("")).alias("body"))
    return retrieval.chunked(docs, ["doc_id"], paragraph=r"\n")


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::BIGINT AS n_words FROM documents")
def chunked_words(spark, d):
    """No word is lost or doubled: a document's chunks have its words, but for the prefixes."""
    docs = table(spark, d, "documents").select("doc_id", F.lit("p").alias("pattern"), F.lit("s").alias("section"), F.coalesce("text", F.lit("")).alias("body"))
    return retrieval.chunked(docs, ["doc_id"], paragraph=r"\n").groupBy("doc_id").agg(F.sum(F.col("word_count") - 5).alias("n_words"))


BM25 = """t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents),
s AS (SELECT doc_id, len(ts) AS n, len(list_filter(ts, lambda x: x = 'license')) AS a, len(list_filter(ts, lambda x: x = 'released')) AS b FROM t),
g AS (SELECT count(*) AS nd, avg(n) AS av, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM s),
bm AS (SELECT doc_id, ln(1 + (nd - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / av)) + ln(1 + (nd - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / av)) AS score FROM s, g)"""


@query("SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0", BM25)
def keyword_scores(spark, d):
    return retrieval.bm25(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "released license").select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0", BM25)
def indexed_keyword_scores(spark, d):
    """keyword_scores from a stored index: all documents, two thirds of them first with other texts, which their own replace."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    path = io.shared_folder(spark, "word-index")
    other = F.concat(F.lit("released license other "), F.coalesce("text", F.lit("")))
    indexes.upsert_chunks(docs.where("id % 3 <> 0").withColumn("text", other), path)
    indexes.upsert_chunks(docs.where("id % 3 <= 1"), path)
    indexes.upsert_chunks(docs.where("id % 3 = 2"), path)
    return indexes.search_words(spark, path, "released license").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(None)
def nearest_vectors(spark, d):
    """The ten nearest vectors of every vector whose id is divisible by 50, from an inverted file of all of them."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = io.shared_folder(spark, "vector-index")
    cells = indexes.build_vectors(e, path)
    return indexes.search_vectors(e.where("id % 50 = 0"), path, cells).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(None)
def chunk_tokens(spark, d):
    """Every chunk of the documents with its words and its tokens, and whether a model of 256 tokens would cut it."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("pattern"), F.coalesce("lang", F.lit("")).alias("section"), F.coalesce("text", F.lit("")).alias("body"))
    chunks = retrieval.chunked(docs, ["doc_id"], paragraph=r"\n")
    n = retrieval.token_counter()(F.col("text"))
    return chunks.select("doc_id", "chunk", "word_count", n.alias("n_tokens")).withColumn("truncated", F.col("n_tokens") > retrieval.MODEL_TOKENS)


COS = "cosn AS (SELECT e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.vector_scores(e, "vec_id", e.where("vec_id = 0"))


@query("SELECT vec_id, round(score, 5) AS score FROM cosn ORDER BY cosn.score DESC, vec_id LIMIT 10", COS)
def vector_top(spark, d):
    return retrieval.top(_vectors(spark, d), "vec_id", 10).select("vec_id", F.round("score", 5).alias("score"))


@query("""SELECT id AS vec_id, round(0.5 * coalesce(v, 0) + 0.5 * coalesce(w, 0), 4) AS score FROM
  (SELECT doc_id AS id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS w FROM bm WHERE score > 0)
  FULL JOIN (SELECT vec_id AS id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS v FROM cosn) USING (id) ORDER BY 0.5 * coalesce(v, 0) + 0.5 * coalesce(w, 0) DESC, id LIMIT 5""", BM25, COS)
def hybrid_search(spark, d):
    words = retrieval.bm25(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "released license").withColumnRenamed("doc_id", "vec_id")
    return retrieval.hybrid(words, _vectors(spark, d), "vec_id").select("vec_id", F.round("score", 4).alias("score"))


@query("""SELECT id AS vec_id, round(0.5 * coalesce(v, 0) + 0.5 * coalesce(w, 0), 4) AS score FROM
  (SELECT doc_id AS id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS w FROM bm JOIN (SELECT doc_id FROM documents WHERE lang = 'en') USING (doc_id) WHERE score > 0)
  FULL JOIN (SELECT vec_id AS id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS v FROM cosn JOIN (SELECT doc_id AS vec_id FROM documents WHERE lang = 'en') USING (vec_id)) USING (id) ORDER BY 0.5 * coalesce(v, 0) + 0.5 * coalesce(w, 0) DESC, id LIMIT 5""", BM25, COS)
def hybrid_search_filtered(spark, d):
    """The same among documents of one language: the filter comes before scores are spread."""
    docs = table(spark, d, "documents")
    words = retrieval.bm25(docs.select("doc_id", "text"), "doc_id", "released license").withColumnRenamed("doc_id", "vec_id")
    among = docs.where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return retrieval.hybrid(words, _vectors(spark, d), "vec_id", among=among).select("vec_id", F.round("score", 4).alias("score"))


@query("SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, '[' || row_number() OVER (ORDER BY score DESC, doc_id) || '] score ' || printf('%.3f', score) || ': ' || substr(coalesce(text, ''), 1, 60) AS line FROM bm JOIN documents USING (doc_id) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 3", BM25)
def formatted_hits(spark, d):
    """The three best keyword hits as an agent's tool shows them."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return retrieval.formatted(retrieval.bm25(docs, "doc_id", "released license"), docs, "doc_id")


@query("SELECT doc_id::VARCHAR AS source_file, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::BIGINT AS n_words, 0::BIGINT AS n_truncated, true AS unit_length FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')")
def ingested(spark, d):
    """Documents as Markdown through the whole ingest: cut into chunks, checked against the model's length, embedded, written.

    A document's words all arrive, no chunk is over the model's length, and every embedding has length 1.
    """
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^#", "\\\\#")
    docs = table(spark, d, "documents").where(F.coalesce("text", F.lit("")).rlike(r"\S")).select(F.col("doc_id").cast("string").alias("source_file"), F.concat(F.lit("# title\n## part\n"), plain).alias("text"))
    chunks = retrieval.ingest(docs, retrieval.hashed_embedding(), io.shared_folder(spark, "chunks"))
    near_one = F.abs(retrieval.dot(F.col("embedding"), F.col("embedding")) - 1) < 1e-4
    # each chunk carries five words of its own: "Fraud Pattern: title" and "## part"
    return chunks.groupBy("source_file").agg(F.sum(F.col("word_count") - 5).alias("n_words"), F.count_if("truncated").alias("n_truncated"), F.every(near_one).alias("unit_length"))


FACT = """SELECT md5('snapshot:' || transaction_id) AS snapshot_id, transaction_id, user_id, md5('user:' || user_id) AS user_surrogate_key, TIMESTAMP '2024-02-01' AS computed_at, NULL::BIGINT AS velocity_5min, velocity_15min, NULL::BIGINT AS velocity_1hr, NULL::BIGINT AS velocity_24hr,
  amount AS txn_amount, round(avg_amount, 6) AS user_avg_amount, round(stddev_amount, 6) AS user_stddev_amount, round(z, 4) AS amount_zscore, prev_city AS prev_transaction_city, prev_ts AS prev_transaction_ts, round(nullif(km, 0), 2) AS geo_distance_km, round(nullif(mins, 0), 2) AS time_since_last_txn_min,
  is_new_device, device_id, risk AS risk_score_raw, flag AS is_flagged_for_review, is_synthetic_fraud, fraud_pattern FROM flagged"""


@query(FACT, TX, BASE, TRUSTED, TRAIL, GUARDED, SCORED)
def fact_rows(spark, d):
    """The whole fact row, 23 columns, as it is written for each transaction."""
    tx = transactions(spark, d)
    rows = risk.fact_row(enrichment.features(tx, baselines(tx), trusted_devices(tx)), F.lit("2024-02-01").cast("timestamp_ntz"))
    return rows.withColumns({c: F.round(c, 6) for c in ("user_avg_amount", "user_stddev_amount")}).withColumn("prev_transaction_ts", F.col("prev_transaction_ts").cast("timestamp_ntz"))


@query(f"SELECT transaction_id, CASE WHEN transaction_id % 91 = 0 THEN 'risk_not_probability' WHEN transaction_id % 79 = 0 THEN 'zscore_not_finite' END AS error_reason FROM tx WHERE transaction_id % 91 = 0 OR transaction_id % 79 = 0", TX)
def feature_errors(spark, d):
    """Feature rows that the validator sets aside for their risk or z-score."""
    t, i = transactions(spark, d), F.col("transaction_id")
    rows = t.select("transaction_id", "amount", F.when(i % 91 == 0, 1.5).otherwise(0.5).alias("risk_score_raw"), F.when(i % 79 == 0, float("nan")).otherwise(0.1).alias("amount_zscore"), F.lit("NONE").alias("fraud_pattern"))
    reason = validation.feature_error(F.col("amount"), F.col("risk_score_raw"), F.col("amount_zscore"), F.col("fraud_pattern"))
    return rows.select("transaction_id", reason.alias("error_reason")).where("error_reason is not null")


TOOL_TURN = "role = 'assistant' AND turn % 4 = 1"


@query(f"""SELECT conv_id AS decision_id, turn AS step_number, CASE WHEN {TOOL_TURN} THEN 'TOOL_CALL' WHEN role = 'user' THEN 'INPUT' WHEN role = 'assistant' THEN 'REASONING' WHEN role = 'tool' THEN 'TOOL_OUTPUT' ELSE 'OTHER' END AS step_type,
  CASE WHEN {TOOL_TURN} THEN 'profile, history' END AS tool_name, CASE WHEN {TOOL_TURN} THEN len(text)::BIGINT END AS first_argument, CASE WHEN role = 'assistant' THEN len(regexp_extract_all(text, '\\S+'))::BIGINT END AS tokens_used,
  CASE WHEN role = 'user' OR (role = 'assistant' AND NOT ({TOOL_TURN})) THEN text END AS reasoning_text FROM conversations""")
def trace_tools(spark, d):
    """Trace rows with tool calls: one row a message, the tools' names joined, their arguments as one variant, the tokens counted."""
    c = table(spark, d, "conversations")
    calling = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    n = F.length("text").cast("bigint")
    call = lambda name: F.struct(F.lit(name).alias("name"), F.struct(n.alias("n")).alias("args"))
    m = c.select("conv_id", "turn", "role", "text", F.when(calling, F.array(call("profile"), call("history"))).alias("tool_calls"), F.when(F.col("role") == "assistant", F.regexp_count("text", F.lit(r"\S+")).cast("bigint")).alias("tokens_used"))
    kind = governance.step_type(F.col("role"), F.col("tool_calls").isNotNull(), F.lit(None).cast("string"))
    row = m.select(F.col("conv_id").alias("decision_id"), F.col("turn").alias("step_number"), kind.alias("step_type"), F.array_join(F.transform("tool_calls", lambda x: x["name"]), ", ").alias("tool_name"), F.parse_json(F.to_json("tool_calls")).alias("tool_input"), "tokens_used", F.when(kind.isin("INPUT", "REASONING", "HANDOFF"), F.col("text")).alias("reasoning_text"))
    return row.withColumn("first_argument", F.variant_get("tool_input", "$[0].args.n", "bigint")).drop("tool_input")


@query("""SELECT DISTINCT c.conv_id, c.turn, d.decision FROM conversations c JOIN dec d ON d.decision_id = c.conv_id""", TX, DEC)
def traces_of_decisions(spark, d):
    """Each trace step with its decision."""
    return table(spark, d, "conversations").select("conv_id", "turn").join(decisions(spark, d).select(F.col("decision_id").alias("conv_id"), "decision"), "conv_id").distinct()


@query("SELECT decision_id, decision, confidence_score FROM dec WHERE decision = 'ESCALATE' OR (confidence_score IS NOT NULL AND confidence_score <= 0.97)", TX, DEC)
def appended_decisions(spark, d):
    """Decisions that pass the check are appended to the table; the others are kept out of it."""
    c = F.when(F.col("confidence_score") > 0.97, F.col("confidence_score") + 1).otherwise(F.col("confidence_score"))
    rows = decisions(spark, d).select("decision_id", "decision", F.when((F.col("decision") == "ESCALATE") & (c > 1), F.col("confidence_score")).otherwise(c).alias("confidence_score"))
    path = io.shared_folder(spark, "decisions")
    validation.append_checked(rows, validation.decision_error(F.col("decision"), F.col("confidence_score")), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("SELECT transaction_id FROM tx JOIN (SELECT user_id, transaction_id AS t FROM tx WHERE amount > 100 ORDER BY md5('0:' || transaction_id), transaction_id LIMIT 1) x ON t = transaction_id", TX)
def one_flagged(spark, d):
    """One flagged transaction, the same one each time: the first by a seeded hash."""
    return reports.any_one(transactions(spark, d).where("amount > 100"), "transaction_id").select("transaction_id")


@query("SELECT user_id::VARCHAR AS key, count(*) AS n, count(*) FILTER (WHERE amount > 100) AS large FROM tx GROUP BY user_id", TX)
def topic_messages(spark, d):
    """Events as a keyed topic's messages (key, value), written and read back as JSON."""
    path = io.shared_folder(spark, "topic")
    io.to_topic(transactions(spark, d).select("transaction_id", "user_id", "amount"), "user_id", path)
    back = spark.read.schema("key string, value string").json(path)
    amount = F.get_json_object("value", "$.amount").cast("double")
    return back.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(amount > 100).alias("large"))


@query("SELECT b.user_id, round(avg_amount, 6) AS avg_amount, coalesce(string_agg(device_id::VARCHAR, ',' ORDER BY device_id), '') AS devices FROM base b LEFT JOIN trusted t USING (user_id) GROUP BY ALL", TX, BASE, TRUSTED)
def profile_cache(spark, d):
    """Profiles with their devices as one JSON object a user, written and read back."""
    tx = transactions(spark, d)
    devices = trusted_devices(tx).groupBy("user_id").agg(F.sort_array(F.collect_list("device_id")).alias("devices"))
    path = io.shared_folder(spark, "profiles")
    baselines(tx).join(devices, "user_id", "left").select("user_id", "avg_amount", F.coalesce("devices", F.array().cast("array<bigint>")).alias("devices")).write.json(path)
    back = spark.read.schema("user_id bigint, avg_amount double, devices array<bigint>").json(path)
    return back.select("user_id", F.round("avg_amount", 6).alias("avg_amount"), F.array_join(F.transform("devices", lambda x: x.cast("string")), ",").alias("devices"))


# ---- reading roles, questions and display


def _role_tables(spark, d):
    tx = transactions(spark, d)
    return {"features.fact_feature_snapshots": tx, "decisions.fact_decisions": decisions(spark, d), "dim.dim_users": baselines(tx), "dim.dim_devices": trusted_devices(tx)}


@query(
    "SELECT role, name, CASE WHEN list_contains(own, name) THEN n END AS n_rows FROM (VALUES ('bi', ['features', 'decisions']), ('pipeline', ['features', 'users', 'devices']), ('agent', ['features', 'decisions', 'users'])) r(role, own), "
    "(SELECT 'features' AS name, count(*) AS n FROM tx UNION ALL SELECT 'decisions', count(*) FROM dec UNION ALL SELECT 'users', count(*) FROM base UNION ALL SELECT 'devices', count(*) FROM trusted)", TX, DEC, BASE, TRUSTED,
)
def role_access(spark, d):
    """Rows that each reading role counts in each table through the guard; null where it is refused."""
    tables, parts = _role_tables(spark, d), []
    for role in guard.ROLES:
        own = guard.connected(spark, role, tables)
        for name in tables:
            counted = guard.run(spark, f"SELECT count(*) AS n_rows FROM {name}", own) if name in own else spark.createDataFrame([(None,)], "n_rows bigint")
            parts.append(counted.select(F.lit(role).alias("role"), F.lit(name.split("_")[-1].replace("snapshots", "features")).alias("name"), "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("SELECT decision, count(*) AS n, round(avg(amount), 6) AS mean_amount FROM dec GROUP BY decision", TX, DEC)
def asked(spark, d):
    """A question in words, answered under the guard with what a generator makes of it."""
    answers = {"how do decisions differ": "SELECT decision, count(*) AS n, round(avg(amount), 6) AS mean_amount FROM decisions.fact_decisions GROUP BY decision"}
    return guard.ask(spark, "how do decisions differ", answers.__getitem__, guard.connected(spark, "bi", _role_tables(spark, d)))


@query("SELECT decision, format('{:,}', n) AS n, printf('%.2f%%', share * 100) AS fraud_share, format('{:,.2f}', total) AS total FROM (SELECT decision, count(*) AS n, avg(is_synthetic_fraud::DOUBLE) AS share, sum(amount) AS total FROM dec GROUP BY decision)", TX, DEC)
def displayed_decisions(spark, d):
    """Decisions as reports show them: counts with separators, shares as percentages, amounts with two digits."""
    rows = decisions(spark, d).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_synthetic_fraud").cast("double")).alias("fraud_share"), F.sum("amount").alias("total"))
    return named.displayed(rows)


@query("SELECT unnest(['Transactions reviewed', 'Blocked share', 'Mean amount']) AS metric, unnest([format('{:,}', n), printf('%.2f%%', share * 100), format('{:,.2f}', mean)]) AS value FROM (SELECT count(*) AS n, avg((decision = 'BLOCK')::INT::DOUBLE) AS share, avg(amount) AS mean FROM dec)", TX, DEC)
def report_metrics(spark, d):
    """A one-row report as labelled figures."""
    blocked = (F.col("decision") == "BLOCK").cast("double")
    return named.metrics(decisions(spark, d).agg(F.count(F.lit(1)).alias("transactions_reviewed"), F.avg(blocked).alias("blocked_share"), F.avg("amount").alias("mean_amount")))
