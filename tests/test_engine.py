"""Operators, the guard and the streams on small inputs; queries against their SQL."""

import math
import random
import time
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyward import queries
from tallyward.operators import evaluation, location, retrieval, velocity, warehouse
from tallyward.plans import guard, reports
from tallyward.sources import io

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v


def same_rows(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    names = sorted(df.columns)
    found = con.execute(sql)
    order = [c[0] for c in found.description]
    assert sorted(order) == names
    want = sorted((str(tuple(plain(r[order.index(c)]) for c in names)) for r in found.fetchall()))
    got = sorted(str(tuple(plain(r[c]) for c in names)) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(i, rng.randrange(5), rng.choice([42.36, 51.5, 0.0, None]), rng.choice([-71.06, -0.13]), "c", start + timedelta(minutes=rng.randrange(3000))) for i in range(n)]


TX = "transaction_id bigint, user_id bigint, latitude double, longitude double, city string, transaction_ts timestamp"


def test_guarded_equals_loop(spark):
    rows = rows_of(300)
    got = {r.transaction_id: r.prev_lat for r in location.with_guarded(spark.createDataFrame(rows, TX)).collect()}
    base = {}
    for i, u, lat, lon, city, at in sorted(rows, key=lambda r: (r[1], r[5], r[0])):
        assert got[i] == (base[u][0] if base.get(u) else None)
        base[u] = location.advance(base.get(u), lat, lon, city, int((at - datetime(1970, 1, 1)).total_seconds() * 1e6))


@pytest.mark.parametrize("rows_a_batch", [1, 7, 10_000])
def test_guarded_keeps_replayed_rows_and_their_columns(spark, rows_a_batch):
    rows = [*rows_of(300), (300, 1, 42.0, -71.0, "c", None), (None, 2, 51.5, -0.13, "d", datetime(2024, 1, 2)), (2**53 + 1, 2, float("nan"), 1.0, None, datetime(2024, 1, 2))]
    tx = spark.createDataFrame(rows + rows[:20] + rows[:20], TX).withColumn("_extra", F.lit("x"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows_a_batch))
    try:
        out = location.with_guarded(tx).collect()
    finally:
        spark.conf.set(name, before)
    assert len(out) == len(rows) + 40 and all(r._extra == "x" for r in out)
    us = lambda t: None if t is None else int((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
    key = lambda r: (r[1], r[5] is not None, r[5] or datetime(1970, 1, 1), r[0] is not None, r[0] or 0)
    want, base = [], {}
    for r in sorted(rows + rows[:20] + rows[:20], key=key):
        b = base.get(r[1])
        want.append(str((r[0], r[1], b and b[0], b and b[2], b and b[3])))
        base[r[1]] = location.advance(b, *r[2:5], us(r[5]))
    assert sorted(str((r.transaction_id, r.user_id, r.prev_lat, r.prev_city, us(r.prev_ts))) for r in out) == sorted(want)


def test_panes_equal_windows(spark):
    tx = spark.createDataFrame([*rows_of(200), (900, 1, 1.0, 1.0, "c", datetime(1969, 12, 31, 23, 59, 30)), (901, 1, 1.0, 1.0, "c", None)], TX)
    for name in velocity.WINDOWS:
        assert sorted(map(str, velocity.paned(tx, name).collect())) == sorted(map(str, velocity.sliding(tx, name).collect()))


def test_trailing_counts_the_same_moment(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 1, t), (2, 1, t + timedelta(minutes=15)), (3, 1, t + timedelta(minutes=15, microseconds=1)), (4, 1, t)]
    df = spark.createDataFrame(rows, "transaction_id int, user_id int, transaction_ts timestamp")
    assert {r.transaction_id: r.velocity_15min for r in velocity.trailing(df, "15min").collect()} == {1: 2, 4: 2, 2: 3, 3: 2}


def test_trailing_over_stretches_equals_one_window(spark):
    from pyspark.sql.window import Window

    rng = random.Random(3)
    rows = [(i, 1, datetime(1969, 12, 30) + timedelta(seconds=rng.randrange(9 * 86_400))) for i in range(600)] + [(i, 2, None) for i in range(600, 603)]
    tx = spark.createDataFrame(rows, "transaction_id int, user_id int, transaction_ts timestamp").withColumn("n", F.lit("x"))
    for names in (("5min",), ("15min", "1hr"), tuple(velocity.SECONDS)):
        plain_ = tx.withColumn("at", F.unix_micros("transaction_ts"))
        for n in names:
            plain_ = plain_.withColumn(f"velocity_{n}", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-velocity.SECONDS[n] * 1_000_000, 0)))
        got = velocity.trailing(tx, *names)
        assert got.columns == [*tx.columns, *[f"velocity_{n}" for n in names]]
        assert sorted(map(str, got.collect())) == sorted(map(str, plain_.drop("at").collect()))
    # one user is many groups
    groups = tx.where("user_id = 1").groupBy(F.floor(F.unix_micros("transaction_ts") / (velocity.STRETCH * 900_000_000))).count()
    assert groups.agg(F.max("count")).first()[0] < 60


def test_as_of_equals_pairs(spark):
    rng = random.Random(8)
    day = lambda n: (datetime(2020, 1, 1) + timedelta(days=n)).date()
    versions = []
    for k in range(6):
        cuts = sorted(rng.sample(range(900), rng.randrange(1, 9)))
        versions += [(k, i, day(a), day(b)) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], cuts[-1] + 50], strict=True)) if rng.random() < 0.8]
    facts = [(rng.randrange(8), i, day(rng.randrange(-50, 1000))) for i in range(500)] + [(None, 900, day(5)), (1, 901, None)]
    facts += facts[:3]
    f = spark.createDataFrame(facts, "k int, id int, day date").withColumn("valid", F.lit("x"))
    h = spark.createDataFrame(versions, "k int, version int, valid_from date, valid_to date")
    want = sorted(str((k, i, v)) for k, i, at in facts for kk, v, a, b in versions if k == kk and at and a <= at < b)
    for days in (1, 7, 90, 10_000):
        assert sorted(str((r.k, r.id, r.version)) for r in warehouse.as_of(f, h, "k", "day", days=days).collect()) == want


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    import os

    facts, staging = str(tmp_path / "facts"), str(tmp_path / "staging")
    rows = lambda ids, v: spark.createDataFrame([(i, v, v) for i in ids], "k bigint, v int, at int")
    warehouse.create_facts(rows(range(200), 1), facts, "k")
    files = lambda: {f"{d}/{x}" for d, _, names in os.walk(facts) for x in names if x.endswith(".parquet")}
    before = files()
    warehouse.stage(rows([3, 3, 500], 2).unionAll(rows([3], 3)), staging)
    assert warehouse.merge_staged(spark, staging, facts, "k", "at", "v") == (1, 1) and not os.path.exists(staging)
    touched = {r.bucket for r in rows([3, 500], 1).select(warehouse.bucket_of("k").alias("bucket")).collect()}
    assert {f for f in before - files()} == {f for f in before if int(f.split("bucket=")[1].split("/")[0]) in touched}
    got = {r.k: r.v for r in spark.read.parquet(facts).collect()}
    assert got == {i: 1 for i in range(200)} | {3: 3, 500: 2} and spark.read.parquet(facts).count() == 201
    warehouse.stage(rows([500], 2), staging)
    assert warehouse.merge_staged(spark, staging, facts, "k", "at", "v") == (0, 1) and warehouse.merge_staged(spark, staging, facts, "k", "at", "v") == (0, 0)


def brute_scrub(text, values):
    """Longest values first, then from the left, each place looked for anew in what is left of the text."""
    from tallyward.functions.privacy import _mark

    parts = [(text, True)]
    for v in sorted({v for v in values if v}, key=lambda v: (-len(v), v)):
        new = []
        for part, free in parts:
            pieces = part.split(v) if free else [part]
            for i, x in enumerate(pieces):
                new += [(_mark(v), False)] * (i > 0) + [(x, free)]
        parts = new
    return "".join(x for x, _ in parts)


def test_scrubbed_overlaps_equal_brute(spark, sf_dir):
    import pandas as pd

    c = pd.read_parquet(f"{sf_dir}/conversations.parquet")
    values = {}
    for r in c[c.turn <= 1].itertuples():
        w = [x for x in (r.text or "").split(" ") if len(x) > 2][:4]
        values.setdefault(r.conv_id, set()).update(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w)))
    want = sorted((r.conv_id, r.turn, brute_scrub(r.text, values.get(r.conv_id, ()))) for r in c.itertuples())
    got = sorted((r.conv_id, r.turn, r.text) for r in queries.QUERIES["scrubbed_overlaps"](spark, sf_dir).collect())
    assert got == want and sum("REDACTED" in t for *_, t in got) > 10


def test_upsert_twice_is_once(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    s = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", None)], "k int, v string, at int")
    once = warehouse.upsert(t, s, "k", "at", "v")
    assert sorted((r.k, r.v) for r in once.collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted((r.k, r.v) for r in warehouse.upsert(once, s, "k", "at", "v").collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_empty_decisions(spark, sf_dir):
    from tallyward.sources.tables import decisions

    none = decisions(spark, sf_dir).where("false")
    c = evaluation.confusion(none).first()
    assert (c.tp, c.precision, c.f1) == (0, None, None)
    assert evaluation.brier(none).first().brier_score is None and evaluation.reliability(none).count() == 0
    card = {(r.block, r.metric): r.value for r in evaluation.scorecard(none).collect()}
    assert len(card) == 21 and card["classification", "tp"] == 0 and card["cost", "mean_judge_score"] is None


def test_chunks(spark):
    long = " ".join(f"w{i}" for i in range(400))
    doc = f"# GEO\nintro\n## One\nshort text\n## Two\npara one\n\n{long}\n\npara three"
    parts = retrieval.sections(spark.createDataFrame([("a.md", doc), ("b.md", "# T\nbody only"), ("c.md", "nothing")], "source_file string, text string"))
    names = {(r.source_file, r.section): r for r in parts.collect()}
    assert names[("a.md", "One")].body == "short text" and names[("b.md", "Full Document")].body == "body only" and names[("c.md", "Full Document")].title_missing
    chunks = retrieval.chunked(parts.where("not title_missing"), ["source_file"]).collect()
    assert all(c.word_count <= 180 for c in chunks)
    two = [c for c in chunks if c.section == "Two"]
    assert sum(c.word_count for c in two) - 5 * len(two) == 404 and two[0].text.startswith("Fraud Pattern: GEO\n\n## Two\npara one")


def brute_chunks(pattern, section, body, most=retrieval.MAX_WORDS):
    prefix = f"{retrieval.PREFIX}{pattern}\n\n## {section}\n"
    if len((prefix + body).split()) <= most:
        return [prefix + body]
    budget, pieces = max(1, most - len(prefix.split())), []
    for p in (p.strip() for p in body.split("\n")):
        w = p.split()
        pieces += [] if not w else [p] if len(w) <= budget else [" ".join(w[i : i + budget]) for i in range(0, len(w), budget)]
    chunks, n = [], 0
    for p in pieces:
        k = len(p.split())
        if not chunks or n + k > budget:
            chunks.append([])
            n = 0
        chunks[-1].append(p)
        n += k
    return [prefix + "\n\n".join(c) for c in chunks]


def test_chunks_of_many_paragraphs_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "p", "s", "\n".join(["one two three"] * n))], "doc_id int, pattern string, section string, body string")
        start = time.perf_counter()
        assert retrieval.chunked(df, ["doc_id"], paragraph=r"\n").count() == -(-n // 58)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(32_000) < 2.5 * seconds(16_000) + 1


def test_document_chunks_equal_brute(spark, sf_dir):
    import pandas as pd

    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    want = sorted((int(r.doc_id), i, t) for r in docs.itertuples() for i, t in enumerate(brute_chunks(r.source or "", r.lang or "", r.text or "")))
    got = sorted((r.doc_id, r.chunk, r.text) for r in queries.QUERIES["document_chunks"](spark, sf_dir).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and got == want


@pytest.mark.parametrize(
    "sql",
    [
        "", "DROP TABLE a.t", "INSERT INTO a.t VALUES (1)", "SELECT 1; SELECT 2", "SELECT * FROM a.secret", "SELECT * FROM a.t UNION SELECT * FROM a.secret", "SELECT * FROM a.t WHERE x IN (SELECT x FROM a.secret)", "WITH c AS (SELECT * FROM a.secret) SELECT * FROM c",
        "SELECT * FROM t", "SELECT * FROM cat.a.t", "SELECT * FROM IDENTIFIER('a.secret')", "SELECT * FROM range(5)", "SELEC", "CREATE TABLE x AS SELECT * FROM a.t", "SELECT * FROM parquet.`/etc`",
        "SELECT reflect('java.lang.System','getProperty','user.dir') FROM a.t", "SELECT java_method('java.lang.System','getProperty','user.dir') FROM a.t", "SELECT try_reflect('a','b') FROM a.t", "SELECT input_file_name() FROM a.t", "SELECT x FROM a.t ORDER BY reflect('a','b')", "SELECT sum(x) OVER (ORDER BY input_file_name()) FROM a.t",
        "SELECT s.x FROM (WITH secret AS (SELECT 1 AS y) SELECT y FROM secret) q, secret s", "WITH u AS (SELECT * FROM v), v AS (SELECT 1 AS x) SELECT * FROM u", "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "SELECT IDENTIFIER('x') FROM a.t", "SELECT _metadata.file_path FROM a.t", "SELECT * FROM a.t LATERAL VIEW java_method('a','b') v AS y",
        "SELECT x FROM a.t WHERE EXISTS (SELECT reflect('a','b'))", "SELECT * FROM a.t, LATERAL (SELECT * FROM b.u)", "SELECT current_user() FROM a.t", "SELECT version()", "SET x=1", "SELECT * FROM (SELECT * FROM a.secret) z",
    ],
)
def test_guard_refuses(spark, sql):
    with pytest.raises(guard.Refused):
        guard.check(spark, sql, ["a.t"])


def test_guard_reads_only_what_it_was_given(spark):
    t = spark.range(5).withColumnRenamed("id", "x")
    spark.range(99).createOrReplaceTempView("t")
    spark.sql("CREATE DATABASE IF NOT EXISTS guarded_db")
    allowed = {"guarded_db.t": t}
    for sql in ("SELECT count(*) AS n FROM `guarded_db`.`t`", "SELECT count(*) AS n FROM GUARDED_DB . t", "SELECT count(*) AS n FROM `guarded_db` . t", "SELECT count(*) AS n FROM guarded_db/**/.t", "SELECT count(*) AS n FROM guarded_db./* x */t"):
        assert guard.run(spark, sql, allowed).first().n == 5
    for sql in ("SELECT count(*) FROM t", "SELECT count(*) FROM spark_catalog.guarded_db.t"):
        with pytest.raises(guard.Refused):
            guard.run(spark, sql, allowed)
    assert guard.run(spark, "WITH q AS (SELECT x FROM guarded_db.t), r AS (SELECT * FROM q) SELECT 'guarded_db.t' AS s, count(*) AS n FROM r, (WITH z AS (SELECT 1 AS one) SELECT one FROM z) y", allowed).collect() == [("guarded_db.t", 5)]
    assert not [v.name for v in spark.catalog.listTables() if v.name.startswith("allowed_")]
    two = [guard.run(spark, "SELECT count(*) AS n FROM guarded_db.t", {"guarded_db.t": spark.range(k)}) for k in (3, 4)]
    assert [d.first().n for d in two] == [3, 4]  # calls don't share names
    spark.sql("DROP DATABASE guarded_db")


def test_guard_looks_at_what_names_turn_out_to_be(spark):
    t = spark.range(5).withColumnRenamed("id", "x").withColumn("a", F.struct(F.lit(7).alias("t")))
    spark.sql("DECLARE OR REPLACE VARIABLE myvar STRING DEFAULT 'secret'")
    for sql in ("SELECT myvar FROM a.t", "SELECT current_user FROM a.t", "SELECT session_user FROM a.t", "SELECT user FROM a.t", "SELECT x FROM a.t WHERE EXISTS (SELECT 1 FROM a.t AS z WHERE myvar = 'secret')", "WITH c AS (SELECT x, system.session.myvar AS m FROM a.t) SELECT max(m) FROM c", "SELECT x FROM a.t ORDER BY current_user"):
        with pytest.raises(guard.Refused):
            guard.run(spark, sql, {"a.t": t})
    rows = lambda sql: guard.run(spark, sql, {"a.t": t, "b.u": spark.range(3)}).collect()
    (r,) = rows("SELECT x AS `a.t`, 'a.t' AS s, q.a.t AS f -- a.t\nFROM a.t AS q WHERE x = 4")
    assert r.asDict() == {"a.t": 4, "s": "a.t", "f": 7}
    assert rows("SELECT a.t FROM a.t WHERE t.x = 1") == [(7,)] and rows("SELECT a.t.x FROM a.t WHERE a.t.x = 1") == [(1,)] and rows("SELECT a.t.* FROM a.t, b.u WHERE u.id = 0 AND t.x = 2")[0].x == 2
    assert rows("SELECT count(*) FROM a.t JOIN b.u ON b.u.id = a.t.x")[0][0] == 3 and rows("SELECT sum(y) FROM (VALUES (1), (2)) AS v(y)") == [(3,)]
    assert rows("SELECT max(x) FROM (SELECT x FROM a.t UNION ALL SELECT id FROM b.u)") == [(4,)] and len(rows("SELECT *, current_date AS d FROM a.t")) == 5
    spark.sql("DROP TEMPORARY VARIABLE myvar")


def test_connected_roles_reach_their_own_tables_only(spark):
    tables = {n: spark.range(3) for n in ("features.fact_feature_snapshots", "decisions.fact_decisions", "dim.dim_users", "dim.dim_devices")}
    assert set(guard.connected(spark, "bi", tables)) == {"features.fact_feature_snapshots", "decisions.fact_decisions"}
    with pytest.raises(guard.Refused):
        guard.connected(spark, "accountadmin", tables)
    broken = tables | {"decisions.fact_decisions": spark.range(1).select(F.raise_error(F.lit("gone")).alias("x"))}
    with pytest.raises(Exception, match="gone"):
        guard.connected(spark, "bi", {k: v.where("x is not null") if k.startswith("dec") else v for k, v in broken.items()})


def test_markdown_files_are_ingested(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Geo\n## One\nshort text\n")
    (tmp_path / "b.md").write_text("# Two\nbody")
    (tmp_path / "c.txt").write_text("# no")
    docs = io.read_documents(spark, str(tmp_path))
    got = retrieval.ingest(docs, retrieval.hashed_embedding(), str(tmp_path / "out")).collect()
    assert sorted((r.source_file, r.text) for r in got) == [("a.md", "Fraud Pattern: Geo\n\n## One\nshort text"), ("b.md", "Fraud Pattern: Two\n\n## Full Document\nbody")]


def test_guard_answers_in_time(spark):
    t = spark.range(3).withColumnRenamed("id", "x")
    assert [r.x for r in guard.answer(spark, "all?", lambda q: "SELECT x FROM a.t ORDER BY x", {"a.t": t})] == [0, 1, 2]
    slow = spark.range(2_000_000_000_000).withColumnRenamed("id", "x")
    start = time.monotonic()
    with pytest.raises(TimeoutError):
        guard.answer(spark, "sum?", lambda q: "SELECT sum(sqrt(x)) AS s FROM a.t", {"a.t": slow}, seconds=1.5)
    assert time.monotonic() - start < 20 and spark.range(10).count() == 10


def test_guard_runs(spark):
    t = spark.range(500).withColumnRenamed("id", "x")
    assert guard.run(spark, "SELECT x, 'a.t' AS name FROM a.t WHERE x >= :low", {"a.t": t}, args={"low": 100}).count() == 200
    assert guard.run(spark, "WITH c AS (SELECT x FROM A.T) SELECT max(x) AS m FROM c", {"a.t": t}).first().m == 499
    assert guard.ask(spark, "how many?", lambda q: "SELECT count(*) AS n FROM a.t", {"a.t": t}).first().n == 500
    with pytest.raises(guard.Refused):
        guard.tables_for("accountadmin", {})


def test_report_shapes(spark):
    one = spark.createDataFrame([(3, 0.5)], "n bigint, fraud_rate double")
    assert {r.metric: r.value for r in reports.metrics(one).collect()} == {"N": "3", "Fraud rate": "50.00%"}
    assert reports.chart_for("bar", [("d", "string"), ("n", "bigint")], 5) == ("bar", "d", "n")
    assert reports.chart_for("line", [("d", "string")], 5)[0] == "none" and reports.chart_for("bar", [("n", "int")], 1)[0] == "none"


def test_parse_and_stage(spark, tmp_path):
    raw = spark.createDataFrame([('{"transaction_id": "a", "user_id": "u", "transaction_ts": "2024-01-01T00:00:00", "amount": 49.99}',), ("{bad",), ('{"transaction_id": "b", "user_id": "u", "transaction_ts": "junk"}',)], "value string")
    rows = io.parse_events(raw).collect()
    assert [(r.transaction_id, r.amount) for r in rows] == [("a", 49.99)]
    path = str(tmp_path / "stage")
    assert io.write_once(spark.range(3), path) and not io.write_once(spark.range(9), path) and spark.read.parquet(path).count() == 3


def test_streams_equal_batch(spark, sf_dir):
    from tallyward.streaming import queries as streams

    for name in streams.QUERIES:
        same_rows(streams.QUERIES[name](spark, sf_dir), streams.ORACLES[name], sf_dir)


@pytest.mark.parametrize("trigger_rows", [1000, 150])
def test_streamed_places_do_not_depend_on_chunks(spark, trigger_rows):
    from tallyward.streaming import queries as streams

    tx = spark.createDataFrame([*rows_of(300), (300, 1, 42.0, -71.0, "c", None)], TX)
    want = {r.transaction_id: (r.prev_lat, r.prev_lon) for r in location.with_guarded(tx).collect()}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        got = {r.transaction_id: (r.prev_lat, r.prev_lon) for r in streams.locations_of(tx.orderBy(F.rand(4)), trigger_rows).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == want


def test_late_rows_are_dropped(spark, tmp_path):
    from tallyward.streaming.engine import latest_windows, to_batches, velocity_stream

    schema = "transaction_id int, user_id int, transaction_ts timestamp"
    t = datetime(2024, 1, 1, 12)
    for i, (at, n) in enumerate([(t, 1), (t + timedelta(hours=2), 2), (t, 3)]):
        spark.createDataFrame([(n, 1, at)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        to_batches(velocity_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"), "update").awaitTermination()
    out = latest_windows(spark.read.parquet(str(tmp_path / "out")))
    assert out.where(F.col("window_start") < "2024-01-01 13:00:00").agg(F.max("n")).first()[0] == 1
