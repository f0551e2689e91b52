"""Secret scans over every version of every file, by an incremental blob ledger.

Each version's content is addressed by its SHA-256; equal contents are one blob. The ledger, a Parquet table in a
shared folder, has one row for each (blob, rule, rule version) that was ever scanned, with the spans found. A scan
reads only blobs with a pair that the ledger lacks, and only for the lacking rules. Findings go back to all paths and
versions by a join on the blob's address.

All of it is DataFrame operations. Positions come from a regular expression's matches and the pieces between them: the
n-th match starts after the first n pieces and n-1 matches. They are counted in code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, shared_dir, stored, table, text_or_empty


class Rule(NamedTuple):
    """Matches of pattern whose group (0: the whole match) has at least `least` characters are findings.

    sql_pattern says the same for SQL engines without look-behind: the match is then its first group.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    sql_pattern: str | None = None


#: The three base kinds, then the kinds that this scan adds.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
EXTRA = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # starts where a token starts and never gives back, so that a long token is read once
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", sql_pattern=r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + EXTRA

#: Scans that the query takes a table in, and matches that are walked at a time.
INCREMENTS, STRETCH = 2, 256
LEDGER = "blob string, rule string, rule_version int, spans array<struct<start:bigint,end:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body names it: as a lambda's variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, rule: Rule, matches: Column) -> Column:
    """array<struct<start,end>> of the findings among a rule's matches.

    Matches are walked in stretches of STRETCH, each from the sum of the lengths before it, so that no step copies what
    all earlier ones found.
    """
    group = lambda m: m if not rule.group else F.regexp_extract(m, rule.pattern, rule.group)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero = F.lit(0).cast("bigint")

    def lengths(z: Column) -> Column:
        n = F.coalesce(F.length(z["m"]), F.lit(0))
        return F.struct(F.length(z["p"]).alias("gap"), n.alias("n"), F.coalesce(F.length(group(z["m"])) >= rule.least, F.lit(False)).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["n"]
        return F.struct(end.alias("at"), F.when(x["found"], F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end")))).otherwise(acc["out"]).alias("out"))

    total = lambda part: F.aggregate(part, zero, lambda a, x: a + x["gap"] + x["n"])
    walk = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    before = lambda sums, i: F.aggregate(F.slice(sums, F.lit(1), i), zero, lambda a, x: a + x)
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STRETCH).cast("int")), lambda i: F.slice(xs, i * STRETCH + 1, F.lit(STRETCH)))
    spans = lambda parts: let(F.transform(parts, total), lambda sums: F.flatten(F.transform(parts, lambda part, i: walk(part, before(sums, i)))))
    zipped = F.transform(F.arrays_zip(F.split(text, rule.pattern, -1).alias("p"), matches.alias("m")), lengths)
    return F.when(F.size(matches) > 0, let(zipped, lambda xs: let(cut(xs), spans))).otherwise(none)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger as it stands; None before the first scan, when nothing is at the path."""
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else None


def scan_unseen(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks, append it, and return the ledger.

    versions needs `content` (null counts as empty); other columns are not read. A row is appended for each new
    (blob, rule, version), with an empty span list where nothing was found, so that no pair is scanned twice. A scan
    that fails leaves the ledger as it was, since Spark commits an append only as a whole.
    """
    spark = versions.sparkSession
    content = text_or_empty("content")
    # one row for each address; copies are merged before the shuffle, so a group of copies sends one row from each task
    blobs = versions.select(F.sha2(content, 256).alias("blob"), content.alias("content")).groupBy("blob").agg(F.any_value("content").alias("content"))
    wanted = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    ledger = read_ledger(spark, ledger_path)
    if ledger is None:
        blobs = blobs.withColumn("pending", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "rule_version")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("pending", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("pending") > 0).drop("seen")
    none = F.array().cast("array<string>")
    matched = blobs.select("blob", "content", "pending", *[F.when(F.array_contains("pending", f"{r.kind}:{r.version}"), F.regexp_extract_all("content", F.lit(r.pattern), F.lit(0))).otherwise(none).alias(f"m{i}") for i, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version"), spans_of(F.col("content"), r, F.col(f"m{i}")).alias("spans")) for i, r in enumerate(rules)])
    scanned = F.filter(rows, lambda x: F.array_contains(F.col("pending"), F.concat_ws(":", x["rule"], x["rule_version"])))
    matched.select("blob", F.explode(scanned).alias("x")).select("blob", "x.*").write.mode("append").parquet(ledger_path)
    return read_ledger(spark, ledger_path)


def scan_in_increments(versions: DataFrame, key: str, ledger_path: str, increments: int = INCREMENTS, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after all of versions was scanned, one increment after the other."""
    turn = F.pmod(F.xxhash64(key), F.lit(increments))
    for i in range(increments):
        ledger = scan_unseen(versions.where(turn == i), ledger_path, rules)
    return ledger


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of versions, plus `found`: array of (start, rank of kind, kind, end), by start, then kind.

    The ledger's rows are brought to one per blob and stored first, so that the join back stands right above two plain
    exchanges: Spark can split a blob that very many paths share.
    """
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))])
    rows = ledger.select("blob", "rule", rank[F.concat_ws(":", "rule", "rule_version")].alias("rank"), "spans").where(F.col("rank").isNotNull() & (F.size("spans") > 0))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank"), F.col("rule").alias("kind"), s["end"].alias("end")))
    by_blob = stored(rows.select("blob", spans.alias("s")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("s"))).alias("found")), "findings")
    keyed = versions.withColumn("blob", F.sha2(text_or_empty("content"), 256)).drop("content")
    return keyed.join(by_blob, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(by_blob.schema["found"].dataType)))


def listing(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the findings of these kinds, comma-joined."""
    own = F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts and spans of the secrets in its whole text (null: empty).

    All documents come in INCREMENTS scans over one ledger, dealt by a hash: a later scan passes over the texts that an
    earlier one has seen. Rows with equal texts are one blob and get equal findings, in whatever scan they come; an
    empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    ledger = scan_in_increments(docs, "doc_id", shared_dir(spark, "secret-ledger"))
    found = findings(docs, ledger)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base, every = tuple(r.kind for r in BASE), tuple(r.kind for r in RULES)
    return found.select("doc_id", *map(count, base), F.sha2(listing(F.col("found"), base), 256).alias("base_sha256"), listing(F.col("found"), every).alias("spans"))


def _kind_sql(rank: int, rule: Rule) -> str:
    p, whole = (rule.sql_pattern or rule.pattern).replace("'", "''"), int(bool(rule.sql_pattern))
    good = f"len(regexp_extract(mt, '{p}', {rule.group or whole})) >= {rule.least}"
    pairs = f"SELECT doc_id, unnest(ms) AS mt, unnest(ps[:len(ms)]) AS pc, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, regexp_split_to_array(text, '{p}') AS ps FROM t) WHERE len(ms) > 0"
    ends = f"SELECT *, sum(len(pc) + len(mt)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS fin FROM ({pairs})"
    return f"SELECT doc_id, {rank} AS k, '{rule.kind}' AS kind, fin - len(regexp_extract(mt, '{p}', {whole})) AS st, fin FROM ({ends}) WHERE {good}"


OP1_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_kind_sql(i, r) for i, r in enumerate(RULES))}),
g AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
             string_agg(kind || ':' || st || ':' || fin, ',' ORDER BY st, k) FILTER (WHERE k < {len(BASE)}) AS base,
             string_agg(kind || ':' || st || ':' || fin, ',' ORDER BY st, k) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""
