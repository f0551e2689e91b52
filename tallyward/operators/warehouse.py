"""Warehouse upkeep: deduplication, upserts of whole tables and of touched buckets, review, annotation, history, new columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.sources.io import exists, remove, written


def latest_version(df: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """One row per key: the latest, nulls last, ties by the given columns descending."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), *[F.col(t).desc() for t in ties])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, source: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The target after a merge on key: rows of the source replace or join it; within the source the latest wins.

    Running it again with the same source changes nothing, so a replayed batch is harmless.
    """
    new = latest_version(source, key, at, *ties)
    columns = target.columns
    s, t = new.select(F.struct(*columns).alias("s")), target.select(F.struct(*columns).alias("t"))
    merged = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    return merged.select(F.when(F.col("s").isNotNull(), F.col("s")).otherwise(F.col("t")).alias("r")).select("r.*")


#: Buckets of a stored fact table, and rows of a staging file.
BUCKETS, STAGE_ROWS = 32, 50_000


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def create_facts(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Store df as a fact table in buckets of its key."""
    df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def stage(df: DataFrame, path: str, rows_per_file: int = STAGE_ROWS) -> None:
    """Append to Parquet staging. The write is committed as a whole; nothing waits in a buffer to be lost."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).option("compression", "snappy").parquet(path)


def merge_staged(spark: SparkSession, staging: str, facts: str, key: str, at: str, *ties: str, buckets: int = BUCKETS) -> tuple[int, int]:
    """Merge all staged rows into a fact table made by create_facts: (rows that were new, rows that took another's place).

    Only the buckets that staged keys fall into are read and written, by dynamic partition overwrite; the others' files
    stay as they are. Staging is cleared at the end. If the job fails before that, running it again gives the same table.
    """
    if not exists(spark, staging):
        return 0, 0
    staged = spark.read.parquet(staging).withColumn("bucket", bucket_of(key, buckets))
    newest = written(latest_version(staged, key, at, *ties), "staged")
    touched = [r.bucket for r in newest.select("bucket").distinct().collect()]  # no more than there are buckets
    target = spark.read.parquet(facts)
    old = target.where(F.col("bucket").isin(touched)).select(newest.columns)
    counts = newest.join(old.select(F.col(key), F.lit(True).alias("held")), key, "left").agg(F.count_if(F.col("held").isNull()), F.count_if("held")).first()
    merged = written(upsert(old, newest, key, at, *ties), "merged")  # the table isn't written while it is read
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(facts)
    remove(spark, staging)
    return counts[0], counts[1]


def review(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """decisions with verdicts (decision_id, reviewer, human_decision) applied where nobody had reviewed yet.

    review_conflict is true for a verdict that came to an already reviewed decision and was not applied. Of several
    verdicts for one decision the first by reviewer counts.
    """
    first = verdicts.groupBy("decision_id").agg(F.min(F.struct("reviewer", "human_decision")).alias("v"))
    joined = decisions.join(first, "decision_id", "left")
    given, open_ = F.col("v").isNotNull(), ~F.col("human_reviewed")
    return joined.select(*[c for c in decisions.columns if c != "human_reviewed"], (F.col("human_reviewed") | given).alias("human_reviewed"), F.when(given & open_, F.col("v.reviewer")).alias("reviewer"), F.when(given & open_, F.col("v.human_decision")).alias("human_decision"), (given & ~open_).alias("review_conflict"))


def annotate(rows: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """rows with the columns of notes written over their own where a note has a value."""
    own = [c for c in notes.columns if c != key]
    noted = notes.select(F.col(key).alias("key"), F.struct(*own).alias("note")).alias("n")
    joined = rows.alias("r").join(noted, F.col(f"r.{key}") == F.col("n.key"), "left")
    return joined.select(*[F.coalesce(F.col(f"n.note.{c}"), F.col(f"r.{c}")).alias(c) if c in own else F.col(f"r.{c}") for c in rows.columns])


def as_of(facts: DataFrame, history: DataFrame, key: str, at: str, start: str = "valid_from", end: str = "valid_to", days: int = 90) -> DataFrame:
    """Each fact with the version of its key that held at its time: start <= time < end. A key's versions don't overlap.

    Facts and versions are one sorted run in which the last version is carried along, so no fact meets more than one
    version. Keys are cut into stretches of `days`, each with the version that holds at its beginning carried in: these
    come from the versions alone, one row a stretch. So a key of very many facts is many groups. Of versions that start
    together the one that ends last holds.
    """
    own, kept = facts.columns, [c for c in history.columns if c != key]
    stretch = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / days)
    version = F.struct(*kept)
    known = history.where(F.col(key).isNotNull() & F.col(start).isNotNull()).select(F.col(key).alias("_k"), stretch(start).alias("_s"), F.col(start).alias("_t"), F.lit(0).alias("_o"), F.col(end).alias("_e"), version.alias("_v"))
    rows = facts.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_k"), stretch(at).alias("_s"), F.col(at).alias("_t"), F.lit(1).alias("_o"), F.struct(*own).alias("_f"))
    # the version that a stretch begins with: the last one of the stretches before it
    last = known.groupBy("_k", "_s").agg(F.max_by("_v", F.struct("_t", "_e")).alias("_v"))
    spans = last.unionByName(rows.select("_k", "_s").distinct(), allowMissingColumns=True).groupBy("_k", "_s").agg(F.first("_v", ignorenulls=True).alias("_v"))
    before = F.last("_v", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    entering = spans.withColumn("_v", before).where("_v is not null").withColumn("_o", F.lit(-1))
    run = rows.unionByName(known.drop("_e"), allowMissingColumns=True).unionByName(entering, allowMissingColumns=True)
    w = Window.partitionBy("_k", "_s").orderBy(F.col("_t").asc_nulls_first(), "_o", F.col(f"_v.{end}"))
    carried = run.withColumn("_v", F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_f is not null")
    return carried.where((F.col(f"_v.{start}") <= F.col("_t")) & (F.col(f"_v.{end}") > F.col("_t"))).select("_f.*", *[F.col(f"_v.{c}") for c in kept])


def widened(df: DataFrame, **columns: str) -> DataFrame:
    """df with the columns (name to type) that it lacks, null."""
    return df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in columns.items() if name not in df.columns])
