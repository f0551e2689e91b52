"""Exact deduplication with stateful streaming.

Structured Streaming keeps, on disk (RocksDB state store) and without expiry, one entry per digest: the smallest stable
identifier seen, the locator of that row's content (its file and its place in the file), and how many rows had the
digest. Rows are pre-aggregated in their tasks before they reach the state, so a group of copies of any size sends one
row from each task. A table comes in several triggers, and a state folder given by name is continued: what came before
is in the state and counts. Each batch's changed entries are written under the batch's number, so a batch that runs
again overwrites its own output.

A hit (a digest that several rows have) is believed only after the full texts were compared with the kept row's text,
fetched by its locator. Rows that differ in spite of equal digests are grouped again by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, SPACES, exists, numbered, shared_dir, small, stored, table, text_or_empty

#: The state is kept in RocksDB, whose files take only the space that they fill: with preallocation, each of the many
#: small partitions would hold 4 MB of disk for its manifest alone.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Triggers that a table is taken in, and copies that are compared with one copy of the kept text.
TRIGGERS, SALT_ROWS = 3, 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; nothing is trimmed."""
    return F.regexp_replace(text, SPACES, " ")


def files_in(spark: SparkSession, path: str) -> int:
    """Parquet files under path; none if it isn't there."""
    return len(spark.read.schema("digest string").parquet(path).inputFiles()) if exists(spark, path) else 0


def digest_state(rows: DataFrame, state: str, triggers: int = TRIGGERS) -> DataFrame:
    """(digest, keep_id, locator, group_size) of all digests that the state folder has seen, rows' own included.

    rows (doc_id, locator, digest) are appended to the state's input and streamed through the keyed state, in so many
    triggers. Of equal doc_ids, the one of the earlier call counts as the smaller. The state store's settings hold only while the query starts; it keeps its own copy of them.
    """
    spark = rows.sparkSession
    source, out, checkpoint = f"{state}/in", f"{state}/out", f"{state}/state"
    seen = files_in(spark, source)
    rows = rows.withColumn("turn", F.lit(seen))
    rows.write.mode("append").parquet(source)
    each = -(-(files_in(spark, source) - seen) // triggers)
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, each))
    entries = reader.parquet(source).groupBy("digest").agg(F.min(F.struct("doc_id", "turn", "locator")).alias("first"), F.count(F.lit(1)).alias("group_size"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select("digest", F.col("first.doc_id").alias("keep_id"), "first.turn", "first.locator", "group_size").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = entries.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"digest string, keep_id {kind('doc_id')}, turn int, locator {kind('locator')}, group_size bigint, batch int"
    if not query.lastProgress and not rows.head(1):
        return spark.createDataFrame([], schema).drop("batch", "turn")
    # the identifier only falls and the count only rises, so the last entry of a digest is their minimum and maximum
    return spark.read.schema(schema).parquet(out).groupBy("digest").agg(F.min(F.struct("keep_id", "turn", "locator")).alias("first"), F.max("group_size").alias("group_size")).select("digest", "first.keep_id", "first.locator", "group_size")


def dedup(docs: DataFrame, digest=lambda text: F.sha2(text, 256), triggers: int = TRIGGERS, state: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """(ROW, doc_id, keep_id, group_size, kept, text_sha256) for every row of docs (doc_id, text).

    Null texts count as empty; equal normalised texts form a group, of which the row with the smallest doc_id stays. A
    null doc_id counts as the smallest; of rows that repeat it, one stays. `digest` is a parameter so that tests can
    force collisions.

    With a `state` folder (under the shared folder) the state of earlier calls goes on: `earlier` must hold the rows of
    those calls, from the same files, so that locators lead to their texts. keep_id and group_size then cover all calls.
    Rows whose digests collide are grouped by text within this call.
    """
    text = normalised(text_or_empty())
    described = lambda df: numbered(df.select("doc_id", "text")).select("doc_id", ROW, text.alias("text")).withColumn("digest", digest(F.col("text")))
    keyed = described(docs)
    slim = stored(keyed.select("doc_id", ROW, "digest", F.sha2("text", 256).alias("text_sha256")), "dedup-digests")
    groups = digest_state(slim.select("doc_id", F.col(ROW).alias("locator"), "digest"), state or shared_dir(docs.sparkSession, "dedup"), triggers)
    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    several = stored(groups.where("group_size > 1").withColumn("salts", salts), "dedup-groups")

    # hits: the full texts of all groups of two rows or more. A group is dealt over salts, with one copy of the kept
    # text for each, so that no task gets a whole large group
    looked_up = small(several.select("digest", "locator", "salts"), 100_000)
    hits = stored(keyed.join(looked_up, "digest").withColumn("salt", F.pmod(F.xxhash64(ROW), F.col("salts")).cast("int")), "dedup-hits")
    first = hits.where(F.col(ROW) == F.col("locator")).select("digest", "text", "salts")
    if earlier is not None:
        first = first.unionByName(described(earlier).join(several.select(F.col("locator").alias(ROW), F.col("digest").alias("_d"), "salts"), ROW).where("digest = _d").select("digest", "text", "salts"))
    first = first.select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    odd = stored(hits.join(first, ["digest", "salt"], "left").where(~F.col("text").eqNullSafe(F.col("kept_text"))).select("digest"), "dedup-odd")

    grouped = slim.join(small(several.select("digest", "keep_id", "locator", "group_size"), 100_000), "digest", "left")
    alone = F.col("locator").isNull()
    grouped = grouped.withColumns({"keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("bigint")), "kept": alone | (F.col("locator") == F.col(ROW))})
    if not odd.isEmpty():  # digests collided: these groups are formed by text
        again = hits.join(odd.distinct(), "digest")
        sizes = stored(again.groupBy("digest", "text").agg(F.min(F.struct("doc_id", ROW)).alias("first"), F.count(F.lit(1)).alias("true_size")), "dedup-sizes")
        true = stored(again.select("digest", "text", ROW).join(sizes, ["digest", "text"]).select(ROW, "first", "true_size"), "dedup-true")
        found = F.col("first").isNotNull()
        grouped = grouped.join(true, ROW, "left").withColumns({"keep_id": F.when(found, F.col("first.doc_id")).otherwise(F.col("keep_id")), "kept": F.when(found, F.col(f"first.{ROW}") == F.col(ROW)).otherwise(F.col("kept")), "group_size": F.coalesce("true_size", "group_size")})
    return grouped.select(ROW, "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, dropped ones too."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop(ROW)


OP5_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
