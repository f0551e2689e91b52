"""Sources and sinks: the event stream's JSON, files of text, Parquet staging, keyed latest values."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The event stream's declared schema; it is never inferred. Money and coordinates are doubles from the start.
EVENT_SCHEMA = (
    "transaction_id string, user_id string, device_id string, amount double, merchant_id string, merchant_category string, city string, "
    "latitude double, longitude double, country string, transaction_ts string, is_synthetic_fraud boolean, fraud_pattern string, currency string"
)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors all see, in spark.checkpoint.dir; a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tallyward-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Spark's own file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder; the one above its new place is made if need be."""
    fs, at = file_system(spark, source)
    to = file_system(spark, target)[1]
    fs.mkdirs(to.getParent())
    if not fs.rename(at, to):
        raise OSError(f"{source} can't be moved to {target}")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, for tables that are read more than once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parse_events(raw: DataFrame, column: str = "value", schema: str = EVENT_SCHEMA) -> DataFrame:
    """JSON text to typed columns. Rows without transaction, user or a readable time are dropped; bad JSON is one such."""
    data = raw.select(F.from_json(F.col(column).cast("string"), schema).alias("data")).select("data.*")
    data = data.withColumn("transaction_ts", F.try_to_timestamp("transaction_ts"))
    return data.where("transaction_id is not null and user_id is not null and transaction_ts is not null")


def to_topic(df: DataFrame, key: str, path: str) -> None:
    """df as a keyed topic's messages: key, and the row as JSON. Files stand for the broker, which isn't here."""
    messages = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
    messages.write.mode("append").json(path)


def write_once(df: DataFrame, path: str) -> bool:
    """Seed a table; False, and nothing written, if it has rows."""
    spark = df.sparkSession
    if exists(spark, path):
        fs, at = file_system(spark, path)
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")) and not spark.read.schema(df.schema).parquet(path).isEmpty():
            return False
    df.write.mode("overwrite").parquet(path)
    return True


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of each Markdown file under path."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), F.col("value").alias("text"))


def latest_by_key(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """One row per key: the latest by `at`, ties by the smallest `tie`. Rows are compared in their tasks first."""
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(at, -F.col(tie)))
    return df.where(F.col(at).isNotNull()).groupBy(key).agg(newest.alias("r")).select(key, "r.*")
