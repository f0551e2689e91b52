"""Helpers that the corpus operators share: shared folders, written tables, row identifiers, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as all operators understand them (ASCII space, tab to carriage return).
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The column that numbered() adds.
ROW = "_tallyward_row"


#: The folders that shared_dir() has given out in this process.
GIVEN: list[str] = []


def clear_shared(spark: SparkSession) -> int:
    """Delete the folders that operators have written so far; how many there were.

    Results are read from these folders, so call it once what is wanted has been written elsewhere.
    """
    n = 0
    while GIVEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(GIVEN.pop())
        n += at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    return n


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors all see.

    It lies in spark.checkpoint.dir. Only on one machine (a local master, as in tests) may that be unset: a temporary
    folder is made then. On a cluster it must be set, since executors don't see the driver's own folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tallyward-")
        spark.conf.set("spark.checkpoint.dir", base)
    GIVEN.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return GIVEN[-1]


#: Rows that go to a Python worker at a time while tables are stored: whole texts are in memory on both sides.
BATCH_ROWS, BATCH_SETTING = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation.

    `tasks` is for tables whose size is known: they are written by so many tasks at most, however many partitions a
    shuffle has, so that the many short steps over a small table don't wait for hundreds of empty tasks each.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(BATCH_SETTING)
    if not 0 < int(before) < BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    try:
        (df.coalesce(tasks) if tasks else df).write.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at the path, asked of its own file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """df marked for broadcast if it has at most most_rows rows (they are counted), else df as it is: a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_scan(df: DataFrame) -> bool:
    """Whether df is one table's rows, filtered and projected at most, so that no row of the table is in it twice."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return "Relation" in plan.nodeName()


def numbered(df: DataFrame) -> DataFrame:
    """df with ROW: what tells a row from all others, repeats included, however often the row is computed.

    It is the hash of the Parquet file's path and the row's place in the file; a df that isn't read from one table is
    written first.
    """
    row = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    if one_scan(df):
        try:
            return df.withColumn(ROW, row)
        except AnalysisException as e:  # other formats have no row numbers
            if "_metadata" not in str(e):
                raise
    return stored(df, "numbered-rows").withColumn(ROW, row)
