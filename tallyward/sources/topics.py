"""A keyed topic in Parquet segments, read as a stream by offsets, and a table that streams write batch by batch.

Both are Spark data sources in Python. Paths are read and written through pyarrow's file systems, so any store that these
know will do (local and mounted folders, hdfs, s3, gs).

The topic: messages have a partition, by the hash of their key, and an offset within it. A segment is one append, and
counts once Spark has committed it. A stream takes at most `maxOffsetsPerTrigger` messages a trigger, shared over the
partitions by how much each has; it notes what it has planned under its group's name, so that a query that starts again
goes on where its checkpoint is, with the same limit.

The table: tasks write files, and a batch's commit lists them under the batch's number in one small file, which appears
whole or not at all. Files that no list names don't exist for readers: a failed task or batch leaves nothing visible, and
a batch that runs again finds its list and adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

#: Partitions of a topic, and the most messages of one trigger: of the scoring stream, and of the velocity stream.
PARTITIONS, SCORING_LIMIT, VELOCITY_LIMIT = 12, 50_000, 10_000
#: Rows of one file of the table.
FILE_ROWS = 50_000
#: Messages of one row group and of one file of a segment: a trigger reads the groups that hold its offsets, however many
#: messages there are. Messages of one task, about: a small trigger is one task that reads of every partition.
GROUP_ROWS, SEGMENT_FILE_ROWS, TASK_ROWS = 5_000, 250_000, 10_000


@dataclass
class OffsetRange:
    """Messages of a partition, from one offset up to another, and the files that hold them."""

    partition: int
    start: int
    end: int
    files: tuple[str, ...] = ()


@dataclass
class TaskRanges(InputPartition):
    """What one task reads."""

    ranges: list[OffsetRange]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def children(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    return fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))


def put_whole(fs: pafs.FileSystem, path: str, text: str) -> None:
    """Write a small file so that readers see all of it or none."""
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(text.encode())
    fs.move(part, path)


def read_text(fs: pafs.FileSystem, path: str) -> str | None:
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as f:
        return f.read().decode()


def segments(fs: pafs.FileSystem, base: str) -> list[str]:
    """The committed segments of a topic, in order."""
    found = sorted(i.path for i in children(fs, base) if i.base_name.startswith("segment="))
    return [p for p in found if fs.get_file_info(f"{p}/_SUCCESS").type == pafs.FileType.File]


def files_of(fs: pafs.FileSystem, segment: str, known: dict[str, list[OffsetRange]]) -> list[OffsetRange]:
    """A segment's files with their offsets, from the files' own statistics."""
    if segment not in known:
        found = []
        for fragment in ds.dataset(segment, filesystem=fs, partitioning="hive", format="parquet").get_fragments():
            meta = fragment.metadata
            offsets = [meta.row_group(g).column(meta.schema.names.index("offset")).statistics for g in range(meta.num_row_groups)]
            if offsets:
                found.append(OffsetRange(int(fragment.path.split("partition=")[1].split("/")[0]), min(x.min for x in offsets), max(x.max for x in offsets) + 1, (fragment.path,)))
        known[segment] = found
    return known[segment]


def topic_files(path: str, known: dict[str, list[OffsetRange]] | None = None) -> list[OffsetRange]:
    """All committed files of a topic; known: those of the segments seen so far."""
    fs, base = opened(path)
    known = {} if known is None else known
    return [f for segment in segments(fs, base) for f in files_of(fs, segment, known)]


def topic_ends(path: str, known: dict[str, list[OffsetRange]] | None = None) -> dict[int, int]:
    """The offset after the last one of each partition."""
    out: dict[int, int] = {}
    for f in topic_files(path, known):
        out[f.partition] = max(out.get(f.partition, 0), f.end)
    return out


def append_to_topic(df: DataFrame, path: str, order: str | None = None, partitions: int = PARTITIONS) -> None:
    """Append df (key, value) as a segment; offsets go on from the last ones, in the order of the column `order` if given.

    A topic has one writer at a time.
    """
    fs, base = opened(path)
    number = len([i for i in children(fs, base) if i.base_name.startswith("segment=")])
    ends = topic_ends(path)
    start = F.get(F.array(*[F.lit(ends.get(p, 0)).cast("bigint") for p in range(partitions)]), F.col("partition"))
    part = F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int")
    w = Window.partitionBy("partition").orderBy(*([order] if order else []), "key", "value")
    rows = df.withColumn("partition", part).withColumn("offset", start + F.row_number().over(w) - 1)
    sizes = {"parquet.block.row.count.limit": str(GROUP_ROWS), "maxRecordsPerFile": str(SEGMENT_FILE_ROWS)}
    rows.select("partition", "offset", "key", "value").write.options(**sizes).partitionBy("partition").parquet(f"{path}/segment={number:09d}")


class TopicStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.limit = int(options.get("maxoffsetspertrigger", options.get("maxOffsetsPerTrigger", SCORING_LIMIT)))
        self.group = options.get("group")
        self.known: dict[str, list[OffsetRange]] = {}
        self.at: dict[int, int] | None = None

    def noted(self) -> tuple[pafs.FileSystem, str]:
        fs, base = opened(self.path)
        return fs, f"{base}/groups/{self.group}.json"

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """The offsets that one trigger more reaches: those planned before, and the limit's share of what each partition has."""
        if self.at is None:
            text = read_text(*self.noted()) if self.group else None
            self.at = {int(p): n for p, n in json.loads(text).items()} if text else {}
        ends = topic_ends(self.path, self.known)
        left = {p: end - self.at.get(p, 0) for p, end in sorted(ends.items()) if end > self.at.get(p, 0)}
        total = sum(left.values())
        taken = {p: n if total <= self.limit else n * self.limit // total for p, n in left.items()}
        for p in sorted(left, key=lambda p: taken[p] - left[p]):  # what rounding left over
            if total > self.limit > sum(taken.values()):
                taken[p] += min(left[p] - taken[p], self.limit - sum(taken.values()))
        self.at = {p: self.at.get(p, 0) + taken.get(p, 0) for p in self.at | taken}
        return {str(p): n for p, n in self.at.items()}

    def partitions(self, start: dict, end: dict) -> list[TaskRanges]:
        self.at = {int(p): n for p, n in end.items()}
        if self.group:
            put_whole(*self.noted(), json.dumps(end))
        files, tasks, room = topic_files(self.path, self.known), [], 0
        for p, n in end.items():
            low = start.get(p, 0)
            while low < n:
                if not room:
                    tasks.append(TaskRanges([]))
                    room = TASK_ROWS
                high = min(n, low + room)
                tasks[-1].ranges.append(OffsetRange(int(p), low, high, tuple(f.files[0] for f in files if f.partition == int(p) and f.start < high and f.end > low)))
                low, room = high, room - (high - low)
        return tasks

    def read(self, partition: TaskRanges) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        for r in partition.ranges:
            for path in r.files:
                with fs.open_input_file(path) as source:
                    yield from self.within(pq.ParquetFile(source), r)

    def within(self, file: pq.ParquetFile, r: OffsetRange) -> Iterator[pa.RecordBatch]:
        """A range's messages, from the row groups that hold some."""
        at = file.metadata.schema.names.index("offset")
        held = [(g, file.metadata.row_group(g).column(at).statistics) for g in range(file.num_row_groups)]
        groups = [g for g, x in held if x.min < r.end and x.max >= r.start]
        if not groups:
            return
        rows = file.read_row_groups(groups, columns=["offset", "key", "value"], use_threads=False)
        rows = rows.filter((pc.field("offset") >= r.start) & (pc.field("offset") < r.end))
        for batch in rows.to_batches():
            yield pa.record_batch([pa.array([r.partition] * batch.num_rows, pa.int32()), batch.column("offset"), batch.column("key").cast(pa.string()), batch.column("value").cast(pa.string())], names=["partition", "offset", "key", "value"])


class Topic(DataSource):
    """Options: path; maxOffsetsPerTrigger (50,000); group, the name under which a restarted query goes on."""

    @classmethod
    def name(cls) -> str:
        return "tallyward_topic"

    def schema(self) -> str:
        return "partition int, offset bigint, key string, value string"

    def streamReader(self, schema) -> TopicStream:  # noqa: N802
        return TopicStream(self.options)


def topic_stream(spark: SparkSession, path: str, group: str, limit: int = SCORING_LIMIT) -> DataFrame:
    """The topic's messages (partition, offset, key, value) as a stream of at most `limit` a trigger."""
    spark.dataSource.register(Topic)
    return spark.readStream.format("tallyward_topic").option("path", path).option("maxOffsetsPerTrigger", str(limit)).option("group", group).load()


# ---- the table


@dataclass
class Written(WriterCommitMessage):
    files: list
    rows: int


class TableBatch:
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rows = options["path"], int(options.get("rowsperfile", options.get("rowsPerFile", FILE_ROWS)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Write a task's rows as files that nobody sees yet."""
        fs, base = opened(self.path)
        fs.create_dir(f"{base}/data", recursive=True)
        files, total, writer, room = [], 0, None, 0
        try:
            for batch in iterator:
                at = 0
                while at < batch.num_rows:
                    if not room:
                        if writer:
                            writer.close()
                        files.append(f"data/{uuid.uuid4().hex}.parquet")
                        writer, room = pq.ParquetWriter(f"{base}/{files[-1]}", batch.schema, filesystem=fs, compression="snappy"), self.rows
                    n = min(room, batch.num_rows - at)
                    writer.write_batch(batch.slice(at, n))
                    at, room, total = at + n, room - n, total + n
        finally:
            if writer:
                writer.close()
        return Written(files, total)

    def listed(self, batch: str) -> tuple[pafs.FileSystem, str, str]:
        fs, base = opened(self.path)
        return fs, base, f"{base}/batches/{batch}.json"

    def finish(self, messages: list, batch: str) -> None:
        fs, base, path = self.listed(batch)
        if fs.get_file_info(path).type == pafs.FileType.File:
            self.drop(messages)
            return
        put_whole(fs, path, json.dumps({"files": [f for m in messages if m for f in m.files], "rows": sum(m.rows for m in messages if m)}))

    def drop(self, messages: list) -> None:
        fs, base = opened(self.path)
        for file in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{base}/{file}")


class TableWriter(TableBatch, DataSourceArrowWriter):
    """A batch write; the option `batch` names it, so that it counts once however often it runs."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.batch = options.get("batch") or uuid.uuid4().hex

    def commit(self, messages: list) -> None:
        self.finish(messages, self.batch)

    def abort(self, messages: list) -> None:
        self.drop(messages)


class TableStreamWriter(TableBatch, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.finish(messages, f"{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.drop(messages)


class CommittedTable(DataSource):
    """Options: path; rowsPerFile (50,000); batch, the name of a batch write."""

    @classmethod
    def name(cls) -> str:
        return "tallyward_table"

    def writer(self, schema, overwrite: bool) -> TableWriter:
        return TableWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> TableStreamWriter:  # noqa: N802
        return TableStreamWriter(self.options)


def append_committed(df: DataFrame, path: str, batch: str | None = None, rows_per_file: int = FILE_ROWS) -> None:
    """Append df as one batch; a batch of a name that is there already adds nothing."""
    df.sparkSession.dataSource.register(CommittedTable)
    writer = df.write.format("tallyward_table").mode("append").option("path", path).option("rowsPerFile", str(rows_per_file))
    (writer.option("batch", batch) if batch else writer).save()


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches; the file lists, one small file a batch, are read on the driver."""
    fs, base = opened(path)
    lists = [json.loads(read_text(fs, i.path)) for i in children(fs, f"{base}/batches") if i.path.endswith(".json")]
    files = [f"{path.rstrip('/')}/{f}" for x in lists for f in x["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
