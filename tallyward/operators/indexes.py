"""Stored indexes for search: an inverted index of words that takes upserts, and an inverted file of vectors.

Words. A batch of chunks becomes a segment: postings by term, in buckets of terms, in blocks of a term's ids in order; the
lengths of its chunks; and the ids of earlier segments that its chunks replace. Nothing that is written is changed. A
search reads the buckets of its terms and the replaced ids, so it costs what its terms cost, whatever else there is.

Vectors. Centres are trained on a bounded sample, and every vector lies in the cell of its nearest centre. A query looks
into the cells nearest to it. Cells are dealt over parts of bounded size, so that no cell is one task's work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.operators.retrieval import B, K1, terms
from tallyward.sources.io import exists, file_system, written

#: Buckets of terms, and postings in a block.
TERM_BUCKETS, BLOCK = 64, 4_096


def term_bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def segments_of(spark: SparkSession, path: str) -> list[int]:
    """The numbers of an index's whole segments, in order; a segment is whole once its last part is."""
    if not exists(spark, path):
        return []
    fs, at = file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/postings/_SUCCESS"))
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("segment=") and whole(n))


CHUNKS, GONE = "id bigint, len bigint", "id bigint, segment int, len bigint"
POSTINGS = "term string, ids array<bigint>, tfs array<bigint>, lens array<bigint>, bucket int"


def upsert_chunks(chunks: DataFrame, path: str, vectors: DataFrame | None = None) -> int:
    """Add chunks (id, text) to the index as one segment, in the place of those that have their ids; the segment's number.

    vectors (id, embedding), if given, must be one for each chunk: otherwise ValueError, and nothing is written. An id
    that comes twice in a batch, or a missing one, is refused as well. A null text has no words.
    """
    spark = chunks.sparkSession
    own = written(chunks.select(F.col("id").cast("bigint").alias("id"), F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("ts")), "chunks")
    n, ids, missing = own.agg(F.count(F.lit(1)), F.count_distinct("id"), F.count_if(F.col("id").isNull())).first()
    if missing or ids != n:
        raise ValueError(f"{n} chunks have {ids} ids, and {missing} have none")
    if vectors is not None:
        given, matched = vectors.count(), vectors.join(own, "id", "left_semi").select("id").distinct().count()
        if (given, matched) != (n, n):
            raise ValueError(f"{n} chunks and {given} vectors, of which {matched} match")
    earlier = segments_of(spark, path)
    number = max(earlier, default=-1) + 1
    at = f"{path}/segment={number:06d}"
    own.select("id", F.size("ts").cast("bigint").alias("len")).write.mode("overwrite").parquet(f"{at}/chunks")
    held = live_chunks(spark, path, earlier)
    held.join(own.select("id"), "id", "left_semi").select("id", "segment", "len").write.mode("overwrite").parquet(f"{at}/gone")
    each = own.select("id", F.size("ts").cast("bigint").alias("len"), F.explode("ts").alias("term")).groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    # a term's blocks are cut by its ids, so that the postings of a very common term are many rows of bounded size
    cut = each.withColumns({"bucket": term_bucket(F.col("term")), "block": F.floor(F.col("id") / BLOCK)})
    rows = F.array_sort(F.collect_list(F.struct("id", "tf", "len")))
    blocks = cut.groupBy("bucket", "term", "block").agg(rows.alias("p")).select("term", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"), "bucket")
    blocks.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings")
    return number


def union_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_part(spark: SparkSession, path: str, segments: list[int], part: str, schema: str) -> DataFrame:
    """A part of all segments, with the segment's number."""
    frames = [spark.read.schema(schema).parquet(f"{path}/segment={n:06d}/{part}").withColumn("of", F.lit(n)) for n in segments]
    return union_of(frames) if frames else spark.createDataFrame([], f"{schema}, of int")


def live_chunks(spark: SparkSession, path: str, segments: list[int]) -> DataFrame:
    """(id, segment, len) of the chunks that nothing has replaced."""
    gone = read_part(spark, path, segments, "gone", GONE).select("id", "segment")
    return read_part(spark, path, segments, "chunks", CHUNKS).select("id", F.col("of").alias("segment"), "len").join(gone, ["id", "segment"], "left_anti")


def live_postings(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """(term, id, tf, len) of the wanted terms: only their buckets are read."""
    segments = segments_of(spark, path)
    buckets = sorted({r.b for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(term_bucket(F.col("t")).alias("b")).collect()})
    blocks = read_part(spark, path, segments, "postings", POSTINGS).where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
    each = blocks.select("term", F.col("of").alias("segment"), F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p")).select("term", "segment", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
    return each.join(read_part(spark, path, segments, "gone", GONE).select("id", "segment"), ["id", "segment"], "left_anti").drop("segment")


def search_words(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id, score) of the chunks with a term of the query: the scores that a search of all texts gives."""
    wanted = sorted({t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
    if not wanted or not segments_of(spark, path):
        return spark.createDataFrame([], "id bigint, score double")
    segments = segments_of(spark, path)
    sums = lambda part, schema: read_part(spark, path, segments, part, schema).agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    (n, length), (lost, lost_length) = sums("chunks", CHUNKS), sums("gone", GONE)
    n_docs, mean = n - lost, (length - lost_length) / (n - lost) if length > lost_length else 1.0
    found = written(live_postings(spark, path, wanted), "postings")
    df = {r.term: r.df for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # one row a term of the query
    idf = {t: math.log(1 + (n_docs - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    if not idf:
        return spark.createDataFrame([], "id bigint, score double")
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in idf.items() for x in pair]), F.col("term"))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    return found.groupBy("id").agg(F.sum(part).alias("score")).where("score > 0")


# ---- vectors

#: Vectors that centres are trained on at most (of the smallest hashes), and rounds of training.
TRAINED_ON, ROUNDS = 20_000, 12
#: Vectors of one part of a cell, about.
PART_ROWS = 20_000
#: How many cells a query looks into is told by the sample: as many as hold this share of its vectors' nearest ones, told
#: by so many of them.
SURE, SURE_BY, NEAREST = 0.96, 400, 10


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows to length 1; rows of zeros stay."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class Cells:
    """Centres of cells (unit vectors), and how many cells a query looks into."""

    centres: np.ndarray
    probed: int


def train_cells(vectors: DataFrame, cells: int, seed: int = 7) -> Cells:
    """Cells by spherical k-means, on a sample of TRAINED_ON vectors at most.

    How many of them to look into is measured on the same sample: where vectors stand in clusters a few do, where they
    don't it is most of them, and the index says so by what it reads.
    """
    sample = vectors.where("embedding is not null").orderBy(F.xxhash64("id", F.lit(seed))).limit(TRAINED_ON).select("embedding").toArrow()
    x = scaled(matrix(sample.column("embedding").combine_chunks()))
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        filled = np.bincount(nearest, minlength=len(centres)) > 0
        centres = scaled(np.where(filled[:, None], sums, centres))
    if not len(x):
        return Cells(np.zeros((1, 1)), 1)
    nearest, asked = np.argmax(x @ centres.T, axis=1), x[rng.permutation(len(x))[:SURE_BY]]
    turns = []
    for q in asked:
        place = np.empty(len(centres), np.int64)
        place[np.argsort(-(centres @ q), kind="stable")] = np.arange(len(centres))
        turns.append(place[nearest[np.argsort(-(x @ q), kind="stable")[:NEAREST]]])
    return Cells(centres, int(np.quantile(np.concatenate(turns), SURE, method="higher")) + 1)


def into_cells(batches: Iterator[pa.RecordBatch], centres: np.ndarray, probed: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, embedding) with their `probed` nearest cells."""
    for batch in batches:
        likeness = scaled(matrix(batch.column(1))) @ centres.T if batch.num_rows else np.zeros((0, len(centres)))
        cells = np.argsort(-likeness, axis=1, kind="stable")[:, :probed]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel().astype(np.int32)))
        yield pa.record_batch([*batch.columns, lists], names=["id", "embedding", "cells"])


def with_cells(vectors: DataFrame, centres: np.ndarray, probed: int) -> DataFrame:
    return vectors.select("id", "embedding").where("embedding is not null").mapInArrow(partial(into_cells, centres=centres, probed=probed), "id bigint, embedding array<float>, cells array<int>")


def build_vectors(vectors: DataFrame, path: str, cells: int | None = None) -> Cells:
    """Store vectors (id, embedding) by cell, the cells dealt over parts; the cells. Null embeddings are left out.

    Without a number of cells there are about as many as the square root of the vectors.
    """
    n = vectors.count()
    made = train_cells(vectors, cells or max(1, math.isqrt(n)))
    stored = written(with_cells(vectors, made.centres, 1).select("id", "embedding", F.get("cells", F.lit(0)).alias("cell")), "vector-cells")
    sizes = stored.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    dealt = stored.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # one row a cell
    dealt.repartition("cell", "part").write.mode("overwrite").parquet(path)
    return made


def best_of_part(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """(query, id, score): each query's k nearest of the rows of one part of a cell."""
    x, q = scaled(matrix(rows.column("embedding").combine_chunks())), scaled(matrix(queries.column("embedding").combine_chunks()))
    ids, own = rows.column("id").to_numpy(), queries.column("id").to_numpy()
    out = []
    for at in range(0, len(q), 256):
        likeness = q[at : at + 256] @ x.T
        for i, row in enumerate(likeness):
            top = np.lexsort((ids, -row))[:k]
            out.append((np.full(len(top), own[at + i]), ids[top], row[top]))
    parts = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)]
    return pa.table({"query": pa.array(parts[0], pa.int64()), "id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})


def search_vectors(queries: DataFrame, path: str, cells: Cells, k: int = NEAREST, probed: int | None = None) -> DataFrame:
    """(query, rank, id, score): for each row of queries (id, embedding) the k nearest vectors by cosine in the cells that it looks into."""
    spark = queries.sparkSession
    rows = spark.read.parquet(path)
    probed = min(len(cells.centres), probed or cells.probed)
    parts = written(rows.select("cell", "part").distinct(), "vector-parts")
    asked = with_cells(queries, cells.centres, probed).select("id", "embedding", F.explode("cells").alias("cell")).join(F.broadcast(parts), "cell")  # one row a part
    found = rows.select("cell", "part", "id", "embedding").groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(lambda rows, queries: best_of_part(rows, queries, k), "query bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")

