"""Best-fit packing into sequences of several permitted lengths.

Documents are dealt by a hash into groups of bounded size, each packed by one task. A document longer than the longest
permitted sequence is cut into pieces of that length. In a group, pieces go by falling size into the open bin that they
leave the least room in. If none has room, a bin is opened. How long a bin is opened is chosen for all permitted lengths
together: the group is packed once under each opening rule (never shorter than one of the lengths; or the length that
costs least for each token that it can still be filled with), each bin is reduced to the shortest permitted length that
holds its contents, and the packing of the least total cost stays. A bin's cost has a fixed part, a part by length, and
a part by its square.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, WORD, numbered, table, text_or_empty

LENGTHS = (256, 512, 1024, 2048, 4096)
#: Cost of a sequence of c tokens: FIXED + c + c * c / SPAN.
FIXED, SPAN = 32.0, 65_536.0
GROUP_DOCS = 2_048


def cost(length: int) -> float:
    return FIXED + length + length * length / SPAN


def pack_by(sizes: Sequence[int], lengths: Sequence[int], floor: int | None) -> tuple[list[int], list[int], list[int], list[int]]:
    """pack() under one opening rule: bins of `floor` or longer; with None, of the least cost per token."""
    rest = sum(sizes)
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    bins, offsets, filled = [], [], []
    for size in sizes:
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            b = len(filled)
            holding = [c for c in lengths if c >= size]
            if floor is None:  # the bin can be filled with what is left at most
                room = min(holding, key=lambda c: (cost(c) / max(1, min(c, rest)), c))
            else:
                room = next((c for c in holding if c >= floor), holding[-1])
            filled.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += size
        rest -= size
        if room > size:
            insort(rooms, (room - size, b))
    return bins, offsets, [next(c for c in lengths if c >= f) for f in filled], filled


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of each piece, and capacity and content of each bin; sizes must fall and none exceed a length.

    Of the opening rules, the one of least total cost; ties go to the shorter floor.
    """
    lengths = sorted(lengths)
    return min((pack_by(sizes, lengths, floor) for floor in (*lengths, None)), key=lambda p: sum(map(cost, p[2])))


PIECES = "doc_id bigint, piece int, start bigint, words bigint, bin_group bigint, bin int, bin_offset bigint, capacity bigint, filled bigint, bin_cost double"


def pack_group(rows: pa.Table, lengths: Sequence[int] = LENGTHS) -> pa.Table:
    words, copy, piece = (rows.column(c).to_numpy() for c in ("words", "copy", "piece"))
    rows = rows.take(pa.array(np.lexsort((piece, copy, -words))))
    bins, offsets, capacity, filled = pack(rows.column("words").to_pylist(), lengths)
    own = {"bin": pa.array(bins, pa.int32()), "bin_offset": pa.array(offsets, pa.int64()), "capacity": pa.array([capacity[b] for b in bins], pa.int64()), "filled": pa.array([filled[b] for b in bins], pa.int64()), "bin_cost": pa.array([cost(capacity[b]) for b in bins], pa.float64())}
    return pa.table({name: own[name] if name in own else rows.column(name) for name in (c.split()[0] for c in PIECES.split(", "))})


def pack_documents(docs: DataFrame, lengths: Sequence[int] = LENGTHS, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece of docs (doc_id, text): its words from `start`, and its place in bin (bin_group, bin).

    Null and empty texts are one piece of 0 words; a null doc_id stays null. Rows that repeat are packed each for
    itself, and dealt over the groups by their place in the table (file and row), so that no text fills a group by its
    copies, however they are spread over files.
    """
    lengths = tuple(sorted(set(lengths)))
    longest = lengths[-1]
    groups = max(1, -(-docs.count() // group_docs))
    words = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint")
    sized = numbered(docs.select("doc_id", "text")).select(F.col("doc_id").cast("bigint").alias("doc_id"), words.alias("size"), F.xxhash64("doc_id", "text").alias("copy"), F.xxhash64(ROW).alias("place"))
    sized = sized.withColumn("bin_group", F.pmod("place", F.lit(groups)))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / longest).cast("int") - 1))))
    pieces = pieces.withColumn("start", F.col("piece").cast("bigint") * longest).withColumn("words", F.least(F.col("size") - F.col("start"), F.lit(longest)).cast("bigint"))
    return pieces.select("doc_id", "piece", "start", "words", "copy", "bin_group").groupBy("bin_group").applyInArrow(lambda rows: pack_group(rows, lengths), PIECES)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bins."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
