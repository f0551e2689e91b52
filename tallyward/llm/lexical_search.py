"""Ranked lexical search by the Best Position Algorithm, over shards of documents.

1. Each document becomes one index row: its number of terms and, of the terms that some item asks for, their numbers and
   frequencies. The index is written once; the corpus figures (documents, terms, document frequencies) are sums over it.
2. Tasks read the index in shards of bounded size. Within a shard every term has an impact list, its postings by falling
   impact, and a directory by document for direct accesses. An item reads its lists in turn, block by block; every
   document that it meets is looked up at once in all the item's lists, which gives its whole score and marks its place
   in each of them. A list's best position is the end of its run of marked places from the top; no document that hasn't
   been met can have more than the impacts there, summed over the lists. Once that sum is strictly below the k-th best
   score, the item is done with the shard; documents that tie with the k-th are thus all met, and the smallest doc_ids
   of them stay.
3. The shards' best documents are merged per item, salted first.

A task carries each item's best scores from shard to shard, so later shards stop sooner. Items come in blocks of bounded
size, each with an index of its own, so that what travels to the tasks doesn't grow with the items' table.

Rows: every row of the items' table is an item of its own, and every row of documents a document of its own, whether or
not ids repeat or are missing. Null and empty texts have no terms: such items give no rows, such documents none either,
and N doesn't count them. A null doc_id comes after all others among equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, numbered, small, stored, table

TOP = 50
#: Distinct terms of the items of one block, about, and postings of one shard, about.
BLOCK_TERMS, SHARD_POSTINGS = 1 << 20, 1 << 21
#: Places that an item first reads of each list; every round reads twice as many.
FIRST_PLACES = 32
#: Bytes of text that are split at a time.
CHUNK = 1 << 20
SALTS = 16
#: Bytes of terms, A-Z in lower case, all others as spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in order, stretch by stretch."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(FOLD), 0
    while at < len(data):
        cut = data.find(b" ", at + CHUNK)
        cut = len(data) if cut < 0 else cut
        yield data[at:cut].split()
        at = cut


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch's columns but for text (the last), then the distinct terms."""
    for batch in batches:
        lists = [sorted({t for part in terms_of(x.as_py()) for t in part}) for x in batch.column(batch.num_columns - 1)]
        yield pa.record_batch([*batch.columns[:-1], pa.array(lists, pa.list_(pa.binary()))], names=[*batch.schema.names[:-1], "terms"])


INDEX = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"


def index_rows(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Index rows of (doc_id, text), for the documents that have terms."""
    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        kept, sizes, own, tfs = [], [], [], []
        for row, text in enumerate(batch.column(1)):
            n, found = 0, []
            for part in terms_of(text.as_py()):
                n += len(part)
                found.append(np.fromiter((numbers.get(t, -1) for t in part), np.int32, len(part)))
            if n:
                ids = np.concatenate(found)
                ids, counts = np.unique(ids[ids >= 0], return_counts=True)
                kept.append(row)
                sizes.append(n)
                own.append(ids)
                tfs.append(counts.astype(np.int32))
        offsets = pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32))
        flat = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32), pa.int32())) for x in (own, tfs)]
        yield pa.record_batch([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *flat], names=["doc_id", "n", "terms", "tfs"])


class Shard:
    """Impact lists of all terms over some documents, which are numbered by ascending doc_id."""

    def __init__(self, owner: np.ndarray, terms: np.ndarray, impacts: np.ndarray, documents: int, n_terms: int) -> None:
        order = np.lexsort((owner, -impacts, terms))
        self.owner, self.impacts = owner[order], impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        keys = terms[order].astype(np.int64) * documents + self.owner
        self.directory = np.argsort(keys)
        self.keys, self.documents = keys[self.directory], documents

    def access(self, terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Direct accesses of docs in the lists of terms: (which term, which document, place among all postings) of the hits."""
        wanted = (terms[:, None] * self.documents + docs).ravel()
        spot = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[spot] == wanted)
        return hit // len(docs), hit % len(docs), self.directory[spot[hit]]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that hold the k best of this shard, all positive; known: the item's k best scores so far, ascending."""
        terms, weights = terms[weights > 0], weights[weights > 0]
        begin, length = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        terms, weights, begin, length = (x[length > 0] for x in (terms, weights, begin, length))
        base = np.cumsum(np.append(0, length))
        marked = np.zeros(base[-1], bool)
        best = np.zeros(len(terms), np.int64)
        met = np.zeros(self.documents, bool)
        docs, scores, step = [np.zeros(0, np.int64)], [known], FIRST_PLACES
        while True:
            places = [np.arange(b, min(n, b + step)) for b, n in zip(best.tolist(), length.tolist(), strict=True)]
            fresh = np.concatenate([self.owner[s + p[~marked[o + p]]] for s, o, p in zip(begin, base[:-1], places, strict=True)] or [np.zeros(0, np.int64)])
            fresh = np.unique(fresh[~met[fresh]])
            if len(fresh):
                met[fresh] = True
                term, doc, place = self.access(terms, fresh)
                marked[base[term] + place - begin[term]] = True
                total = np.zeros(len(fresh), np.int64)
                np.add.at(total, doc, weights[term] * self.impacts[place])
                docs.append(fresh)
                scores.append(total)
            bound = 0
            for t in range(len(terms)):
                rest = marked[base[t] + best[t] : base[t + 1]]
                run = int(np.argmin(rest)) if len(rest) else 0
                best[t] += len(rest) if len(rest) and rest[run] else run
                if best[t] < length[t]:
                    bound += int(weights[t]) * int(self.impacts[begin[t] + best[t] - 1])
            every = np.concatenate(scores)
            if not bound or len(every) >= k and np.partition(every, len(every) - k)[len(every) - k] > bound:
                return np.concatenate(docs), np.concatenate([np.zeros(0, np.int64), *scores[1:]])
            step *= 2


def search(batches: Iterator[pa.RecordBatch], items: list[np.ndarray], weights: np.ndarray, documents: int, words: int, k: int, shard_postings: int) -> Iterator[pa.RecordBatch]:
    """(item, doc_id, score): each item's k best documents of all shards of a task."""
    best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3 for _ in items]
    own = [weights[x] for x in items]

    def add(held: pa.Table) -> None:
        held = held.sort_by("doc_id")  # nulls come last
        n = held.column("n").to_numpy()
        lists = held.column("terms").combine_chunks()
        owner = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy(zero_copy_only=False))
        terms, tfs = (np.asarray(held.column(c).combine_chunks().flatten(), np.int64) for c in ("terms", "tfs"))
        if not len(terms):
            return
        m = 100 - 50 + 50 * n * documents // words
        impacts = 1_000_000_000 * tfs // (1000 * tfs + 20 * m[owner])
        shard = Shard(owner, terms, impacts, len(n), len(weights))
        ids, missing = held.column("doc_id").fill_null(0).to_numpy(), np.asarray(held.column("doc_id").is_null())
        for item, asked in enumerate(items):
            old = best[item]
            known = np.sort(old[2])
            docs, scores = shard.best(asked, own[item], k, known)
            both = (np.append(old[0], missing[docs]), np.append(old[1], ids[docs]), np.append(old[2], scores))
            top = np.lexsort((both[1], both[0], -both[2]))[:k]
            best[item] = tuple(x[top] for x in both)

    parts: list[pa.RecordBatch] = []
    postings = 0
    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        parts.append(batch)
        postings += len(batch.column(2).flatten())
        if postings >= shard_postings:
            add(pa.Table.from_batches(parts))
            parts, postings = [], 0
    if parts:
        add(pa.Table.from_batches(parts))
    for item, (missing, ids, scores) in enumerate(best):
        if len(ids):
            yield pa.record_batch([pa.array(np.full(len(ids), item, np.int32)), pa.array(ids, mask=missing.astype(bool)), pa.array(scores)], names=["item", "doc_id", "score"])


def top_rows(found: DataFrame, k: int) -> DataFrame:
    """The k best rows (item, doc_id, score) of each item with their rank; groups are salted, then merged."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return first.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items (item_id, text), its k best rows of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    rows = numbered(items.select("item_id", "text"))
    asked = rows.select(F.xxhash64(ROW).alias("place"), "item_id", "text").mapInArrow(item_terms, f"place bigint, item_id {kind}, terms array<binary>").where(F.size("terms") > 0)
    asked = stored(asked, "search-items")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        chosen = asked.where(F.pmod("place", F.lit(blocks)) == block).orderBy("place").toArrow()  # bounded by block_terms, about
        if not chosen.num_rows:
            continue
        lists = chosen.column("terms").combine_chunks()
        flat = lists.flatten().dictionary_encode()
        numbers = {t: i for i, t in enumerate(flat.dictionary.to_pylist())}
        cuts = np.cumsum(np.append(0, lists.value_lengths().to_numpy(zero_copy_only=False)))
        own = [np.asarray(flat.indices, np.int64)[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        index = stored(docs.mapInArrow(partial(index_rows, numbers=numbers), INDEX), "search-index")
        documents, words = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            break
        seen = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df = np.zeros(len(numbers), np.int64)
        df[seen.column("term").to_numpy()] = seen.column("df").to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        found = index.mapInArrow(partial(search, items=own, weights=weights, documents=documents, words=words, k=k, shard_postings=shard_postings), "item int, doc_id bigint, score bigint")
        found = stored(top_rows(stored(found, "search-found"), k), "search-ranked")
        names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(chosen.num_rows), pa.int32()), "item_id": chosen.column("item_id")}))
        out = out.unionAll(found.join(small(names, 200_000), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's 50 highest-scoring documents."""
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT *, len(ts)::BIGINT AS n, row_number() OVER () AS place FROM (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL) WHERE len(ts) > 0),
s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM d),
i AS (SELECT *, row_number() OVER () AS item FROM (SELECT item_id, {_TERMS} AS ts FROM benchmark WHERE text IS NOT NULL)),
q AS (SELECT DISTINCT item, item_id, term FROM (SELECT item, item_id, unnest(ts) AS term FROM i)),
p AS (SELECT place, doc_id, n, term, count(*) AS tf FROM (SELECT place, doc_id, n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
m AS (SELECT place, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l)) AS x FROM p, s),
r AS (SELECT item, item_id, place, doc_id, sum(w * x)::BIGINT AS score FROM q JOIN m USING (term) JOIN w USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST))::INTEGER AS rank FROM r WHERE score > 0) WHERE rank <= 50
"""
