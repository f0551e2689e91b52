"""Phrase collocations per language by best-first branch and bound.

A phrase of 2 to 5 words that occurs often enough scores by its weakest cut: a * n / (l * r), where a is its count, l and r
the counts of the two parts, and n the words of the language. As r is at least a, no phrase that begins with a word of
count l scores above n / l: the counts of prefixes bound what can grow from them. So first words are expanded by falling
bound, that is, from rare to frequent:

1. Words are counted, and the texts rewritten once as numbers of frequent words, with a break wherever a piece ends or an
   infrequent word stands: no phrase that is counted can reach over one.
2. A round takes the first words down to some count of each language. Their phrases grow word by word: a pass over the
   numbers counts all one-word extensions of the prefixes that are left, and those that occur too seldom are cut off,
   with all that would grow from them. With the counts come the smallest and largest word before each phrase: if they are
   the same, the phrase occurs only after that word.
3. A phrase survives unless an extension by one word, to the right or to the left, is as frequent. (Were a longer one, all
   between would be; so one word is enough.) Survivors are scored by the cuts whose counts are known; of those that can
   still reach the threshold, parts that begin with words not yet expanded are counted in a pass of their own, and the
   scores become exact.
4. The threshold of a language is its 2000th surviving score. Once there is one, the next round takes the first words
   whose bound reaches it, ties included, and then the language is settled; until there is one, rounds take ever more
   frequent words.

Counts are over all texts. The numbers of frequent words and the prefixes of a round travel to the tasks; both have a
bound (MOST_WORDS, and BATCH prefixes: a round that could have more is dealt over several batches by its first words,
whose counts bound how many prefixes they have). With more frequent words than MOST_WORDS, texts are rewritten by a join.

Rows: null and empty texts have no words; a null lang is "und", as is "und" itself. Rows that repeat count as often as
they stand there. Phrases of equal score and count are ordered by their bytes. Scores are exact: products are decimals of
38 digits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored, table

TOP, LEAST_COUNT, MOST_LENGTH = 2000, 100, 5
#: Frequent words that travel to the tasks, and prefixes of one batch, at most.
MOST_WORDS, BATCH = 1 << 20, 1 << 20
#: The share of all frequent words' occurrences that the first round's first words have, about.
FIRST_SHARE = 0.06
#: Buckets that frequent words are numbered by, and the largest number that is looked up in an array.
BUCKETS, LOOKUP = 256, 1 << 24
#: Bytes of text that are split at a time, words counted before they are sent, and numbers in one row.
CHUNK, HELD_WORDS, ROW_NUMBERS = 1 << 20, 1 << 19, 1 << 19
#: What ends a piece, and A-Z in lower case.
PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEPARATOR = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")


def stretches(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, stretch by stretch, with b"." where pieces end."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(LOWER), 0
    while at < len(data):
        cut = SEPARATOR.search(data, min(len(data), at + CHUNK))
        end = cut.start() if cut else len(data)
        yield PIECE_END.sub(b" . ", data[at:end]).split()
        at = end


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of rows (lang, text): each task's own counts, sent whenever it holds many words."""
    held: dict[str, Counter] = {}
    size = 0

    def packed() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, counts in held.items() for w, n in counts.items() if w != b"."]
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = held.setdefault(lang, Counter())
            for words in stretches(text.as_py()):
                before = len(counts)
                counts.update(words)
                size += len(counts) - before
            if size >= HELD_WORDS:
                yield packed()
                held, size = {}, 0
    if held:
        yield packed()


def runs(numbers: np.ndarray) -> np.ndarray:
    """Numbers without the breaks and words that no phrase can have: runs of two or more stay, each after a break."""
    good = numbers >= 0
    beside = np.zeros(len(good), bool)
    beside[1:] |= good[:-1]
    beside[:-1] |= good[1:]
    kept = good & beside
    # one break stays before each run
    start = kept.copy()
    start[1:] &= ~good[:-1]
    out = np.insert(numbers[kept], np.flatnonzero(start[kept]), -1)
    return out.astype(np.int32)


def in_rows(numbers: np.ndarray) -> pa.RecordBatch:
    """Numbers that begin with a break, as rows of about ROW_NUMBERS that do so too."""
    breaks = np.flatnonzero(numbers < 0)
    cuts = breaks[np.searchsorted(breaks, np.arange(0, breaks[-1] + 1, ROW_NUMBERS))] if len(breaks) else breaks
    offsets = np.append(np.unique(cuts), len(numbers))
    return pa.record_batch([pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(numbers, pa.int32()))], names=["numbers"])


def number_texts(batches: Iterator[pa.RecordBatch], ids: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) as rows of numbers; many texts to a row, a break between them."""
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = ids.get(lang)
            found = [np.fromiter((own.get(w, -1) for w in words), np.int32, len(words)) for words in stretches(text.as_py())] if own else []
            if found:
                held.append(runs(np.concatenate(found)))
                size += len(held[-1])
            if size >= ROW_NUMBERS:
                yield in_rows(np.concatenate(held))
                held, size = [], 0
    if size:
        yield in_rows(np.concatenate(held))


def split_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, at, lang, word): the words of rows (text, lang, text) one by one, breaks included, for the join with too many words."""
    for batch in batches:
        for place, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            at = 0
            for words in stretches(text.as_py()):
                yield pa.record_batch([pa.array([place] * len(words), pa.int64()), pa.array(np.arange(at, at + len(words))), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary())], names=["place", "at", "lang", "word"])
                at += len(words)


def joined_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (place, at, id) as rows of numbers: a break wherever the place changes or a word is missing."""
    last, held, size = (None, None), [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        place, at, ids = (batch.column(i).to_numpy() for i in range(3))
        follows = np.append(place[0] == last[0] and at[0] == (last[1] or 0) + 1, (place[1:] == place[:-1]) & (at[1:] == at[:-1] + 1))
        held.append(np.insert(ids, np.flatnonzero(~follows), -1))
        last, size = (place[-1], at[-1]), size + len(ids)
        if size >= ROW_NUMBERS:
            whole = np.concatenate(held)
            cut = len(whole) - int(np.argmax(whole[::-1] < 0)) - 1  # the last break: what follows may go on
            if cut > 0:
                if len(done := runs(whole[:cut])):
                    yield in_rows(done)
                held, size = [whole[cut:]], len(whole) - cut
    if held and len(done := runs(np.concatenate(held))):
        yield in_rows(done)


class Prefixes:
    """Prefixes of one to several words: first words (sorted), and for each length more the keys prefix << 32 | word (sorted)."""

    def __init__(self, roots: np.ndarray, levels: list[np.ndarray]) -> None:
        self.roots, self.levels = roots, levels
        self.number = None
        if len(roots) and roots[-1] < LOOKUP:
            self.number = np.full(int(roots[-1]) + 2, -1, np.int32)  # the last stands for all that is beyond, and for breaks
            self.number[roots] = np.arange(len(roots))

    def climb(self, numbers: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, prefixes): where the prefixes of depth + 1 words begin in numbers, and which they are."""
        if not len(self.roots):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.number is not None:
            found = self.number[np.minimum(numbers, len(self.number) - 1)]
            at = np.flatnonzero(found >= 0)
            prefix = found[at].astype(np.int64)
        else:
            spot = np.minimum(np.searchsorted(self.roots, numbers), len(self.roots) - 1)
            at = np.flatnonzero(self.roots[spot] == numbers)
            prefix = spot[at]
        for k, keys in enumerate(self.levels[:depth], 1):
            inside = at + k < len(numbers)
            at, prefix = at[inside], prefix[inside]
            word = numbers[at + k].astype(np.int64)
            key = prefix << 32 | word
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[spot] == key) & (word >= 0)
            at, prefix = at[hit], spot[hit]
        return at, prefix


def count_extensions(batches: Iterator[pa.RecordBatch], roots: np.ndarray, levels: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(key, n, low, high): counts of the one-word extensions of all prefixes, and the smallest and largest word before them."""
    prefixes, depth = Prefixes(roots, levels), len(levels)
    for batch in batches:
        for row in batch.column(0):
            numbers = np.asarray(row.values, np.int32)
            at, prefix = prefixes.climb(numbers, depth)
            inside = at + depth + 1 < len(numbers)
            at, prefix = at[inside], prefix[inside]
            word = numbers[at + depth + 1].astype(np.int64)
            good = word >= 0
            at, key = at[good], prefix[good] << 32 | word[good]
            before = numbers[at - 1].astype(np.int64)  # rows begin with a break
            order = np.argsort(key, kind="stable")
            key, before = key[order], before[order]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            if len(new):
                yield pa.record_batch([pa.array(key[new]), pa.array(np.diff(np.append(new, len(key)))), pa.array(np.minimum.reduceat(before, new)), pa.array(np.maximum.reduceat(before, new))], names=["key", "n", "low", "high"])


def count_known(batches: Iterator[pa.RecordBatch], roots: np.ndarray, levels: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(level, prefix, n): how often the prefixes of each level occur in this task."""
    prefixes = Prefixes(roots, levels)
    sums = [np.zeros(len(keys), np.int64) for keys in levels]
    for batch in batches:
        for row in batch.column(0):
            numbers = np.asarray(row.values, np.int32)
            for k in range(len(levels)):
                sums[k] += np.bincount(prefixes.climb(numbers, k + 1)[1], minlength=len(sums[k]))
    for k, own in enumerate(sums):
        some = np.flatnonzero(own)
        yield pa.record_batch([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(own[some])], names=["level", "prefix", "n"])


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), kind))


PHRASE = "words array<int>, counts array<bigint>, a bigint, low bigint, high bigint, right bigint"


def grow(codes: DataFrame, roots: np.ndarray, root_counts: np.ndarray, least_count: int, most_length: int) -> DataFrame | None:
    """All phrases that begin with the words of roots and occur often enough: their words, their prefixes' counts, and a.

    low and high are the words before, right is the count of the most frequent extension by a word to the right.
    """
    levels: list[np.ndarray] = []
    parts: list[dict[str, np.ndarray]] = []
    words, counts = roots[:, None].astype(np.int32), root_counts[:, None]
    for _ in range(2, most_length + 1):
        found = codes.mapInArrow(partial(count_extensions, roots=roots, levels=list(levels)), "key bigint, n bigint, low bigint, high bigint")
        found = found.groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("n") >= least_count)
        nodes = found.toArrow().sort_by("key")  # no more than the batch's bound
        keys, n, low, high = (nodes.column(c).to_numpy() for c in ("key", "n", "low", "high"))
        if parts:
            np.maximum.at(parts[-1]["right"], keys >> 32, n)
        if not len(keys):
            break
        words = np.column_stack([words[keys >> 32], (keys & 0xFFFFFFFF).astype(np.int32)])
        counts = np.column_stack([counts[keys >> 32], n])
        parts.append({"words": words, "counts": counts, "a": n, "low": low, "high": high, "right": np.zeros(len(n), np.int64)})
        levels.append(keys)
    if not parts:
        return None
    tables = [pa.table([lists(x["words"], pa.int32()), lists(x["counts"], pa.int64()), *(pa.array(x[c]) for c in ("a", "low", "high", "right"))], names=["words", "counts", "a", "low", "high", "right"]) for x in parts]
    return codes.sparkSession.createDataFrame(pa.concat_tables(tables), PHRASE)


def count_phrases(codes: DataFrame, phrases: list[list[int]]) -> DataFrame:
    """(words, n) of given phrases of two words or more, by one pass over the numbers."""
    roots = np.array(sorted({p[0] for p in phrases}), np.int32)
    index = {(w,): i for i, w in enumerate(roots.tolist())}
    levels = []
    for length in range(2, max(map(len, phrases)) + 1):
        heads = {tuple(p[:length]) for p in phrases if len(p) >= length}
        keyed = sorted((index[h[:-1]] << 32 | h[-1], h) for h in heads)
        levels.append(np.array([k for k, _ in keyed], np.int64))
        index |= {h: i for i, (_, h) in enumerate(keyed)}
    found = codes.mapInArrow(partial(count_known, roots=roots, levels=levels), "level int, prefix bigint, n bigint").groupBy("level", "prefix").agg(F.sum("n").alias("n")).toArrow()
    n = {(level, prefix): n for level, prefix, n in zip(*(found.column(c).to_pylist() for c in ("level", "prefix", "n")), strict=True)}
    rows = pa.table({"words": pa.array(phrases, pa.list_(pa.int32())), "n": pa.array([n.get((len(p) - 2, index[tuple(p)]), 0) for p in phrases], pa.int64())})
    return codes.sparkSession.createDataFrame(rows, "words array<int>, n bigint")


def frequent_words(counts: DataFrame, least_count: int) -> DataFrame:
    """(id, lang, word, f) of the words that occur often enough; ids count from 0."""
    often = stored(counts.where(F.col("f") >= least_count).withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS)).cast("int")), "frequent-words")
    sizes = {r.bucket: r.n for r in often.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # BUCKETS rows
    before = np.cumsum([0, *(sizes.get(b, 0) for b in range(BUCKETS))]).tolist()
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return stored(often.select((F.get(F.lit(before[:-1]), F.col("bucket")) + own - 1).cast("int").alias("id"), "lang", "word", "f"), "words")


def numbered_texts(rows: DataFrame, words: DataFrame, most_words: int) -> DataFrame:
    """The texts of rows (lang, text) as rows of numbers."""
    if words.count() <= most_words:
        ids: dict[str, dict[bytes, int]] = {}
        for r in words.select("id", "lang", "word").toLocalIterator():
            ids.setdefault(r.lang, {})[r.word.encode("utf-8", "surrogatepass")] = r.id
        return stored(rows.mapInArrow(partial(number_texts, ids=ids), "numbers array<int>"), "phrase-numbers")
    each = rows.select(F.monotonically_increasing_id().alias("place"), "lang", "text").mapInArrow(split_texts, "place bigint, at bigint, lang string, word binary").withColumn("word", F.col("word").cast("string"))
    each = stored(each, "phrase-words")
    known = each.where("word <> '.'").join(words.select("lang", "word", "id"), ["lang", "word"]).select("place", "at", "id")
    gaps = each.where("word = '.'").select("place", "at", F.lit(-1).alias("id"))
    # infrequent words leave a hole in the places, which is a break as well
    return stored(known.unionAll(gaps).repartition("place").sortWithinPartitions("place", "at").select("place", "at", "id").mapInArrow(joined_texts, "numbers array<int>"), "phrase-numbers")


def spans_of(words: DataFrame, share: float, least_count: int) -> DataFrame:
    """(lang, high): first words below that count have about `share` of the language's frequent occurrences; classes of counts are doublings."""
    classes = words.groupBy("lang", F.floor(F.log2(F.col("f") / least_count) + 1e-9).alias("c")).agg(F.sum("f").alias("s"))
    w = Window.partitionBy("lang").orderBy("c")  # some sixty classes at most
    reached = classes.select("lang", "c", (F.sum("s").over(w) / F.sum("s").over(Window.partitionBy("lang"))).alias("reached"))
    top = F.min(F.when(F.col("reached") >= min(share, 1.0), F.col("c")))
    return reached.groupBy("lang").agg((F.coalesce(top, F.max("c")) + 1).alias("c")).select("lang", F.ceil(least_count * F.pow(F.lit(2.0), F.col("c"))).cast("bigint").alias("high"))


#: 1000 * a * n / (l * r), rounded down, without loss.
SCORE = "cast(cast(a * 1000 as decimal(18,0)) * cast(n as decimal(18,0)) as decimal(38,0)) div cast(cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as decimal(38,0))"


def collocations(docs: DataFrame, top: int = TOP, least_count: int = LEAST_COUNT, most_length: int = MOST_LENGTH, most_words: int = MOST_WORDS, batch: int = BATCH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` best surviving phrases of docs (lang, text)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text is not null")
    counts = rows.mapInArrow(count_words, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = stored(counts.select("lang", F.col("word").cast("string").alias("word"), "f"), "word-counts")
    totals = stored(counts.groupBy("lang").agg(F.sum("f").alias("n")), "language-words", 1)
    words = frequent_words(counts, least_count)
    codes = numbered_texts(rows, words, most_words)
    about = words.join(small(totals, 100_000), "lang").select("id", "lang", "n")
    single = words.select(F.array("id").alias("words"), F.col("f").alias("n"))

    settled = stored(totals.select("lang", F.lit(0).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("floor")), "spans", 1)  # first words below low are expanded
    known, scored, share = single, None, FIRST_SHARE
    while True:
        # a language without a threshold takes more frequent words; one with a threshold those whose bound reaches it
        reach = F.least(F.floor(F.lit(1000).cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)") / F.col("floor")).cast("bigint") + 1, F.lit(1 << 62))
        spans = settled.join(totals, "lang").join(spans_of(words, share, least_count), "lang", "left")
        spans = stored(spans.select("lang", "floor", "low", F.greatest("low", F.when(F.col("floor") > 0, reach).otherwise(F.coalesce("high", F.lit(0).cast("bigint")))).alias("high")), "spans", 1)
        fresh = words.join(small(spans.where("low < high"), 100_000), "lang").where("f >= low and f < high").select("id", "f")
        fresh = stored(fresh, "first-words", 1)
        n_fresh, occurrences = fresh.agg(F.count(F.lit(1)), F.sum("f")).first()
        if not n_fresh and share >= 1.0:
            break
        grown: list[DataFrame] = []
        batches = max(1, -(-(occurrences or 0) // (least_count * batch)))
        for k in range(batches if n_fresh else 0):
            own = fresh.where(F.pmod("id", F.lit(batches)) == k).toArrow().sort_by("id")
            if own.num_rows and (phrases := grow(codes, own.column("id").to_numpy(), own.column("f").to_numpy(), least_count, most_length)) is not None:
                grown.append(stored(phrases, "phrases"))
        if grown:
            phrases = grown[0]
            for more in grown[1:]:
                phrases = phrases.unionAll(more)
            known = known.unionAll(phrases.select("words", F.col("a").alias("n")))
            alive = phrases.where((F.col("right") < F.col("a")) & ((F.size("words") == most_length) | (F.col("low") < 0) | (F.col("low") != F.col("high"))))
            alive = alive.join(small(about, 200_000), F.get("words", F.lit(0)) == F.col("id")).join(small(spans.select("lang", "floor"), 100_000), "lang")
            cuts = alive.select("lang", "words", "a", "n", "floor", "counts", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
            cuts = cuts.withColumn("l", F.get("counts", F.col("cut") - 1)).withColumn("rest", F.slice("words", F.col("cut") + 1, F.size("words"))).drop("counts")
            measured = lambda cuts, known: cuts.join(small(known.select(F.col("words").alias("rest"), F.col("n").alias("r")), 200_000), "rest", "left").withColumn("score", F.expr(SCORE))
            first = measured(cuts, known)
            # what is known of a phrase bounds its score: below the threshold it is done with
            could = first.withColumn("bound", F.min("score").over(Window.partitionBy("words"))).where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
            could = stored(could.drop("bound"), "phrase-cuts")
            missing = stored(could.where("r is null").select("rest").distinct(), "phrase-parts", 1)
            n_missing = missing.count()
            for k in range(-(-n_missing // batch)):
                part = missing.where(F.pmod(F.xxhash64("rest"), F.lit(-(-n_missing // batch))) == k).toArrow().column("rest").to_pylist()
                if part:
                    known = known.unionAll(stored(count_phrases(codes, part), "part-counts", 1))
            exact = could.where("r is not null")
            if n_missing:
                exact = exact.unionByName(measured(could.where("r is null").drop("r", "score"), known))
            best = exact.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "words", "a", "n", "b.l", "b.r", "b.score")
            best = stored(best, "scored-phrases")
            scored = best if scored is None else scored.unionAll(best)
        settled = spans.select("lang", F.col("high").alias("low"), "floor")
        if scored is not None:
            place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc()))
            floors = scored.select("lang", "score").withColumn("place", place).where(F.col("place") <= top).groupBy("lang").agg(F.max("place").alias("places"), F.min("score").alias("score")).where(F.col("places") == top).select("lang", F.col("score").alias("floor"))
            settled = settled.drop("floor").join(floors, "lang", "left")
        settled = stored(settled.select("lang", "low", "floor"), "settled", 1)
        share = share * 4 if share * 4 < 0.5 else 1.0

    if scored is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    last = scored.join(small(settled.select("lang", "floor"), 100_000), "lang").where(F.col("floor").isNull() | (F.col("score") >= F.col("floor"))).drop("floor")
    spelled = last.select("lang", "words", F.posexplode("words").alias("at", "id")).join(small(words.select("id", "word"), 200_000), "id")
    spelled = spelled.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return last.join(spelled, "words").withColumn("rank", place.cast("bigint")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = """
WITH p AS (SELECT row_number() OVER () AS piece, lang, words FROM (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]+')) AS piece FROM documents WHERE text IS NOT NULL))),
w AS (SELECT lang, word, count(*) AS f FROM (SELECT lang, unnest(words) AS word FROM p) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, list_slice(words, i, i + k - 1) AS g FROM (SELECT *, unnest(generate_series(1, len(words))) AS i FROM p), (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, g, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE len(g) >= 2),
held AS (SELECT DISTINCT lang, part AS g, sub.a FROM (SELECT lang, a, unnest([list_slice(g, 1, len(g) - 1), list_slice(g, 2, len(g))]) AS part FROM c WHERE len(g) >= 3) AS sub),
s AS (SELECT c.* FROM c LEFT JOIN held USING (lang, g, a) WHERE held.g IS NULL),
x AS (SELECT *, list_slice(g, 1, k) AS lg, list_slice(g, k + 1, len(g)) AS rg FROM (SELECT *, unnest(generate_series(1, len(g) - 1)) AS k FROM s)),
y AS (SELECT x.lang, x.g, x.a, k, lf.a AS l, rf.a AS r, n, (1000::HUGEINT * x.a * n) // (lf.a::HUGEINT * rf.a) AS score FROM x JOIN f AS lf ON lf.lang = x.lang AND lf.g = lg JOIN f AS rf ON rf.lang = x.lang AND rf.g = rg JOIN t ON t.lang = x.lang),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM y) WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM z) WHERE rank <= 2000
"""
