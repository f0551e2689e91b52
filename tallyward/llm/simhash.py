"""Document fingerprints: SimHash over weighted words, and permuted block tables for near ones.

Fingerprints. A text's words (runs of letters and digits, in lower case) vote on 64 bits: each occurrence adds its weight
to the bits that the word's hash has set, and a bit of the fingerprint is set if more than half of the text's whole weight
is for it. Rare words weigh most: a weight grows with the square of the logarithm of how rare a word is, by counts of all
words of all texts in BINS bins. Votes are counted in lanes of longs, three bits' counts to a long, block of words by
block of words; so a text of any length is counted exactly.

Search. Fingerprints within a Hamming radius agree in all but `radius` of their blocks. For every choice of the other
blocks there is a table, keyed by the bits of the chosen blocks (the permutation that brings these to the front, cut after
them); two near fingerprints meet in one table at least. There are as many blocks as make the keys longer than the number
of fingerprints, whatever that is. As classes are asked for, a bucket's fingerprints are first compared with pivots of
theirs, linearly many tests; then fingerprints of different classes in one bucket are compared with each other. In large
buckets they must also agree in one part more of the other bits, which again loses none.

The next document is found by cutting the order of doc_ids into ranges: a range is one window's rows, with the first row
of the range after it as its last. All of it is DataFrame operations.

Rows: every row is a document of its own. In the descending order of doc_id nulls come last, and rows that share a doc_id
are ordered by a hash of their place. Null and empty texts, and texts without words, have the fingerprint 0. One row alone
is its own next document. Ties of a vote leave the bit unset.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, numbered, small, stored, table
from .ngram_join import components, tasks_for

#: What separates words: all ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BITS, RADIUS = 64, 3
#: Bins of the word counts, a table of so many rows at most; doublings of rarity that count; the largest weight.
BINS, DOUBLINGS = 1 << 16, 15
HEAVIEST = DOUBLINGS * DOUBLINGS // 4
#: Bits of a lane, and words whose votes fit into one.
LANE, BLOCK = 21, 1 << 15
#: Rows of one range of doc_ids, at least, and ranges by quantiles and by even parts of those, at most.
RANGE_ROWS, MOST_QUANTILES, MOST_PARTS = 2_048, 1_024, 64
#: Fingerprints of a bucket from which on they must agree in more bits to be compared.
LARGE = 512


def words(text: Column) -> Column:
    return F.split(F.lower(text), BETWEEN)


def bin_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BINS))


def rarity_weights(texts: DataFrame) -> DataFrame:
    """(bin, weight) for all words of texts (text): BINS rows at most."""
    counts = texts.select(F.explode(words(F.col("text"))).alias("word")).where("word <> ''").groupBy(bin_of(F.col("word")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "word-bins", 1)
    total = counts.agg(F.sum("n")).first()[0] or 1
    doublings = F.least(F.floor(F.log2(F.lit(float(total)) / F.col("n"))), F.lit(DOUBLINGS))
    return counts.select("bin", F.greatest(F.floor(doublings * doublings / 4), F.lit(1)).cast("bigint").alias("weight"))


def lanes(h: Column, weight: Column) -> list[Column]:
    """The sums that count the votes: three lanes to a long, the last bit, and the whole weight."""
    mask = F.lit(1 | 1 << LANE | 1 << 2 * LANE)
    return [F.sum(F.shiftright(h, k).bitwiseAND(mask) * weight).alias(f"v{k}") for k in range(LANE)] + [F.sum(F.shiftrightunsigned(h, 63) * weight).alias("v63"), F.sum(weight).alias("whole")]


def unpacked() -> list[Column]:
    """Each bit's votes from the lanes."""
    low = F.lit((1 << LANE) - 1)
    return [F.shiftrightunsigned(f"v{b % LANE}", b // LANE * LANE).bitwiseAND(low).alias(f"b{b}") for b in range(3 * LANE)] + [F.col("v63").alias("b63")]


def fingerprints(texts: DataFrame, key: list[str], weights: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried, fp) for each row of texts (key, carried, text); key and carried are numbers, and key is unique."""
    each = texts.select(*key, *carried, F.posexplode(words(F.col("text"))).alias("spot", "word"))
    voting = each.withColumn("bin", bin_of(F.col("word"))).join(F.broadcast(weights), "bin", "left")  # BINS rows at most
    weight = F.when(F.col("word") == "", F.lit(0).cast("bigint")).otherwise(F.coalesce("weight", F.lit(HEAVIEST).cast("bigint")))
    h = F.xxhash64("word", F.lit(BITS))
    same = [F.max(c).alias(c) for c in carried]
    votes = voting.withColumns({"h": h, "w": weight}).groupBy(*key, F.shiftright("spot", BLOCK.bit_length() - 1).alias("block")).agg(*lanes(F.col("h"), F.col("w")), *same)
    counted = votes.select(*key, *carried, "whole", *unpacked()).groupBy(*key).agg(*same, F.sum("whole").alias("whole"), *[F.sum(f"b{b}").alias(f"b{b}") for b in range(BITS)])
    fp = F.lit(0).cast("bigint")
    for b in range(BITS):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("whole"), F.lit(1 << b if b < 63 else -1 << 63)).otherwise(F.lit(0)).cast("bigint"))
    return counted.select(*key, *carried, fp.alias("fp"))


def ranges(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows (file, at, doc_id, ...) with range and spread: ranges rise as doc_ids fall, and hold about range_rows rows.

    Ranges are quantiles of the doc_ids, each cut into even parts. A doc_id that fills several quantiles is dealt over
    ranges by spread, a hash of the row's place; so are rows without a doc_id.
    """
    n, missing, least, most = rows.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    quantiles = max(1, min(MOST_QUANTILES, -(-n // range_rows)))
    parts = max(1, min(MOST_PARTS, -(-n // (quantiles * range_rows))))
    found = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / quantiles) for i in range(1, quantiles)]), F.lit(10 * quantiles))).first()[0] if quantiles > 1 else []
    filled = Counter(found or []) | Counter({x: 1 for x in (least, most) if x is not None})
    cuts = sorted(filled, reverse=True)
    rows = rows.withColumn("spread", F.xxhash64("file", "at"))
    share = F.col("spread") / 2.0**64 + 0.5
    deal = lambda n: F.least(F.floor(share * n), n - 1)
    if not cuts:
        return rows.withColumn("range", deal(F.lit(max(1, -(-missing // range_rows)))).cast("bigint"))
    literal = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    known = F.array_compact(F.transform(literal(cuts), lambda c: F.when(c > F.col("doc_id"), c)))
    above = F.size(known)
    cut = F.get(literal(cuts), above)
    upper = F.coalesce(F.get(literal(cuts), above - 1), cut).cast("double")
    inner = F.floor((upper - F.col("doc_id")) / F.nullif(upper - cut, F.lit(0.0)) * parts)
    inner = F.greatest(F.least(F.coalesce(inner, F.lit(0)), F.lit(parts - 1)), F.lit(0))
    equal = F.col("doc_id") == cut
    part = F.when(equal, deal(F.get(literal([filled[c] * parts for c in cuts]), above))).otherwise(inner)
    at = F.when(F.col("doc_id").isNull(), F.lit(2 * len(cuts) + 1).cast("bigint") * (1 << 32) + deal(F.lit(max(1, -(-missing // range_rows))))).otherwise((above * 2 + equal.cast("int")).cast("bigint") * (1 << 32) + part)
    return rows.withColumn("range", at.cast("bigint"))


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(file, at, doc_id, text, next_text, next_file, next_at): each document with the next one by descending doc_id, the first after the last."""
    rows = numbered(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))).select(f"{ROW}.*", "doc_id", "text")
    ranged = ranges(rows, range_rows)
    order = [F.bitwise_not("doc_id").alias("down"), F.col("spread"), F.col("file"), F.col("at")]
    heads = stored(ranged.groupBy("range").agg(F.min(F.struct(*order)).alias("head")).select("range", "head.file", "head.at"), "range-heads", 1)
    # as many rows as there are ranges, which has a bound (MOST_QUANTILES and MOST_PARTS)
    everywhere = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(everywhere), F.max("range").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = stored(heads.withColumn("into", before).select("file", "at", "into"), "range-ends", 1)
    ends = ranged.join(F.broadcast(heads), ["file", "at"]).withColumn("range", F.col("into")).drop("into")
    both = ranged.withColumn("end", F.lit(False)).unionByName(ends.withColumn("end", F.lit(True)))
    w = Window.partitionBy("range").orderBy("end", F.bitwise_not("doc_id").asc_nulls_last(), "spread", "file", "at")
    return both.select("file", "at", "doc_id", "text", "end", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("text", "file", "at")]).where("not end").drop("end")


def tables_of(bits: int, radius: int, fingerprints: int) -> list[tuple[int, list[int]]]:
    """(mask of the key, masks of the radius + 1 parts of the other bits) of each table, for so many fingerprints."""
    chosen = 1
    while chosen < bits - radius and bits * chosen // (chosen + radius) < (8 * fingerprints).bit_length():
        chosen += 1
    n = chosen + radius
    edges = [bits * i // n for i in range(n + 1)]
    block = lambda i: sum(1 << b for b in range(edges[i], edges[i + 1]))
    out = []
    for own in combinations(range(n), chosen):
        mask = sum(map(block, own))
        rest = [b for b in range(bits) if not mask >> b & 1]
        cuts = [len(rest) * i // (radius + 1) for i in range(radius + 2)]
        out.append((mask, [sum(1 << b for b in rest[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_classes(prints: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame | None:
    """(fp, root) of the distinct fingerprints (fp) that are within the radius of another, by links; None if none is."""
    n = prints.count()
    masks = tables_of(BITS, radius, max(1, n))
    tasks = tasks_for(n * len(masks))
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.lit(signed(m)).alias("mask")) for i, (m, _) in enumerate(masks)])).alias("t")
    entries = prints.select("fp", one).select("fp", "t.table", F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"))
    full = entries.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = stored(entries.join(stored(full, "near-buckets", tasks), ["table", "key"]), "near-entries", tasks).withColumn("root", F.col("fp"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    links = None
    for turn in range(2):  # first one pivot of each bucket, then another one of those that aren't one class by then
        pivots = entries.groupBy("table", "key").agg(F.min_by("fp", F.xxhash64("fp", "table", F.lit(turn))).alias("pivot"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("table", "key", "pivot")
        met = entries.join(pivots, ["table", "key"]).where(near("fp", "pivot") & (F.col("fp") != F.col("pivot"))).select(F.greatest("fp", "pivot").alias("a"), F.least("fp", "pivot").alias("b")).distinct()
        links = stored(met if links is None else met.union(links).distinct(), "near-links", tasks)
        if links.isEmpty():
            continue
        roots = stored(components(links), "near-roots", tasks)
        entries = stored(entries.drop("root").join(roots, F.col("fp") == F.col("doc"), "left").select("table", "key", "n", "fp", F.coalesce("root", "fp").alias("root")), "near-entries", tasks)
    open_ = entries.groupBy("table", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("table", "key")
    rest = F.element_at(F.array(*[F.array(*[F.lit(signed(p)) for p in parts]) for _, parts in masks]), F.col("table") + 1)
    finer = F.when(F.col("n") > large, F.transform(rest, lambda p, i: F.struct(i.alias("part"), F.col("fp").bitwiseAND(p).alias("more")))).otherwise(F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("more"))))
    wide = stored(entries.join(open_, ["table", "key"]).select("table", "key", "fp", "root", F.explode(finer).alias("p")).select("table", "key", "fp", "root", "p.*"), "near-open", tasks)
    on = ["table", "key", "part", "more"]
    pairs = wide.select(*on, F.col("fp").alias("a"), F.col("root").alias("ra")).join(wide.select(*on, F.col("fp").alias("b"), F.col("root").alias("rb")), on)
    pairs = pairs.where((F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb")) & near("a", "b")).select("a", "b").distinct()
    links = stored(links.union(pairs), "near-links", tasks)
    return None if links.isEmpty() else stored(components(links), "near-roots", tasks).select(F.col("doc").alias("fp"), "root")


def with_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (doc_id, fp, ...) with class_id: the smallest doc_id of the rows whose fingerprints its own reaches by steps within the radius."""
    firsts = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = near_classes(firsts.select("fp"), radius)
    rooted = firsts.withColumn("root", F.col("fp")) if roots is None else firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    classes = stored(rooted.join(least, "root").select("fp", "class_id"), "fingerprint-classes")
    return prints.join(small(classes, 200_000), "fp")


def shown(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """The share of bits in which two fingerprints agree."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): its fingerprint, that of its edited text, and how like they and the next one's are.

    The edited text has its last third replaced by the start of the next document, as much of it as there is.
    """
    weights = stored(rarity_weights(docs.select("text")), "word-weights", 1)
    rows = with_next(docs, range_rows)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("file", "at", "doc_id", "next_file", "next_at", n.cast("bigint").alias("n_chars"), F.posexplode(F.array("text", edited)).alias("kind", "text"))
    digest = F.sha2("text", 256)
    # numbers, so that they are aggregated beside the votes
    halves = {f"d{i}": F.conv(F.substring("digest", 16 * i + 1, 16), 16, -10).cast("bigint") for i in range(4)}
    rows = rows.withColumn("digest", F.when(F.col("kind") == 1, digest)).withColumns(halves)
    carried = ("doc_id", "next_file", "next_at", "n_chars", *halves)
    prints = fingerprints(rows, ["file", "at", "kind"], weights, carried)
    own = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    prints = prints.groupBy("file", "at").agg(*[F.max(c).alias(c) for c in carried], own(0, "fp").alias("fp"), own(1, "fp").alias("edited_fp"))
    prints = stored(prints, "document-fingerprints")
    following = prints.select(F.col("file").alias("next_file"), F.col("at").alias("next_at"), F.col("fp").alias("next_fp"))
    out = with_classes(prints.join(following, ["next_file", "next_at"]), radius)
    sha = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in halves])
    return out.select("doc_id", "n_chars", sha.alias("edited_sha256"), shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "class_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint, the edited text's, their likeness and the next document's, and its class within the radius."""
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
