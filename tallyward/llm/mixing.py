"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's text is one stream of words, its documents in an order seeded by a hash, cut into blocks of equal
numbers of words: BLOCK_WORDS, or fewer for sources of small targets, so that half a block is never a large part of one.
A target is served by whole passes over the source; what remains is apportioned in blocks. Seats are blocks: seat j of a
source with remainder t has the quotient t / (2j - 1), and seats go to the highest quotients. As the number of seats is
free, all quotients from half a block up win, which gives the source round(t / block) blocks. The first k of n shards
take the quotients from n / (2k) blocks up; so shard k's integer quota of the source is
round(t k / (n b)) - round(t (k-1) / (n b)), and every prefix of shards is itself a Sainte-Lague apportionment.

With the quotas known, each shard gets a stretch of the source's blocks, its quota and an equal part of the blocks that
stay over, and draws its quota from the stretch by a systematic draw with a seeded start. What a document gives is then
the number of drawn words in its part of the stream: a difference of two closed forms, with no row per block. Stream
positions are prefix sums in three levels, none of which puts a whole source into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ROW, SPACES, WORD, numbered, small, stored, table, text_or_empty

WEIGHTS = (5, 2, 1)
#: Words of a block at most; a source's target has FINE blocks or more, unless a block is one word.
BLOCK_WORDS, FINE = 32, 192
SHARDS = 16
#: Documents of one innermost prefix sum, on average, and such groups in one of the next level.
GROUP_DOCS, GROUPS = 256, 1024
SEED = "mix-1"
#: The columns that mixed_texts adds while it works.
PLACE, COPY = "_tallyward_place", "_tallyward_copy"


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, n_docs, source_size, target) from per-source sums (source, n_docs, source_size).

    Weights go round over the sources by code point, null last. Sources share `share` of all words by weight; a target
    stops at `most` times its source's size and the excess goes to the others by weight until none is above. Ranks come
    from ranges of names, and each round of resharing is one sum over the sources, so their number has no bound.
    """
    by_name = F.col("source").asc_nulls_last()
    ranged = stored(sizes.repartitionByRange(by_name).withColumn("part", F.spark_partition_id()), "mix-sources")
    # one row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(by_name)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranged.join(F.broadcast(starts), "part").withColumn("rank", rank).withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    ranked = stored(ranked.select("source", "n_docs", "source_size", "weight", "limit"), "mix-ranked")

    level, stopped = 0.0, -1
    while True:
        above = F.col("limit") < level * F.col("weight")
        sums = ranked.agg(share * F.sum("source_size"), F.sum(F.when(above, F.col("limit"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if sums[3] == stopped or sums[2] is None:  # no further source stops, or all have
            break
        level, stopped = (sums[0] - (sums[1] or 0.0)) / sums[2], sums[3]
    goal = F.col("limit") if sums[2] is None else F.least("limit", level * F.col("weight"))
    return ranked.select("source", "n_docs", "source_size", goal.alias("target"))


def planned(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """goals with block (words), passes, rest (words that are apportioned in blocks) and all_blocks."""
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("target") / FINE))).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    out = goals.withColumns({"block": block, "passes": passes})
    return out.withColumns({"rest": F.col("target") - F.col("passes") * F.col("source_size"), "all_blocks": F.ceil(F.col("source_size") / F.col("block")).cast("bigint")})


def quotas(plan: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(source, shard, seats, n_blocks) from plan (source, rest, block): each shard's integer quota, shards from 1.

    seats is what the shards before it have together.
    """
    seats = lambda k: F.floor(F.col("rest") * k / (F.lit(float(shards)) * F.col("block")) + 0.5).cast("bigint")
    k = F.col("shard")
    return plan.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))).select("source", "shard", seats(k - 1).alias("seats"), (seats(k) - seats(k - 1)).alias("n_blocks"))


def stretches(plan: DataFrame, seed: str, shards: int = SHARDS) -> DataFrame:
    """(source, shards): per source an array of (first, blocks, seats, n, start), one for each shard that draws.

    A shard's stretch begins at block `first` and has `blocks` blocks, of which it draws `n`, its quota.
    """
    over = F.col("all_blocks") - F.floor(F.col("rest") / F.col("block") + 0.5).cast("bigint")
    spare = lambda k: F.floor(over * k / shards).cast("bigint")
    quota = quotas(plan, shards).alias("q").join(plan.alias("p"), F.col("q.source").eqNullSafe(F.col("p.source")))
    k = F.col("q.shard")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("p.source", F.lit("")), "p.n_docs", k).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    row = F.struct((F.col("q.seats") + spare(k - 1)).alias("first"), (F.col("q.n_blocks") + spare(k) - spare(k - 1)).alias("blocks"), F.col("q.seats").alias("seats"), F.col("q.n_blocks").alias("n"), start.alias("start"))
    rows = quota.select(F.col("p.source").alias("source"), row.alias("s")).where("s.blocks > 0")
    return rows.groupBy("source").agg(F.array_sort(F.collect_list("s")).alias("shards"))


def drawn_blocks(i: Column, shards: Column) -> Column:
    """How many of a source's first i blocks its shards draw."""
    last = F.filter(shards, lambda s: s["first"] <= i)
    of = lambda s: s["seats"] + F.floor((i - s["first"]) * s["n"] / s["blocks"] + s["start"]).cast("bigint")
    return F.coalesce(F.get(F.transform(F.slice(last, -1, 1), of), F.lit(0)), F.lit(0))


def placements(docs: DataFrame, seed: str, block_words: int) -> DataFrame:
    """Per row of docs (numbered; doc_id, source, text): size, its source's figures, its place and the words `extra`.

    `from` is the place of the document's first word in its source's stream, `extra` what the shards draw of it.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id")).cast("binary"))
    sized = docs.select(ROW, "doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint").alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"))
    sized = stored(sized, "mix-sizes")
    sizes = stored(sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")), "mix-source-sizes")
    plan = stored(planned(targets(sizes), block_words), "mix-plan")
    shards = stored(stretches(plan, seed), "mix-shards")
    goals = plan.alias("p").join(shards.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")), "left").select("p.*", "s.shards")
    goals = goals.withColumn("n_groups", F.ceil(F.col("n_docs") / GROUP_DOCS))

    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    rows = sized.alias("a").join(small(goals, 20_000).alias("b"), same).select(f"a.{ROW}", "a.doc_id", "a.source", "a.size", "a.key", "a.tie", *[f"b.{c}" for c in goals.columns if c != "source"])
    # groups are stretches of the seeded order, so that the order over all groups is the order of the keys
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32
    rows = rows.withColumn("group", F.floor(spot * F.col("n_groups")).cast("bigint")).withColumn("outer", F.floor(F.col("group") / GROUPS))

    def running(keys: list[str], order: list[str]) -> Window:
        return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    sums = lambda df, keys: df.groupBy(*keys).agg(F.sum("size").alias("size"))
    before = lambda w: F.coalesce(F.sum("size").over(w), F.lit(0))
    groups = sums(rows, ["source", "outer", "group"])
    outers = sums(groups, ["source", "outer"]).withColumn("at_outer", before(running(["source"], ["outer"]))).drop("size")
    groups = groups.withColumn("at_group", before(running(["source", "outer"], ["group"]))).drop("size")
    on = lambda *names: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    offsets = stored(groups.alias("a").join(outers.alias("b"), on("source", "outer")).select("a.source", "a.group", (F.col("at_group") + F.col("at_outer")).alias("at")), "mix-offsets")
    placed = rows.withColumn("inner", before(running(["source", "group"], ["key", "size", "tie", ROW])))
    placed = placed.alias("a").join(small(offsets, 200_000).alias("b"), on("source", "group")).select("a.*", (F.col("a.inner") + F.col("b.at")).alias("from"))

    def drawn(x: Column) -> Column:
        """Words that the shards draw among the first x of the stream."""
        b = F.floor(x / F.col("block"))
        whole = drawn_blocks(b, F.col("shards"))
        return whole * F.col("block") + (drawn_blocks(b + 1, F.col("shards")) - whole) * (x - b * F.col("block"))

    extra = F.when(F.col("rest") > 0, drawn(F.col("from") + F.col("size")) - drawn(F.col("from"))).otherwise(0)
    return placed.withColumn("extra", F.coalesce(extra, F.lit(0)).cast(T.LongType()))


def mix(docs: DataFrame, seed: str = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs' doc_id and source with size, source_size, target and taken, for every row.

    Null texts have no words. Rows that repeat a doc_id take neighbouring places, by size and text. A source without
    words has target 0 and gives none.
    """
    taken = (F.col("passes") * F.col("size") + F.col("extra")).cast(T.LongType())
    return placements(numbered(docs.select("doc_id", "source", "text")), seed, block_words).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_texts(docs: DataFrame, seed: str = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself, with the columns of docs: a row per whole pass, and one with the words that shards draw.

    Part rows keep the white space before each word that they take. n_chars, if there, becomes the new text's length.
    Documents that the mix takes nothing of are not in it; rows that repeat are mixed each for itself.
    """
    rows = numbered(docs)
    place = placements(rows.select(ROW, "doc_id", "source", "text"), seed, block_words).where("passes > 0 or extra > 0")
    place = place.select(ROW, F.struct("from", "size", "passes", "extra", "block", "shards").alias(PLACE))
    p = F.col(PLACE)
    copies = F.sequence(F.lit(1), (p["passes"] + F.when(p["extra"] > 0, 1).otherwise(0)).cast("int"))
    rows = rows.join(place, ROW).withColumn(COPY, F.explode(copies))
    block = lambda i: F.floor((p["from"] + i) / p["block"])
    # whether each block that the document touches is drawn
    flags = F.transform(F.sequence(block(F.lit(0)), block(F.greatest(p["size"] - 1, F.lit(0)))), lambda b: drawn_blocks(b + 1, p["shards"]) > drawn_blocks(b, p["shards"]))
    words = F.regexp_extract_all("text", F.lit(SPACES.replace("+", "*") + WORD), F.lit(0))
    # as a lambda's variable, the flags are taken once
    part = F.get(F.transform(F.array(flags), lambda f: F.array_join(F.filter(words, lambda w, i: F.get(f, (block(i) - block(F.lit(0))).cast("int"))), "")), F.lit(0))
    out = rows.withColumn("text", F.when(F.col(COPY) <= p["passes"], F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: what the mix takes of it."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5('{SEED}:' || doc_id) AS key FROM documents),
s AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight,
             2.0::DOUBLE * sum(size) AS lim FROM d GROUP BY source),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s),
f AS (SELECT lev AS words FROM l WHERE lev * weight <= lim ORDER BY lim / weight, source NULLS LAST LIMIT 1),
g AS (SELECT source, n_docs, source_size, least(lim, coalesce((SELECT words FROM f) * weight, lim)) AS target FROM l),
q AS (SELECT *, greatest(1, least({BLOCK_WORDS}, floor(target / {FINE})))::BIGINT AS block, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM g),
r AS (SELECT *, target - passes * source_size AS rest, ceil(source_size / block::DOUBLE)::BIGINT AS all_blocks FROM q),
w AS (SELECT *, floor(rest / block + 0.5)::BIGINT AS seats FROM r),
h AS (SELECT w.source, k, floor(rest * (k - 1) / ({float(SHARDS)}::DOUBLE * block) + 0.5)::BIGINT AS lo, floor(rest * k / ({float(SHARDS)}::DOUBLE * block) + 0.5)::BIGINT AS hi,
             (all_blocks - seats) * (k - 1) // {SHARDS} AS s0, (all_blocks - seats) * k // {SHARDS} AS s1,
             ('0x' || substr(md5('{SEED}:' || coalesce(w.source, '') || ':' || n_docs || ':' || k), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
      FROM w, generate_series(1, {SHARDS}) t(k)),
p AS (SELECT d.doc_id, d.size, w.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot
      FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
e AS (SELECT *, unnest([spot, spot, spot + size, spot + size]) AS x, unnest([-1, -1, 1, 1]) AS sign, unnest([0, 1, 0, 1]) AS one FROM p),
i AS (SELECT *, x // block + one AS b FROM e),
u AS (SELECT i.*, CASE WHEN b >= all_blocks THEN seats ELSE h.lo + floor((b - h.lo - h.s0) * (h.hi - h.lo)::DOUBLE / (h.hi + h.s1 - h.lo - h.s0) + h.start)::BIGINT END AS n
      FROM i LEFT JOIN h ON h.source IS NOT DISTINCT FROM i.source AND b >= h.lo + h.s0 AND b < h.hi + h.s1)
SELECT doc_id, any_value(size)::BIGINT AS size, any_value(source_size)::BIGINT AS source_size, any_value(target) AS target,
       (any_value(passes * size) + sum(CASE WHEN rest > 0 THEN sign * n * CASE one WHEN 0 THEN block - x % block ELSE x % block END ELSE 0 END))::BIGINT AS taken
FROM u GROUP BY doc_id
"""
