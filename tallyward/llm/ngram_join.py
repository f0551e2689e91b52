"""N-gram Jaccard self-join, exact, with filters under several global token orders.

1. Documents with equal shingle sets are one class, a node of its own number; rows that share a doc_id, or have none,
   belong to the classes of their texts.
2. Every token is looked up for other sets that have it. In any order that puts tokens of one set first, they fill the
   start of a prefix and match nothing. A class with more of them than its prefix is long has no partner and leaves.
3. Of the rest, the prefix of each set is taken under several orders of the shared tokens: by rising frequency, and by
   two hashes. A pair that links shares a token of both prefixes under every one of them. Partners are looked up under
   the first order; the other orders' prefixes must meet too before a pair is verified on the whole sets.
4. As only connected components are asked for, a pair inside one component needs no test. Each prefix token's sets are
   first compared with one pivot of theirs, so most of a large group of near copies is connected by linearly many tests.
   Then sets of different components that share a prefix token are looked up against each other, range of sizes by range
   of sizes; a bound on their common tokens, from the sets' sizes and from parity bitmaps, stands in the join itself, so
   that it gives few more pairs than there are links. Where many such pairs are left, a share of them, drawn by hash, is
   looked up first, its links merge components, and the share grows up to all pairs. Once the links of a share s have
   merged n sets, about n / s links at most still go between components (the sampling lemma of Karger, Klein and Tarjan),
   so each round gives links in proportion to the postings, as is to be expected however dense a group is.

No link between different sets is lost: what step 4 leaves untested is connected already.

Tokens are counted in batches: a task reduces about a million tokens to distinct ones before it sends them, so that a
token of very many documents reaches its group once from each batch, and never with a list of its documents. Batches grow
with the number of groups, so rows sent grow as the tokens do.

Whole sets are compared by the 64-bit hashes of their shingles, not by words: two sets that aren't near would be taken for
near only if many hashes collided at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, numbered, small, stored, table
from .shingles import digest, mixed, token_sets

WORDS, PERCENT = 5, 75
#: Tokens in one group of the frequency count, and tokens that a task holds before it sends them.
GROUP_TOKENS, HELD_TOKENS = 1 << 20, 1 << 20
#: Batches grow with the number of groups, so that each sends a group so many tokens about, up to a most of tokens; and
#: groups share tasks from so many on. So rows sent stay in proportion to the tokens, and tasks to the cluster.
SENT_TOKENS, MOST_HELD, MOST_TASKS = 64, 1 << 23, 1 << 13
#: Tokens of one batch of sets whose prefixes are taken together.
SET_TOKENS = 1 << 18
#: Longs of a parity bitmap. Each token flips one bit of its set's bitmap, so two bitmaps differ in no more bits than
#: the sets differ in tokens.
BITMAP = 16
#: Short rows (a few numbers) that one task writes.
ROWS_A_TASK = 50_000
#: Pairs of a first round for each posting, about, and how much more of all pairs each further round takes in.
GROWTH = 16
#: Seeds of the orders by hash.
ORDERS = (0x1F123BB5, 0x5DEECE66D)


def describe(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The batch's columns but for text (the last), then its set's size, address and the first half of that."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        sizes, addresses = [], []
        for k, tokens in enumerate(token_sets(texts, words)):
            sizes.append(len(tokens))
            addresses.append(digest(tokens, texts[k].as_py() if len(tokens) == 1 else None, words))
        halves = [None if d is None else int.from_bytes(d[:8], "little", signed=True) for d in addresses]
        yield pa.record_batch([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(addresses, pa.binary()), pa.array(halves, pa.int64())], names=[*batch.schema.names[:-1], "n", "address", "half"])


def group_of(tokens: np.ndarray, groups: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, counts.dtype)


def batch_number(parts: Iterator[bytes]) -> int:
    """A batch's number follows from what is in it, so that a batch that runs again has the same."""
    h = hashlib.blake2b(digest_size=8)
    for part in parts:
        h.update(part)
    return int.from_bytes(h.digest(), "little", signed=True)


SENT = "group bigint, batch bigint, many binary, once binary, owners binary, sets binary, shared binary"


def held_for(groups: int, least: int) -> int:
    """Tokens of a batch that is sent to so many groups."""
    return max(least, min(MOST_HELD, groups * SENT_TOKENS))


def send(batches: Iterator[pa.RecordBatch], groups: int, words: int) -> Iterator[pa.RecordBatch]:
    """A batch's distinct tokens, for each group: those of several sets (many), and those of one set with its half.

    A token of several sets of the batch is shared already: its sets are counted here (sets, shared), and the group need
    only know that it exists.
    """

    def packed(held: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        halves = np.array([int.from_bytes(d[:8], "little", signed=True) for d in held], np.int64)
        tokens = np.concatenate(list(held.values()))
        owner = np.repeat(np.arange(len(held)), [len(x) for x in held.values()])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        new = np.append(True, tokens[1:] != tokens[:-1])
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(tokens)))
        several = counts > 1
        shared = np.bincount(owner[np.repeat(several, counts)], minlength=len(held))
        many, once, owners = tokens[first[several]], tokens[first[~several]], halves[owner[first[~several]]]
        number = batch_number(iter(held))
        cuts_many, cuts_once = (np.searchsorted(group_of(x, groups), np.arange(groups + 1)) for x in (many, once))
        own = number % groups
        rows = []
        for g in range(groups):
            a, b, c, d = cuts_many[g], cuts_many[g + 1], cuts_once[g], cuts_once[g + 1]
            if b > a or d > c or g == own:
                rows.append((g, number, many[a:b].tobytes(), once[c:d].tobytes(), owners[c:d].tobytes(), halves.tobytes() if g == own else b"", shared.astype(np.int32).tobytes() if g == own else b""))
        kinds = [pa.int64()] * 2 + [pa.binary()] * 5
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SENT.split(", ")])

    held: dict[bytes, np.ndarray] = {}
    size, most = 0, held_for(groups, HELD_TOKENS)
    for batch in batches:
        texts = batch.column(0)
        for k, tokens in enumerate(token_sets(texts, words)):
            if len(tokens) and (address := digest(tokens, texts[k].as_py() if len(tokens) == 1 else None, words)) not in held:
                held[address] = tokens
                size += len(tokens)
            if size >= most:
                yield packed(held)
                held, size = {}, 0
    if held:
        yield packed(held)


def joined(rows: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed in a column, end to end, and the row that each comes from."""
    parts = [np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


SHARED = "batch bigint, sets binary, shared binary"


def count_shared(rows: pa.Table) -> pa.Table:
    """(batch, sets, shared): a row for each batch, with its sets that have tokens of other sets too, as far as this group knows, and how many.

    Rows out are no more than rows in, and numbers no more than tokens in, however many groups a set's tokens fall into.
    """
    numbers = rows.column("batch").to_numpy()
    many, _ = joined(rows, "many", np.uint64)
    once, row = joined(rows, "once", np.uint64)
    owners, _ = joined(rows, "owners", np.int64)
    # a token is shared if some batch has it several times, or if batches have it from different sets
    order = np.argsort(once, kind="stable")
    once, row, owners = once[order], row[order], owners[order]
    first = np.flatnonzero(np.append(True, once[1:] != once[:-1])) if len(once) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(once)))
    differ = np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first) if len(first) else np.zeros(0, bool)
    hit = np.repeat(differ | np.isin(once[first], many), counts)
    # the hits of each batch in turn, those of one set together
    at = np.lexsort((owners[hit], row[hit]))
    own, own_row = owners[hit][at], row[hit][at]
    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (own_row[1:] != own_row[:-1]))) if len(own) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(own)))
    cuts = np.searchsorted(own_row[new], np.arange(rows.num_rows + 1))
    out = []
    for k, (a, b, sets, shared) in enumerate(zip(cuts[:-1], cuts[1:], rows.column("sets").to_pylist(), rows.column("shared").to_pylist(), strict=True)):
        if b > a or sets:
            out.append((numbers[k], own[new[a:b]].tobytes() + sets, counts[a:b].astype(np.int32).tobytes() + shared))
    return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in SHARED.split(", ")])


def sum_shared(rows: pa.Table) -> pa.Table:
    """(half, shared): of each set of one batch, how many of its tokens other sets have."""
    halves, counts = summed(joined(rows, "sets", np.int64)[0], joined(rows, "shared", np.int32)[0].astype(np.int64))
    return pa.table({"half": halves, "shared": counts})


def listed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        sets = list(token_sets(batch.column(1), words))
        offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
        tokens = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))
        bits = [np.packbits((np.bincount((x % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1).astype(np.uint8)).view(np.int64) for x in sets]
        yield pa.record_batch({"node": batch.column(0), "tokens": tokens, "bits": pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)), BITMAP).cast(pa.list_(pa.int64()))})


PACKED = "batch bigint, nodes binary, sizes binary, tokens binary"


def in_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, tokens) as batches of about `most` tokens, set by set."""

    def packed(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        nodes = np.array([i for i, _ in held], np.int64)
        sizes = np.array([len(x) for _, x in held], np.int64)
        row = (batch_number(iter([nodes.tobytes()])), nodes.tobytes(), sizes.tobytes(), np.concatenate([x for _, x in held]).tobytes())
        return pa.record_batch([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names=[c.split()[0] for c in PACKED.split(", ")])

    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for batch in batches:
        for node, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = np.asarray(tokens.values, np.int64)
            held.append((node, tokens))
            size += len(tokens)
            if size >= most:
                yield packed(held)
                held, size = [], 0
    if held:
        yield packed(held)


COUNTED = "group bigint, batch bigint, tokens binary, counts binary"


def count_batch(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each batch and how many of its sets have them, for each group."""
    for batch in batches:
        for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens, counts = np.unique(np.frombuffer(raw.as_buffer(), np.uint64), return_counts=True)
            cuts = np.searchsorted(group_of(tokens, groups), np.arange(groups + 1))
            rows = [(g, number, tokens[a:b].tobytes(), counts[a:b].astype(np.int64).tobytes()) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=[c.split()[0] for c in COUNTED.split(", ")])


def frequencies(rows: pa.Table) -> pa.Table:
    """For each batch, the tokens of this group that several sets have, and how many have them."""
    tokens, row = joined(rows, "tokens", np.uint64)
    counts, _ = joined(rows, "counts", np.int64)
    distinct, df = summed(tokens, counts)
    own = df[np.searchsorted(distinct, tokens)]
    kept = own > 1
    tokens, own, row = tokens[kept], own[kept], row[kept]
    cuts = np.searchsorted(row, np.arange(rows.num_rows + 1))
    numbers = rows.column("batch").to_pylist()
    out = [(numbers[k], tokens[a:b].tobytes(), own[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    return pa.table({"batch": pa.array([x[0] for x in out], pa.int64()), "tokens": pa.array([x[1] for x in out], pa.binary()), "df": pa.array([x[2] for x in out], pa.binary())})


PREFIXES = "node bigint, n bigint, shared bigint, p0 array<bigint>, p1 array<bigint>, p2 array<bigint>"


def prefixes_of(sets: pa.Table, known: pa.Table, percent: int) -> pa.Table:
    """The prefixes of a batch's sets, given the batch's shared tokens with their frequencies."""
    lists: list[list[np.ndarray]] = [[], [], []]
    about: list[tuple[int, int, int]] = []
    if sets.num_rows and known.num_rows:
        shared, _ = joined(known, "tokens", np.uint64)
        df, _ = joined(known, "df", np.int64)
        order = np.argsort(shared, kind="stable")
        shared, df = shared[order], df[order]
        nodes, sizes, tokens = (joined(sets, c, k)[0] for c, k in (("nodes", np.int64), ("sizes", np.int64), ("tokens", np.uint64)))
        spot = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
        hit = shared[spot] == tokens
        ends = np.cumsum(sizes)
        for node, n, end in zip(nodes.tolist(), sizes.tolist(), ends.tolist(), strict=True):
            own = np.flatnonzero(hit[end - n : end]) + (end - n)
            # prefix length, less the set's own tokens that come first under every order and match nothing
            room = n - -(-n * percent // 100) + 1 - (n - len(own))
            if room > 0:
                mine, freq = tokens[own], df[spot[own]]
                about.append((node, n, len(own)))
                lists[0].append(mine[np.lexsort((mine, freq))[:room]])
                for k, seed in enumerate(ORDERS, 1):
                    lists[k].append(mine[np.argsort(mixed(mine ^ np.uint64(seed)), kind="stable")[:room]])
    arrays = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64))) for x in lists]
    numbers = [pa.array([a[k] for a in about], pa.int64()) for k in range(3)]
    return pa.table([*numbers, *arrays], names=[c.split()[0] for c in PREFIXES.split(", ")])


def needed(n: Column, percent: int) -> Column:
    """Tokens that a partner of a set of n tokens shares with it, at least."""
    return F.ceil(n * percent / 100)


def tasks_for(rows: int) -> int:
    """Tasks for a table of so many short rows."""
    return max(6, -(-rows // ROWS_A_TASK))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(doc, root): for each document of edges (a, b), the smallest one that it reaches.

    Alternating large-star and small-star rounds, each written to the shared folder; a hub's neighbours are reduced to
    their minimum in the tasks, and the join back stands above two plain exchanges, so Spark can split it.
    """
    tasks = tasks_for(edges.count())
    current, mark = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", tasks), None
    for _ in range(most_rounds):
        both = current.union(current.select("b", "a"))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", tasks)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large-star", tasks)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least", tasks)
        joined = large.join(least, "a")
        small_star = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        current = stored(small_star.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", tasks)
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = current.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("root"))
    return roots.union(current.select("b", "b").distinct())


def common_needed(n: Column, m: Column, percent: int) -> Column:
    """Tokens that two sets of n and m tokens share if they link, at least."""
    return F.ceil((n + m) * percent / (100 + percent))


#: Pairs are drawn by a number below this.
DRAWN = 1 << 31


def next_share(share: int, postings: float, pairs: float) -> int:
    """How many of DRAWN parts of the pairs are looked up after the first `share` of them."""
    return min(DRAWN, max(share * GROWTH, int(DRAWN * GROWTH * postings / pairs), 1))


def cross_pairs(open_postings: DataFrame, prefixes: DataFrame, sets: DataFrame, percent: int, tasks: int, low: int, high: int) -> DataFrame:
    """Pairs (a, b) of different components that share an open token and may link, of those drawn from low on and below high."""
    # what the join needs to know of a document: its open tokens, sizes and bitmap
    known = open_postings.groupBy("doc").agg(F.collect_list("token").alias("open")).join(prefixes.select(F.col("node").alias("doc"), "n", "shared"), "doc").join(sets.select(F.col("node").alias("doc"), *[F.col("bits")[i].alias(f"bits{i}") for i in range(BITMAP)]), "doc")
    wide = stored(open_postings.join(stored(known, "open-documents", tasks), "doc"), "wide-postings", tasks)
    # linked sets' sizes are in one range or in neighbouring ones. Only sets outside a token's main component look for
    # partners, among all of the token's sets: pairs within a large component are never formed
    step = -math.log(percent / 100)
    wide = wide.withColumn("range", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9))
    left, right = (wide.select(*[F.col(c).alias(f"{x}_{c}") for c in wide.columns]) for x in "ab")
    left = left.where("a_root <> a_main").withColumn("at_range", F.explode(F.array(*[F.col("a_range") + k for k in (-1, 0, 1)])))
    needs = common_needed(F.col("a_n"), F.col("b_n"), percent)
    differing = sum((F.bit_count(F.col(f"a_bits{i}").bitwiseXOR(F.col(f"b_bits{i}"))) for i in range(1, BITMAP)), F.bit_count(F.col("a_bits0").bitwiseXOR(F.col("b_bits0"))))
    near = (F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("b_main")) | (F.col("a_doc") < F.col("b_doc")))
    if (low, high) != (0, DRAWN):
        drawn = F.shiftrightunsigned(F.xxhash64(F.least("a_doc", "b_doc"), F.greatest("a_doc", "b_doc")), 33)
        near &= (drawn >= low) & (drawn < high)
    near &= (F.least("a_shared", "b_shared") >= needs) & (F.col("a_n") + F.col("b_n") - differing >= 2 * needs) & (F.array_min(F.array_intersect("a_open", "b_open")) == F.col("a_token"))
    pairs = left.join(right, (F.col("a_token") == F.col("b_token")) & (F.col("at_range") == F.col("b_range")) & near)
    return pairs.select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b"))


def link_components(sets: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame | None:
    """(doc, root) of the documents that link with another; None if none does.

    sets: (node, tokens, bits). prefixes: (node, n, shared, p0, p1, ...): the set's size, how many of its tokens
    others have too, and a token list for each order.
    """
    orders = [c for c in prefixes.columns if c[0] == "p" and c[1:].isdigit()]
    postings = prefixes.select(F.explode("p0").alias("token"), F.col("node").alias("doc"))
    tasks = tasks_for(prefixes.select(F.sum(F.size("p0"))).first()[0] or 0)
    # tokens with the same documents give the same pairs: one of them will do. Two sums of hashes tell the sets apart
    total = lambda seed: F.sum(F.xxhash64("doc", F.lit(seed)).cast("decimal(20,0)"))
    often = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), total(1).alias("x"), total(2).alias("y"), F.min("doc").alias("first")).where("df > 1")
    often = often.groupBy("df", "x", "y", "first").agg(F.min("token").alias("token")).select("token")
    postings = stored(postings.join(stored(often, "prefix-tokens", tasks), "token"), "postings", tasks)
    info = prefixes.select("node", "n", *orders[1:]).join(sets.select("node", "tokens"), "node")
    side = lambda df, x: df.select(*[F.col(c).alias(x if c == "node" else f"{x}_{c}") for c in df.columns])

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that link: the other orders' prefixes meet, and the whole sets are near."""
        both = pairs.join(side(info, "a"), "a").join(side(info, "b"), "b")
        both = both.where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
        for p in orders[1:]:
            both = both.where(F.arrays_overlap(f"a_{p}", f"b_{p}"))
        common = F.size(F.array_intersect("a_tokens", "b_tokens"))
        return stored(both.where(common >= common_needed(F.col("a_n"), F.col("b_n"), percent)).select("a", "b"), "links", tasks)

    pivots = stored(postings.groupBy("token").agg(F.min_by("doc", F.xxhash64("doc")).alias("pivot")), "pivots", tasks)
    pairs = postings.join(pivots, "token").where("doc <> pivot").select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()

    def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
        """The roots when links are added to those that gave roots."""
        if links.isEmpty():
            return roots
        if roots is not None:
            links = roots.where("doc <> root").select(F.col("doc").alias("a"), F.col("root").alias("b")).union(links)
        return stored(components(links), "roots", tasks)

    def still_open(postings: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, float, float]:
        """(token, doc, root, main) for the tokens whose documents are of several components, main the largest one; how many; their pairs across components."""
        rooted = postings.withColumn("root", F.col("doc")) if roots is None else postings.join(roots, "doc", "left").select("token", "doc", F.coalesce("root", "doc").alias("root"))
        rooted = stored(rooted, "rooted-postings", tasks)
        of_token = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("token").agg(F.max(F.struct("k", "root")).alias("main"), F.sum("k").alias("df"), F.sum(F.col("k") * F.col("k")).alias("same"))
        open_tokens = stored(of_token.where("main.k < df").select("token", F.col("main.root").alias("main"), "df", "same"), "open-tokens", tasks)
        held, cross = open_tokens.agg(F.sum("df"), F.sum(F.col("df") * F.col("df") - F.col("same")) / 2).first()
        return stored(rooted.join(open_tokens.select("token", "main"), "token"), "open-postings", tasks), held or 0, cross or 0

    roots, low = merged(None, verified(pairs)), 0
    while low < DRAWN:
        postings, held, cross = still_open(postings.select("token", "doc"), roots)
        if not held:
            break
        high = next_share(low, held, cross)
        roots = merged(roots, verified(stored(cross_pairs(postings, prefixes, sets, percent, tasks, low, high), "cross-pairs")))
        low = high
    return roots


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(ROW, doc_id, n_shingles, component, component_id) for every row of docs (doc_id, text).

    Null and empty texts, and texts without words, have no shingles and link with nothing. Equal sets link. component_id
    is the smallest doc_id that the row's links reach, its own included; links go from text to text, so rows that share
    a doc_id, or have none, are linked each for itself (a component of nulls alone has a null). component numbers the
    components of two rows or more; it is null for a row that links with no other.
    """
    spark = docs.sparkSession
    rows = numbered(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    row_kind = rows.schema[ROW].dataType.simpleString()
    about = stored(rows.select(ROW, "doc_id", "text").mapInArrow(partial(describe, words=words), f"{ROW} {row_kind}, doc_id bigint, n bigint, address binary, half bigint"), "shingle-sets")
    classes = about.where("n > 0").groupBy("address").agg(F.min("doc_id").alias("first"), F.min(ROW).alias(ROW), F.max("n").alias("n"), F.max("half").alias("half"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "shingle-classes")
    total = about.agg(F.sum("n")).first()[0] or 0
    groups = lambda tokens: max(32, -(-tokens // GROUP_TOKENS))

    # as many tasks as groups, up to MOST_TASKS, so that a task's input stays as it is when the tokens grow; a group is counted by itself
    tasks = lambda tokens: min(MOST_TASKS, groups(tokens))
    sent = rows.select("text").mapInArrow(partial(send, groups=groups(total), words=words), SENT).repartition(tasks(total), "group")
    shared = sent.groupBy("group").applyInArrow(count_shared, SHARED).groupBy("batch").applyInArrow(sum_shared, "half bigint, shared bigint").groupBy("half").agg(F.max("shared").alias("shared"))
    alive = stored(classes.join(shared, "half").where(F.col("shared") >= needed(F.col("n"), percent)).select("node", ROW), "alive")

    sets = stored(rows.join(small(alive, 200_000), ROW).select("node", "text").mapInArrow(partial(listed, words=words), "node bigint, tokens array<bigint>, bits array<bigint>"), "sets")
    left = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    batches = stored(sets.select("node", "tokens").mapInArrow(partial(in_batches, most=held_for(groups(left), SET_TOKENS)), PACKED), "set-batches")
    counted = batches.select("batch", "tokens").mapInArrow(partial(count_batch, groups=groups(left)), COUNTED).repartition(tasks(left), "group")
    known = counted.groupBy("group").applyInArrow(frequencies, "batch bigint, tokens binary, df binary")
    prefixes = batches.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(lambda a, b: prefixes_of(a, b, percent), PREFIXES)
    roots = link_components(sets, stored(prefixes, "prefixes"), percent)

    rooted = classes.select("address", "first", "copies", F.col("node").alias("root"))
    if roots is not None:
        rooted = classes.join(roots.withColumnRenamed("doc", "node"), "node", "left").select("address", "first", "copies", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted-classes")
    several = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("rows")).where("rows > 1").select("root", "component_id"), "linked-components")
    several = rooted.select("address", "root").join(small(several, 200_000), "root")
    linked = about.join(small(stored(several, "linked-classes"), 200_000), "address", "left")
    return linked.select(ROW, "doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its number of shingles and the smallest doc_id that links reach."""
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
