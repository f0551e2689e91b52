"""Lexical search, phrases and fingerprints against brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyward.llm import collocations, lexical_search, simhash

from .helpers import near_group, table, words, write

# ---- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
EDGE = [(None, "alpha beta", "en", None), (None, None, None, None), (900, "", "en", "a"), (901, "  .,; ", "en", "a"), (902, "Ébène-ALPHA_beta\x00É", None, "b")]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_ranked(docs, items, k=50):
    held = [(i, TERM.findall(low(t))) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    big_n, big_l = len(held), sum(len(w) for _, w in held)
    df, out = {}, []
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    for item, text in items:
        asked, scores = set(TERM.findall(low(text))), []
        for i, w in held:
            m = 100 - 50 + (50 * len(w) * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in asked & set(w))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(str(item), rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def found(df):
    return sorted(str((str(r.item_id), r["rank"], r.doc_id, r.score)) for r in df.collect())


ITEMS = "item_id bigint, text string"


@pytest.mark.parametrize("shard, block, chunk", [(1 << 21, 1 << 20, 1 << 20), (300, 40, 7), (1, 1 << 20, 50)])
def test_op13_equals_brute(spark, monkeypatch, shard, block, chunk):
    monkeypatch.setattr(lexical_search, "CHUNK", chunk)
    rng = random.Random(13)
    rows = [(i, words(rng.choice([1, 5, 40, 200]), rng, 60), "en", "a") for i in range(150)]
    rows += [(300 + i, rows[3][1], "en", "a") for i in range(80)] + rows[:5] + EDGE  # ties beyond the limit, repeated rows
    items = [(i, words(rng.choice([1, 3, 12]), rng, 70)) for i in range(20)] + [(20, rows[3][1]), (20, None), (21, ""), (None, "alpha w1"), (22, "ÉBÈNE é unknown"), (3, "w1 w1 w2")]
    docs = table(spark, rows, {"score": 1, "item": "x", "rank": "y", "n": "z"})
    asked = spark.createDataFrame(items, ITEMS).withColumn("terms", F.lit("own"))
    got = found(lexical_search.ranked(docs, asked, shard_postings=shard, block_terms=block))
    assert got == brute_ranked([(i, t) for i, t, *_ in rows], items)


def test_op13_stops_before_the_end_of_its_lists():
    """Most places of long lists are never read when the best documents stand at the top."""
    import numpy as np

    n = 100_000
    owner, terms = np.tile(np.arange(n), 2), np.repeat([0, 1], n)
    impacts = np.tile(np.arange(n, 0, -1), 2)
    shard = lexical_search.Shard(owner, terms, impacts, n, 2)
    docs, scores = shard.best(np.array([0, 1]), np.array([3, 2]), 50, np.zeros(0, np.int64))
    assert len(docs) < 200 and sorted(scores.tolist())[-50:] == [5 * x for x in range(n - 49, n + 1)]


def test_op13_empty_tables(spark, tmp_path):
    docs, items = table(spark, [(1, "alpha", "en", "a")]), spark.createDataFrame([(1, "alpha")], ITEMS)
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("false"), items.where("false"))):
        assert lexical_search.ranked(d, i).count() == 0
    sf = write(items, tmp_path, "benchmark")
    write(docs, tmp_path, "documents")
    assert found(lexical_search.op13_lexical_search(spark, sf)) == found(lexical_search.ranked(docs, items))


# ---- phrases


def brute_phrases(docs, top, least, longest=5):
    """(lang, rank, phrase, a, l, r, n, score), from counts of all phrases."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) >= 2}
        dropped = {q for p, a in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if (q := p[i : i + k]) in often and 100 * a >= 100 * often[q]}
        rows = []
        for p, a in often.items():
            if p not in dropped:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(map(str, out))


def zipf(rng, n, vocabulary=120):
    names = [f"v{i}" for i in range(vocabulary)]
    made = rng.choices(names, [1 / (i + 1) for i in range(vocabulary)], k=n)
    sure = [["new", "york"], ["of", "the", "new", "york", "times"], ["rare", "v0", "pair"], ["a", "b", "c", "d", "e", "f", "g"], ["É", "ß"]]
    for _ in range(n // 25):
        made[rng.randrange(n)] = " ".join(rng.choice(sure))
    return "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for w in made)


@pytest.mark.parametrize("top, least, settings", [(2000, 6, {}), (12, 5, {"most_words": 3}), (25, 6, {"batch": 40})])
def test_op11_equals_brute(spark, monkeypatch, top, least, settings):
    monkeypatch.setattr(collocations, "ROW_NUMBERS", 500)
    monkeypatch.setattr(collocations, "CHUNK", 300)
    monkeypatch.setattr(collocations, "HELD_WORDS", 40)
    rng = random.Random(top)
    docs = [(rng.choice(["en", "en", "en", "fr", None, "und", ""]), zipf(rng, rng.choice([1, 30, 400]))) for _ in range(60)]
    docs += [("en", None), ("en", ""), ("xx", " .,; "), ("en", "x " * 40 + "The NEW york"), *docs[:3]]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(docs)], "doc_id int, text string, lang string").withColumn("word", F.lit("own")).withColumn("n", F.lit(1))
    got = collocations.collocations(df.repartition(3), top, least, **settings)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_phrases(docs, top, least)


def test_op11_expands_no_more_than_it_must(spark, monkeypatch):
    """Words whose bound is below the threshold never become first words of a count."""
    asked, own = [], collocations.grow
    monkeypatch.setattr(collocations, "grow", lambda codes, roots, counts, *rest: asked.extend(counts.tolist()) or own(codes, roots, counts, *rest))
    rng = random.Random(4)
    text = " ".join(rng.choices(["the", "of", "and"], k=30_000)) + ". " + " . ".join(f"p{i} q{i}" for i in range(400) for _ in range(5 + i % 7))
    got = collocations.collocations(spark.createDataFrame([("en", text)], "lang string, text string"), 100, 5).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_phrases([("en", text)], 100, 5) and max(asked) < 9_000


def test_op11_products_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**12, 10**14, 3 * 10**11 + 7, 10**13 + 1)], "a bigint, n bigint, l bigint, r bigint")
    assert big.select(F.expr(collocations.SCORE)).first()[0] == 1000 * 10**12 * 10**14 // ((3 * 10**11 + 7) * (10**13 + 1))


def test_op11_empty(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0 and len(collocations.collocations(none).columns) == 8
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "a b c")], "lang string, text string")).count() == 0


# ---- fingerprints


def brute_prints(texts):
    """The fingerprint of each text and of any other by the same weights."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if w]
    bin_of = lambda w: to_signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) % simhash.BINS
    bins = Counter(bin_of(w) for t in texts for w in split(t))
    total = sum(bins.values())

    def weight(w):
        if not bins[bin_of(w)]:
            return simhash.HEAVIEST
        doublings = min(simhash.DOUBLINGS, math.floor(math.log2(total / bins[bin_of(w)])))
        return max(1, doublings * doublings // 4)

    def fingerprint(t):
        ones, whole = [0] * 64, 0
        for w in split(t):
            h = xxhash.xxh64((64).to_bytes(4, "little"), seed=xxhash.xxh64(w.encode(), seed=42).intdigest()).intdigest()
            whole += weight(w)
            for b in range(64):
                ones[b] += weight(w) * (h >> b & 1)
        return sum(1 << b for b in range(64) if 2 * ones[b] > whole)

    return fingerprint


def to_signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("range_rows, block", [(2048, 1 << 15), (4, 4)])
def test_op12_equals_brute(spark, monkeypatch, range_rows, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(12)
    rows = [(i * i, words(rng.choice([1, 3, 60, 150]), rng, 500), "en", "a") for i in range(60)] + [(5000 + i, t, "en", "a") for i, t in enumerate(near_group(rng, 25, 150, 4))]
    rows += [(6000, "x", "en", "a"), (6001, "é" * 7 + " ÀÉ 𝒳𝒴", "fr", "a"), (6002, None, None, None), (6003, "", "en", "a"), (6004, " ,. ", "en", "a"), (6005, rows[70][1], "en", "b")]
    got = simhash.fingerprint_documents(table(spark, rows, {"file": "x", "at": 1, "range": 2, "fp": 3, "word": "w"}).repartition(3), range_rows=range_rows).collect()
    texts = {i: t or "" for i, t, *_ in rows}
    ids, print_of = sorted(texts, reverse=True), brute_prints(texts.values())
    prints = {i: print_of(t) for i, t in texts.items()}
    root = {i: i for i in ids}
    for _ in ids:  # the smallest id spreads along the links
        root = {i: min(root[j] for j in ids if (prints[i] ^ prints[j]).bit_count() <= 3) for i in ids}
    assert sorted(r.doc_id for r in got) == sorted(ids)
    for r in got:
        text, following = texts[r.doc_id], ids[(ids.index(r.doc_id) + 1) % len(ids)]
        third = len(text) // 3
        edited = text[: len(text) - third] + texts[following][:third]
        want = print_of(edited)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (f"{prints[r.doc_id]:016x}", f"{want:016x}")
        assert r.near_edited == 1 - (prints[r.doc_id] ^ want).bit_count() / 64 and r.near_next == 1 - (prints[r.doc_id] ^ prints[following]).bit_count() / 64
        assert r.class_id == root[r.doc_id]


def test_op12_repeated_and_missing_ids(spark, tmp_path):
    rows = [(7, f"text {i}", "en", "a") for i in range(40)] + [(None, f"none {i}", "en", "a") for i in range(40)] + [(3, "low", "en", "a"), (9, "high", "en", "a")]
    out = simhash.with_next(table(spark, rows), 5).collect()
    follows = {r.text: r.next_text for r in out}
    assert len(follows) == len(rows) and set(follows.values()) == {t for _, t, *_ in rows}
    at, order = "high", []
    for _ in rows:
        order.append(at)
        at = follows[at]
    assert at == "high" and [{"t": 0, "l": 1, "n": 2}[t[0]] for t in order[1:]] == [0] * 40 + [1] + [2] * 40
    sf = write(table(spark, rows[:1]), tmp_path, "documents")
    (one,) = simhash.op12_simhash(spark, sf).collect()
    assert one.near_next == 1.0 and one.class_id == 7
    assert simhash.fingerprint_documents(table(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("radius, large", [(3, 512), (3, 2), (6, 4)])
def test_block_tables_lose_no_near_fingerprint(spark, radius, large):
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:20]:
        for _ in range(8):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, radius + 2)))
            prints.add(p)
    root = {p: p for p in prints}
    for _ in range(40):
        root = {p: min(root[q] for q in prints if (p ^ q).bit_count() <= radius) for p in prints}
    got = simhash.near_classes(spark.createDataFrame([(to_signed(p),) for p in prints], "fp bigint"), radius, large)
    groups = defaultdict(set)
    for p, r in root.items():
        groups[r].add(to_signed(p))
    found = defaultdict(set)
    for r in got.collect():
        found[r.root].add(r.fp)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_op12_tells_near_texts_from_others(spark):
    rng = random.Random(5)
    names = [f"w{i}" for i in range(5000)]
    weights = [1 / (i + 1) for i in range(5000)]
    rows = [(i, " ".join(rng.choices(names, weights, k=200)), "en", "a") for i in range(120)]
    out = simhash.fingerprint_documents(table(spark, rows)).collect()
    assert sum(r.near_edited > r.near_next for r in out) > 0.95 * len(out)


def test_shared_folders_can_be_cleared(spark):
    import os

    from tallyward.llm import common

    kept, common.GIVEN[:] = list(common.GIVEN), []
    a, b = (common.stored(spark.range(n), "test") for n in (3, 4))
    folders = list(common.GIVEN)
    assert a.count() + b.count() == 7 and all(os.path.isdir(f.removeprefix("file://")) for f in folders)
    assert common.clear_shared(spark) == 2 and not any(os.path.exists(f.removeprefix("file://")) for f in folders) and common.clear_shared(spark) == 0
    common.GIVEN[:] = kept
