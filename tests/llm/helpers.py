"""Brute-force versions and small tables shared by the tests."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, extra=None):
    """documents of (doc_id, text, lang, source); with clashing extra columns if asked."""
    df = spark.createDataFrame([(i, t, x, s, len(t or "")) for i, t, x, s in rows], SCHEMA)
    for name, value in (extra or {}).items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(value))
    return df


def write(df, path, name):
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def words(n, rng, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """doc_id to (shingles, smallest linked doc_id), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_group(rng, size, n_words=120, edits=6):
    """Texts near one base, with edits in random places."""
    base = words(n_words, rng, 10_000).split()
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out
