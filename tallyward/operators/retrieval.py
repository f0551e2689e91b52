"""Chunks of documents, keyword and vector search, and their fusion."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.sources.io import written

#: Words of a chunk at most, and the prefix that each carries.
MAX_WORDS, PREFIX = 180, "Fraud Pattern: "
K1, B = 1.2, 0.75


def sections(docs: DataFrame) -> DataFrame:
    """(source_file, pattern, position, section, body): the level-1 title and each level-2 section of Markdown texts.

    A text without sections is one, "Full Document". A text without a title has none, and title_missing tells.
    """
    title = F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1))
    head = r"(?m)^##\s+(.+)$"
    names, bodies = F.regexp_extract_all("text", F.lit(head), F.lit(1)), F.slice(F.split("text", head, -1), 2, 1_000_000_000)
    # Java's $ keeps the line break with the body, where trim() takes it off
    found = F.transform(F.arrays_zip(names.alias("n"), bodies.alias("b")), lambda x: F.struct(F.trim(x["n"]).alias("section"), F.regexp_replace(x["b"], r"^\s+|\s+$", "").alias("body")))
    rest = F.regexp_replace(F.regexp_replace("text", r"(?m)\A((?:(?!^#\s).*\n)*?)^#\s+.+$", "$1"), r"^\s+|\s+$", "")
    whole = F.array(F.struct(F.lit("Full Document").alias("section"), rest.alias("body")))
    out = docs.select("source_file", title.alias("pattern"), (title == "").alias("title_missing"), F.posexplode(F.when(F.size(names) > 0, found).otherwise(whole)).alias("position", "s"))
    return out.select("source_file", "pattern", "title_missing", "position", "s.*")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def chunked(parts: DataFrame, key: list[str], max_words: int = MAX_WORDS, paragraph: str = r"\n\s*\n") -> DataFrame:
    """Chunks of parts (key, pattern, section, body): whole paragraphs while they fit, prefixed by pattern and section.

    A section within the budget is one chunk as it stands. A paragraph over the budget is cut between words. The budget
    counts the prefix. Gives key, chunk, text and word_count.
    """
    prefix = F.concat(F.lit(PREFIX), F.col("pattern"), F.lit("\n\n## "), F.col("section"), F.lit("\n"))
    budget = F.greatest(F.lit(1), F.lit(max_words) - n_words(prefix))
    paragraphs = F.filter(F.transform(F.split("body", paragraph), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    def cut(p: Column) -> Column:
        words = F.filter(F.split(p, r"\s+"), lambda w: w != "")
        steps = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / F.col("budget")).cast("int"))
        return F.when(F.size(words) <= F.col("budget"), F.array(p)).otherwise(F.transform(steps, lambda i: F.array_join(F.slice(words, i * F.col("budget") + 1, F.col("budget")), " ")))

    full = F.concat(prefix, F.col("body"))
    fits = n_words(full) <= max_words
    rows = parts.withColumn("prefix", prefix).withColumn("budget", budget.cast("int")).withColumn("whole", F.when(fits, full))
    rows = rows.withColumn("ps", F.when(fits, F.array("body")).otherwise(F.flatten(F.transform(paragraphs, cut))))
    rows = rows.withColumn("at", packed(F.transform("ps", n_words), F.col("budget")))
    # paragraphs of one chunk are neighbours: from where its number first stands to where the next one does
    first = F.filter(F.transform("at", lambda g, i: F.when((i == 0) | (g != F.get("at", i - 1)), i)), lambda i: i.isNotNull())
    piece = lambda start, i, starts: F.array_join(F.slice("ps", start + 1, F.coalesce(F.get(starts, i + 1), F.size("ps")) - start), "\n\n")
    groups = F.get(F.transform(F.array(first), lambda starts: F.transform(starts, lambda start, i: piece(start, i, starts))), F.lit(0))
    groups = F.when(F.size("ps") > 0, groups).otherwise(F.array(F.lit("")))
    out = rows.select(*key, "section", "whole", "prefix", F.posexplode(groups).alias("chunk", "part"))
    text = F.coalesce("whole", F.concat("prefix", "part"))
    return out.where(F.col("whole").isNotNull() | (F.col("part") != "")).select(*key, "section", "chunk", text.alias("text"), n_words(text).cast("bigint").alias("word_count"))


def packed(sizes: Column, budget: Column) -> Column:
    """The number of the chunk of each paragraph: as many in a row as fit, one at least. Each depends on all before it."""

    @F.pandas_udf("array<int>")
    def number(lists: pd.Series, most: pd.Series) -> pd.Series:
        def one(own: Sequence[int], room: int) -> list[int]:
            out, chunk, n = [], 0, 0
            for size in own:
                if not chunk or n + size > room:
                    chunk, n = chunk + 1, 0
                n += int(size)
                out.append(chunk)
            return out

        return pd.Series([one(x, m) for x, m in zip(lists, most, strict=True)], dtype=object)

    return number(sizes, budget)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(docs: DataFrame, key: str, query: str) -> DataFrame:
    """(key, score) of the documents with a query term.

    Texts are read once: that pass writes the documents with a term, and counts all of them as it goes.
    """
    wanted = sorted({t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
    equals = lambda term: lambda x: x == term
    sized = docs.select(key, terms(F.col("text")).alias("ts")).select(key, F.size("ts").alias("len"), *[F.size(F.filter("ts", equals(t))).alias(f"tf{i}") for i, t in enumerate(wanted)])
    seen = Observation()
    sized = sized.observe(seen, F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("all_len"), F.count("len").alias("n_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    found = written(sized.where(F.greatest(F.lit(0), *[F.col(f"tf{i}") for i in range(len(wanted))], F.lit(0)) > 0), "bm25")
    s = seen.get
    mean = s["all_len"] / s["n_len"] if s["all_len"] else 1.0
    idf = lambda i: math.log(1 + (s["n_docs"] - s[f"df{i}"] + 0.5) / (s[f"df{i}"] + 0.5))
    part = lambda i: idf(i) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / mean))
    return found.select(key, sum((part(i) for i in range(len(wanted))), F.lit(0.0)).alias("score")).where("score > 0")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is all zeros."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector_scores(vectors: DataFrame, key: str, query: DataFrame) -> DataFrame:
    """(key, score) of all vectors against the one row of query (embedding)."""
    return vectors.crossJoin(F.broadcast(query.select(F.col("embedding").alias("_q")).limit(1))).select(key, cosine(F.col("embedding"), F.col("_q")).alias("score"))


def top(scores: DataFrame, key: str, k: int) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), key).limit(k)


def hybrid(words: DataFrame, vectors: DataFrame, key: str, alpha: float = 0.5, k: int = 5, among: DataFrame | None = None) -> DataFrame:
    """The k best by alpha times the vector score and 1 - alpha times the keyword score, each spread from 0 to 1.

    With `among` (key), only these are searched: the filter comes before scores are spread. A document that one search didn't find has 0 there; if all scores of a search are equal, they are 1.
    """

    def spread(df: DataFrame, name: str) -> DataFrame:
        df = written(df if among is None else df.join(among.select(key).distinct(), key, "left_semi"), "scores")
        limits = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        return df.crossJoin(F.broadcast(limits)).select(key, F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias(name))

    both = spread(words, "w").join(spread(vectors, "v"), key, "full_outer")
    score = alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("w", F.lit(0.0))
    return top(both.select(key, score.alias("score")), key, k)


def hashed_embedding(dimensions: int = 64) -> Callable[[Column], Column]:
    """A stand-in for a trained model: words hashed to signed dimensions, scaled to length 1."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> np.ndarray:
            out = np.zeros(dimensions, np.float32)
            for h in pd.util.hash_array(np.array((text or "").lower().split(), dtype=object)) if (text or "").split() else ():
                out[int(h % dimensions)] += 1.0 if h >> np.uint64(63) else -1.0
            return out / max(float(np.sqrt((out**2).sum())), 1e-12)

        return texts.map(one)

    return embed


#: A public vocabulary of lower-case word pieces, as the tokenizers library reads it; give another model's for another model.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def token_counter(vocabulary: str = VOCABULARY) -> Callable[[Column], Column]:
    """How many tokens a text has by a tokenizer's own file, read here and sent to the tasks. Null and empty texts have none."""
    with open(vocabulary, encoding="utf-8") as f:
        made_of = f.read()

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(made_of)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        for texts in batches:
            found = tokenizer.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([len(x.ids) for x in found], dtype="int64")

    return count


#: Fixed value: tokens that the embedding model reads; it would silently drop what comes after.
MODEL_TOKENS = 256


def embedded(chunks: DataFrame, embed: Callable[[Column], Column], count_tokens: Callable[[Column], Column] = n_words, limit: int = MODEL_TOKENS) -> DataFrame:
    """chunks with n_tokens, truncated (whether the model would cut the text) and embedding."""
    n = count_tokens(F.col("text")).cast("bigint")
    return chunks.withColumns({"n_tokens": n, "truncated": n > limit, "embedding": embed(F.col("text"))})


def ingest(docs: DataFrame, embed: Callable[[Column], Column], path: str, count_tokens: Callable[[Column], Column] = n_words) -> DataFrame:
    """Markdown texts (source_file, text) to an embedded collection: cut, checked against the model's length, written.

    The collection at path is replaced as a whole. Texts without a title are refused, as are chunks that the model
    would cut: an error names how many there are, and nothing is written.
    """
    parts = sections(docs)
    chunks = embedded(chunked(parts, ["source_file"]), embed, count_tokens)
    untitled, long = parts.where("title_missing").count(), chunks.where("truncated").count()
    if untitled or long:
        raise ValueError(f"{untitled} sections without a title, {long} chunks over {MODEL_TOKENS} tokens")
    chunks.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(chunks.schema).parquet(path)


def formatted(hits: DataFrame, texts: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(rank, line) of the k best hits (key, score), with the beginnings of their texts (key, text)."""
    best = top(hits, key, k)
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), key))  # k rows
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] score "), F.format_number("score", 3), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 60))
    return best.withColumn("rank", rank).join(texts, key, "left").select("rank", line.alias("line"))
