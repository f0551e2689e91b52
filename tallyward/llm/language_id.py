"""Language identification by Bayesian evidence fusion.

The posterior of a language multiplies four kinds of evidence: the likelihood of the text's byte trigrams, of the
declared language, of the address suffix, and the host's prior. Trigram models are fitted on a bounded sample of rows
of each declared language: every language that any row declares takes part. Everything else covers all rows: what each language's texts declare, which suffixes they
have, and which languages each host has are sums of text posteriors by grouped aggregation. Host priors are smoothed in
levels: a host leans on its suffix, and a suffix on the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored, table
from .html_blocks import blocks_of

#: The documented bound of the sample that each declared language's trigram model is fitted on: its rows by smallest hash.
#: Of a language with many texts, FIT_MARGIN times as many are expected to be ranked, far more than chance can miss.
FIT_ROWS, FIT_MARGIN = 500, 4
BINS = 1 << 14
#: A text's trigrams hang together: they count as this many independent ones at most.
MOST_EVIDENCE = 200.0
#: Pseudo-counts: of a trigram, of a host's or suffix's parent, and of a declared value.
SMOOTH, LEAN, DECLARED = 0.5, 20.0, 1.0
#: Prior of "no known language", whose trigrams are uniform.
NONE_PRIOR = 1e-4
LEAST_POSTERIOR = 0.5
CHUNK = 1 << 20

#: Lower-case letters and bytes of other scripts stay, all else is a space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def trigrams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all byte trigrams, and where each text's begin; texts begin at starts and none reaches into the next."""
    text = FOLD[data]
    accented = np.flatnonzero((text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E)) + 1
    text[accented] += 32  # capital letters of Latin-1
    signs = np.flatnonzero(text == 0xC2)  # signs and marks of Latin-1, and of the blocks from general punctuation on
    marks = np.flatnonzero((text[:-2] == 0xE2) & (text[1:-1] <= 0xAF))
    for spot in (signs, signs + 1, marks, marks + 1, marks + 2):
        text[spot[spot < len(text)]] = 32
    inner = np.ones(len(text), bool)
    inner[1:] = (text[1:] != 32) | (text[:-1] != 32)
    inner[starts[starts < len(text)]] = True
    owner_starts = np.append(starts, len(text))
    kept = np.concatenate([[0], np.cumsum(inner)])[owner_starts]
    text = text[inner].astype(np.uint32)
    if len(text) < 3:
        return np.zeros(0, np.int64), np.zeros(len(starts) + 1, np.int64)
    code = (text[:-2] << 16 | text[1:-1] << 8 | text[2:]) * np.uint32(0x9E3779B1) >> np.uint32(18)
    inside = np.ones(len(code), bool)
    for cut in (kept[1:-1] - 1, kept[1:-1] - 2):
        inside[cut[(cut >= 0) & (cut < len(code))]] = False
    first = np.concatenate([[0], np.cumsum(inside)])[np.minimum(kept, len(code))]
    return code[inside].astype(np.int64), first


def batches_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, trigram bins, where each row's begin) over stretches of bounded size; null is empty."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        data = raw[offsets[at] : offsets[end]]
        yield at, end, *(trigrams(data, offsets[at:end] - offsets[at]) if len(data) else (np.zeros(0, np.int64), np.zeros(end - at + 1, np.int64)))
        at = end


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(declared, counts): per batch and declared language, the counts of all bins."""
    for batch in batches:
        declared = batch.column(0).to_pylist()
        sums: dict[str, np.ndarray] = {}
        for at, end, bins, first in batches_of(batch.column(1)):
            for row in range(at, end):
                own = bins[first[row - at] : first[row - at + 1]]
                if len(own):
                    sums[declared[row]] = sums.get(declared[row], 0) + np.bincount(own, minlength=BINS)
        yield pa.record_batch({"declared": pa.array(list(sums), pa.string()), "counts": pa.array([x.astype(np.int64).tobytes() for x in sums.values()], pa.binary())})


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of each bin under each: rows have text, declared.

    The languages are all that rows with letters declare. Each one's model rests on fit_rows of its texts at most, those
    of the smallest hashes. Equal texts are one.
    """
    labelled = rows.where(F.col("declared").isNotNull() & (F.trim("declared") != "") & (F.length("text") >= 3) & F.col("text").rlike(r"\p{L}"))
    labelled = labelled.select("declared", "text", F.xxhash64("text").alias("spot"))
    # a cut of the hashes, by each language's number of texts, leaves some FIT_MARGIN times fit_rows of them to be ranked
    pairs = stored(labelled.select("declared", "spot").distinct(), "language-texts")
    counts = pairs.groupBy("declared").agg(F.count(F.lit(1)).alias("texts"))
    near = pairs.join(small(counts, 100_000), "declared").where((F.col("spot") / 2.0**64 + 0.5) * F.col("texts") <= FIT_MARGIN * fit_rows)
    rank = F.row_number().over(Window.partitionBy("declared").orderBy("spot"))
    chosen = near.withColumn("rank", rank).where(F.col("rank") <= fit_rows).select("declared", "spot")
    sample = labelled.join(small(stored(chosen, "language-sample"), 200_000), ["declared", "spot"]).dropDuplicates(["declared", "spot"]).select("declared", "text")
    counts: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(count_trigrams, "declared string, counts binary").toLocalIterator():
        counts[r.declared] = counts.get(r.declared, 0) + np.frombuffer(bytes(r.counts), np.int64)
    languages = sorted(counts)
    table = np.array([np.log((counts[x] + SMOOTH) / (counts[x].sum() + SMOOTH * BINS)) for x in languages])
    return languages, table.reshape(len(languages), BINS)


def likelihoods(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch's columns but for text (the last), then its trigrams' number and mean log-likelihood per language."""
    scores = np.ascontiguousarray(model.T, np.float64)
    for batch in batches:
        means = np.zeros((batch.num_rows, len(model)))
        counts = np.zeros(batch.num_rows, np.int64)
        for at, end, bins, first in batches_of(batch.column(batch.num_columns - 1)):
            n = np.diff(first)
            counts[at:end] = n
            full = np.flatnonzero(n)
            if len(full):
                for k in range(len(model)):
                    means[at + full, k] = np.add.reduceat(scores[:, k][bins], first[full]) / n[full]
        names = batch.schema.names[:-1]
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(model))
        lists = pa.ListArray.from_arrays(offsets, pa.array(means.ravel()))
        yield pa.record_batch([*batch.columns[:-1], pa.array(counts), lists], names=[*names, "n", "means"])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used, also within lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logs: Column) -> Column:
    shares = lambda own: let(F.array_max(own), lambda top: F.transform(own, lambda x: F.exp(x - top)))
    return let(let(logs, shares), lambda own: let(total(own), lambda whole: F.transform(own, lambda x: x / whole)))


#: Numbers that a task sums up before it sends them.
HELD_SUMS = 1 << 20


def evidence_sums(batches: Iterator[pa.RecordBatch], languages: int) -> Iterator[pa.RecordBatch]:
    """(of, suffix, host, declared, language, s): each task's own sums of text posteriors, of every host and of every declared value.

    Rows are (suffix, host, declared, n, text_log).
    """
    held: dict[tuple, np.ndarray] = {}

    def packed() -> pa.RecordBatch:
        keys, values = list(held), np.concatenate(list(held.values()))
        spread = lambda i, kind: pa.array([k[i] for k in keys], kind).take(pa.array(np.repeat(np.arange(len(keys)), languages)))
        return pa.record_batch([spread(0, pa.string()), spread(1, pa.string()), spread(2, pa.string()), spread(3, pa.string()), pa.array(np.tile(np.arange(languages, dtype=np.int32), len(keys))), pa.array(values)], names=["of", "suffix", "host", "declared", "language", "s"])

    for batch in batches:
        logs = np.asarray(batch.column(4).flatten(), np.float64).reshape(batch.num_rows, languages)
        known = np.asarray(batch.column(3)) > 0
        shares = np.exp(logs - logs.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        suffix, host, declared = (batch.column(i).to_pylist() for i in range(3))
        for row in np.flatnonzero(known).tolist():
            for key in (("host", suffix[row], host[row], None), ("declared", None, None, declared[row])):
                if key in held:
                    held[key] += shares[row]
                else:
                    held[key] = shares[row].copy()
        if len(held) * languages >= HELD_SUMS:
            yield packed()
            held.clear()
    if held:
        yield packed()


def code_of(declared: Column) -> Column:
    """A declared language in lower case, without region or script: en-US and EN_us are en. Other values stay, trimmed and in lower case."""
    low = F.lower(F.trim(declared))
    return F.regexp_replace(low, "^([a-z]{2,3})[-_].*$", "$1")


def identify(rows: DataFrame, key: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(key, lang, posterior, declared, kept) for every row of rows (key, text, declared, suffix, host).

    lang is the most probable language (ties: the first by name), as code_of() writes it. A row is rejected (kept false,
    lang null) if its text has no trigram of letters, if no known language explains it better than chance, or if the best
    one's posterior is under one half. Nulls in declared, suffix and host are values of their own. If no row has a
    declared language, nothing can be told apart: rows with letters are kept, with lang null.

    Sums are kept one row a language, so that plans stay as they are however many languages are declared.
    """
    rows = rows.select(key, F.col("declared").cast("string").alias("stated"), code_of(F.col("declared").cast("string")).alias("declared"), *[F.col(c).cast("string").alias(c) for c in ("suffix", "host")], F.coalesce(F.col("text"), F.lit("")).alias("text"))
    languages, model = fit(rows, fit_rows)
    kind = rows.schema[key].dataType.simpleString()
    n_lang = len(languages)
    scored = rows.mapInArrow(partial(likelihoods, model=model), f"{key} {kind}, stated string, declared string, suffix string, host string, n bigint, means array<double>")
    if not n_lang:
        return scored.select(key, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.col("stated").alias("declared"), (F.col("n") > 0).alias("kept"))
    weight = F.least(F.col("n").cast("double"), F.lit(MOST_EVIDENCE))
    evidence = stored(scored.withColumn("text_log", F.transform("means", lambda x: x * weight)).drop("means"), "language-evidence")
    sums = evidence.select("suffix", "host", "declared", "n", "text_log").mapInArrow(partial(evidence_sums, languages=n_lang), "of string, suffix string, host string, declared string, language int, s double")
    sums = stored(sums.groupBy("of", "suffix", "host", "declared", "language").agg(F.sum("s").alias("s")), "language-sums")
    listed = lambda df, *keys: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("language", "s"))), lambda x: x["s"]).alias("s"))
    by_host = stored(listed(sums.where("of = 'host'"), "suffix", "host"), "language-hosts")
    suffixes = sums.where("of = 'host'").groupBy("suffix", "language").agg(F.sum("s").alias("s"))
    by_suffix = stored(listed(suffixes, "suffix"), "language-suffix-sums")
    found = {r.language: r.s for r in sums.where("of = 'host'").groupBy("language").agg(F.sum("s").alias("s")).collect()}  # one row a language
    whole = [1.0 + found.get(i, 0.0) for i in range(n_lang)]
    n_rows = sum(whole)
    base, all_rows = F.lit([x / n_rows for x in whole]), F.lit(whole)

    own = F.col("s")
    lean = lambda parents: let(total(own), lambda t: F.zip_with(own, parents, lambda c, p: (c + LEAN * p) / (t + LEAN)))
    # P(value | language), with the values' own shares as the prior of an unseen pair
    given = let(total(own), lambda t: F.zip_with(own, all_rows, lambda c, w: F.log((c + DECLARED * (t + 1) / n_rows) / (w + DECLARED))))
    priors = stored(by_suffix.select("suffix", lean(base).alias("prior"), given.alias("suffix_log")), "language-suffixes")
    hosts = by_host.alias("h").join(small(priors, 100_000).alias("x"), F.col("h.suffix").eqNullSafe(F.col("x.suffix")))
    hosts = hosts.select("h.suffix", "h.host", "s", "prior", "suffix_log").select("suffix", "host", F.transform(lean(F.col("prior")), lambda x: F.log(x)).alias("host_log"), "suffix_log")
    hosts = stored(hosts, "language-host-priors")
    declared = stored(listed(sums.where("of = 'declared'"), "declared").select("declared", given.alias("declared_log")), "language-declared")

    same = lambda a, b, *names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    fused = evidence.alias("e").join(small(hosts, 100_000).alias("h"), same("e", "h", "suffix", "host"), "left").join(small(declared, 100_000).alias("d"), same("e", "d", "declared"), "left")
    known = F.transform("text_log", lambda x, i: x + F.get("host_log", i) + F.get("suffix_log", i) + F.get("declared_log", i))
    # the trigrams' uniform share, and the evidence of suffix and declaration as for the average language
    none = weight * float(-np.log(BINS)) + F.lit(float(np.log(NONE_PRIOR))) + F.array_max("suffix_log") + F.array_max("declared_log")
    fused = fused.select(F.col(f"e.{key}").alias(key), F.col("e.stated").alias("stated"), "n", softmax(F.concat(known, F.array(none))).alias("p"))
    fused = fused.withColumn("most", F.array_max("p"))
    best = F.array_position("p", F.col("most")).cast("int")
    kept = F.coalesce((F.col("n") > 0) & (best <= n_lang) & (F.col("most") >= LEAST_POSTERIOR), F.lit(False))
    return fused.select(key, F.when(kept, F.get(F.lit(languages), best - 1)).alias("lang"), F.coalesce("most", F.lit(0.0)).alias("posterior"), F.col("stated").alias("declared"), kept.alias("kept"))


def of_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """identify() for documents: lang is what is declared, source is the host; there is no address."""
    return identify(docs.select(key, "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host")), key)


def page_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, text) of rows (page_id, html): the blocks' texts, read in one pass whatever the page holds."""
    for batch in batches:
        texts = [" ".join(b.text for b in blocks_of(x.as_py() or "")) for x in batch.column(1)]
        yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(texts, pa.string())], names=["page_id", "declared", "host", "text"])


def of_pages(pages: DataFrame) -> DataFrame:
    """identify() for pages: the html element's lang, the host name, and its last label are read from html and url.

    The first html tag counts, up to its end or, left open, to the page's. The text is that of the page's blocks, without
    scripts and styles.
    """
    html = F.coalesce("html", F.lit(""))
    at = F.locate("<html", F.lower(html))
    tag = F.when(at > 0, F.substring_index(F.substring(html, at + 5, F.length(html)), ">", 1))
    lang = F.regexp_extract(tag, r"""(?i)(?:^|[\s"'])lang\s*=\s*["']?([a-z]{2,3})""", 1)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    kind = pages.schema["page_id"].dataType.simpleString()
    read = pages.select("page_id", "html", F.nullif(F.lower(lang), F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    rows = stored(read.mapInArrow(page_texts, f"page_id {kind}, declared string, host string, text string"), "page-texts")
    return identify(rows.withColumn("suffix", F.nullif(F.regexp_extract(F.coalesce("host", F.lit("")), r"\.([a-z0-9-]+)$", 1), F.lit(""))), "page_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its language, the posterior, and whether it is kept."""
    return of_documents(table(spark, sf_dir, "documents"))


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its language, the posterior, and whether it is kept."""
    return of_pages(table(spark, sf_dir, "pages"))
