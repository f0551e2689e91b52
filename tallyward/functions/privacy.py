"""Pseudonyms and redaction of personal data in traces."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose values identify a person.
PII_KEYS = frozenset({"full_name", "name", "home_city", "home_country", "home_latitude", "home_longitude", "email", "phone"})


def pseudonym(value: Column) -> Column:
    """[REDACTED: and the first 12 hexadecimal digits of the SHA-256 ]; null stays null."""
    return F.concat(F.lit("[REDACTED:"), F.substring(F.sha2(value.cast("string"), 256), 1, 12), F.lit("]"))


def _mark(value: object) -> str:
    return f"[REDACTED:{hashlib.sha256(str(value).encode()).hexdigest()[:12]}]"


def _hide(node: object, keys: frozenset[str]) -> object:
    if isinstance(node, dict):
        return {k: _mark(v) if k.lower() in keys and v is not None and not isinstance(v, dict | list) else _hide(v, keys) for k, v in node.items()}
    if isinstance(node, list):
        return [_hide(x, keys) for x in node]
    if isinstance(node, str) and node[:1] in ("{", "["):
        try:
            return json.dumps(_hide(json.loads(node), keys))
        except ValueError:
            return node
    return node


def redact_json(column: Column, keys: frozenset[str] = PII_KEYS) -> Column:
    """JSON text of any depth with the values of identifying keys replaced; text that isn't JSON stays as it is.

    A known schema needs only pseudonym(); this is for arbitrary nesting, JSON within JSON strings included.
    """

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(_hide(json.loads(text), keys))
            except ValueError:
                return text

        return texts.map(one)

    return redact(column)


#: Automata that a task keeps: the steps of a trace come one after the other, or nearly so.
KEPT = 64


def _automaton(values: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for v in values:
        found.add_word(v, v)
    found.make_automaton()
    return found


def hide_longest(text: str, automaton: ahocorasick.Automaton) -> str:
    """text with the automaton's values replaced by their pseudonyms, the longest first wherever they stand, ties from the left.

    One pass finds all places of all values; what has been replaced is never looked into again.
    """
    places = sorted((-len(v), end - len(v) + 1, v) for end, v in automaton.iter(text))
    taken = bytearray(len(text))
    spans = []
    for n, start, value in places:
        if not any(taken[start : start - n]):
            taken[start : start - n] = b"\1" * -n
            spans.append((start, start - n, value))
    out, at = [], 0
    for start, end, value in sorted(spans):
        out += [text[at:start], _mark(value)]
        at = end
    return "".join([*out, text[at:]])


def scrub_literals(text: Column, values: Column) -> Column:
    """text with each of the values replaced by its pseudonym, longest first; empty and missing values are passed over."""

    @F.pandas_udf("string")
    def scrub(texts: pd.Series, lists: pd.Series) -> pd.Series:
        made = lru_cache(KEPT)(_automaton)

        def one(text: str | None, own: Sequence[str] | None) -> str | None:
            own = tuple(sorted({v for v in own if v})) if own is not None else ()
            return hide_longest(text, made(own)) if text and own else text

        return pd.Series([one(t, x) for t, x in zip(texts, lists, strict=True)], dtype=object)

    return scrub(text, values)


def scrub_traces(steps: DataFrame, trace: str, text: str, found: DataFrame) -> DataFrame:
    """steps with `text` scrubbed of all values (trace, value) found anywhere in the same trace.

    A trace's distinct values travel to its steps; they are names and places of one case, a short list, and are looked
    for all at once by one automaton.
    """
    values = found.groupBy(trace).agg(F.array_sort(F.collect_set("value")).alias("_values"))
    empty = F.array().cast("array<string>")
    return steps.join(values, trace, "left").withColumn(text, scrub_literals(F.col(text), F.coalesce("_values", empty))).drop("_values")
