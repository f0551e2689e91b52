"""Keyed state for groups of users: a trigger's rows of a group come as packs, and its state is one value.

Spark hands rows to a Python state processor one by one, and asks the store once or more for each key. So users are dealt
to groups by hash, the rows of a task and group become one value (an Arrow stream), and the processor computes on whole
columns. Users stay apart within a group: each has rows of its own in the group's state, with an expiry of its own.
Ids of any kind and missing ones stay themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tallyward.operators.location import bases, impossible

#: Groups that users are dealt to; rows that a task packs at once; rows of a batch that comes out of a pack.
GROUPS, PACK_ROWS, BATCH_ROWS = 1024, 250_000, 10_000


def as_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def as_table(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(value).read_all()


def packed(rows: DataFrame) -> DataFrame:
    """(pack_group, pack): rows by groups of their user_id."""

    def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        of = table.column("pack_group").to_numpy()
        order = np.argsort(of, kind="stable")
        table = table.drop_columns(["pack_group"]).take(order).combine_chunks()
        groups, starts = np.unique(of[order], return_index=True)
        values = [as_bytes(table.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(of)], strict=True)]
        return pa.record_batch([pa.array(groups, pa.int32()), pa.array(values, pa.binary())], names=["pack_group", "pack"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch] if batch.num_rows else held, n + batch.num_rows
            if n >= PACK_ROWS:
                yield dealt(held)
                held, n = [], 0
        if held:
            yield dealt(held)

    return rows.withColumn("pack_group", F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).cast("int")).mapInArrow(deal, "pack_group int, pack binary")


def unpacked(packs: DataFrame, schema: str) -> DataFrame:
    """The rows of the column `pack`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("pack"):
                yield from as_table(value.as_py()).to_batches(max_chunksize=BATCH_ROWS)

    return packs.select("pack").mapInArrow(rows, schema)


class PackProcessor(StatefulProcessor):
    """What processors of packs share."""

    def given(self, rows: Iterable[Row]) -> pa.Table:
        return pa.concat_tables([as_table(r["pack"]) for r in rows]).combine_chunks()

    def held(self, state, now: int | None = None) -> pa.Table | None:
        """The table that a state holds, without the rows that have expired by now (milliseconds)."""
        value = state.get()
        if value is None:
            return None
        table = as_table(value[0])
        return table if now is None else table.filter(pc.greater(table.column("expires"), now))

    def keep(self, state, table: pa.Table) -> None:
        if table.num_rows:
            state.update((as_bytes(table),))
        elif state.exists():
            state.clear()

    def close(self) -> None:
        pass


def one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def joined(*tables: pa.Table, column: str) -> pa.Array:
    """A column of one table after the other."""
    return pa.concat_arrays([one(t.column(column)) for t in tables])


def codes_of(users: pa.Array) -> np.ndarray:
    """A number for each user, missing ones being one user."""
    return users.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)


class Keyed:
    """Numbers for pairs of a code and a value, in the order of both, whatever their size."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.step = len(self.values) + 1
        self.keys = codes * self.step + np.searchsorted(self.values, values)

    def below(self, codes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The key that the first pair of this code with this value or a larger one has at least."""
        return codes * self.step + np.searchsorted(self.values, values, "left")

    def above(self, codes: np.ndarray, values: np.ndarray) -> np.ndarray:
        return codes * self.step + np.searchsorted(self.values, values, "right")


def placed(new: pa.Table, old: pa.Table | None, expires: int) -> tuple[pa.Table, pa.Table]:
    """The rows of new with the place that each is compared with (prev_lat, prev_lon, prev_city, prev_at); and the places held after.

    new: user_id, transaction_id, latitude, longitude, city, at, ...; old: user_id, lat, lon, city, at, expires. A user's
    rows are taken in time order, null times first, equal times by transaction_id. Each is compared with the last believed
    place: that held before, or that of a row before it.
    """
    if old is None:
        old = pa.table({"user_id": one(new.column("user_id")).slice(0, 0), "lat": pa.array([], pa.float64()), "lon": pa.array([], pa.float64()), "city": pa.array([], pa.string()), "at": pa.array([], pa.int64()), "expires": pa.array([], pa.int64())})
    n = old.num_rows
    new = new.set_column(new.schema.get_field_index("city"), "city", one(new.column("city")).cast(pa.string()))
    number = lambda c: one(c).cast(pa.float64()).fill_null(float("nan"))
    users = joined(old, new, column="user_id")
    all_lat = pa.concat_arrays([one(old.column("lat")), number(new.column("latitude"))])
    all_lon = pa.concat_arrays([one(old.column("lon")), number(new.column("longitude"))])
    city, moment = joined(old, new, column="city"), joined(old, new, column="at")
    ids = pa.concat_arrays([pa.nulls(n, new.schema.field("transaction_id").type), one(new.column("transaction_id"))])
    codes, is_new = codes_of(users), np.arange(len(users)) >= n
    order = pc.sort_indices(pa.table({"user": codes, "new": is_new, "at": moment, "id": ids}), sort_keys=[(c, "ascending") for c in ("user", "new", "at", "id")], null_placement="at_start").to_numpy()
    codes, is_new = codes[order], is_new[order]
    lat, lon, at = all_lat.to_numpy()[order], all_lon.to_numpy()[order], moment.fill_null(0).to_numpy()[order]
    known = (lat != 0) & (lon != 0) & ~np.isnan(lat) & ~np.isnan(lon) & moment.is_valid().to_numpy(zero_copy_only=False)[order]
    first = np.ones(len(order), bool)
    first[1:] = codes[1:] != codes[:-1]
    of, _ = bases(first, lat, lon, at, known, None)

    rows = np.flatnonzero(is_new)
    base = of[rows]
    pick = pa.array(order[np.maximum(base, 0)], mask=base < 0)
    out = new.take(pa.array(order[rows] - n))
    for name, column in (("prev_lat", all_lat), ("prev_lon", all_lon), ("prev_city", city), ("prev_at", moment)):
        out = out.append_column(name, column.take(pick))

    last = np.flatnonzero(np.append(first[1:], True))
    base = of[last]
    b = np.maximum(base, 0)
    believed = known[last] & ~((base >= 0) & impossible(lat[b], lon[b], at[b], lat[last], lon[last], at[last]))
    held, touched = np.where(believed, last, base), is_new[last]
    last, touched, held = last[held >= 0], touched[held >= 0], held[held >= 0]
    until = pa.concat_arrays([one(old.column("expires")), pa.nulls(new.num_rows, pa.int64())]).fill_null(expires).to_numpy()[order[held]]
    after = {"user_id": users.take(pa.array(order[held])), "lat": lat[held], "lon": lon[held], "city": city.take(pa.array(order[held])), "at": at[held], "expires": np.where(touched, expires, until)}
    return out, pa.table(after)


def counted(new: pa.Table, old: pa.Table | None, length: int, kept: int, expires: int) -> tuple[np.ndarray, pa.Table]:
    """For each row of new (user_id, at) its user's times, old ones (user_id, at, expires) and new, in the `length` up to and including its own; and the times held after, those within `kept` of each user's latest."""
    if old is None:
        old = pa.table({"user_id": one(new.column("user_id")).slice(0, 0), "at": pa.array([], pa.int64()), "expires": pa.array([], pa.int64())})
    n = old.num_rows
    users, moment = joined(old, new, column="user_id"), joined(old, new, column="at")
    codes, timed = codes_of(users), moment.is_valid().to_numpy(zero_copy_only=False)
    at = moment.fill_null(0).to_numpy()
    keyed = Keyed(codes[timed], at[timed])
    keys = np.sort(keyed.keys)
    counts = np.searchsorted(keys, keyed.above(codes[n:], at[n:])) - np.searchsorted(keys, keyed.below(codes[n:], at[n:] - length))

    rows, size = np.flatnonzero(timed), int(codes.max(initial=-1)) + 1
    latest, touched = np.full(size, np.iinfo(np.int64).min), np.zeros(size, bool)
    np.maximum.at(latest, codes[rows], at[rows])
    touched[codes[rows[rows >= n]]] = True
    rows = rows[at[rows] >= latest[codes[rows]] - kept]
    until = np.append(one(old.column("expires")).to_numpy(), np.full(new.num_rows, expires))[rows]
    return counts, pa.table({"user_id": users.take(pa.array(rows)), "at": at[rows], "expires": np.where(touched[codes[rows]], expires, until)})


def windowed(new: pa.Table, old: pa.Table | None, slide: int, panes: int, mark: int | None) -> tuple[pa.Table, pa.Table]:
    """(user_id, first, n) of the windows that hold rows of new and that the watermark (microseconds) hasn't passed, as they stand now; and the panes held after.

    A pane is a slide's stretch of time, and a window so many panes from the one named first. new: user_id, at; panes held:
    user_id, pane, n. A row whose windows have all been passed counts nowhere.
    """
    open_ = lambda first: np.ones(len(first), bool) if mark is None else (first + panes) * slide > mark
    new = new.filter(pc.is_valid(new.column("at")))
    own = pa.table({"user_id": one(new.column("user_id")), "pane": one(new.column("at")).to_numpy() // slide, "n": np.ones(new.num_rows, np.int64)})
    both = own if old is None else pa.concat_tables([old, own])
    fresh = np.arange(both.num_rows) >= both.num_rows - own.num_rows
    live = open_(both.column("pane").to_numpy())
    both, fresh = both.filter(pa.array(live)), fresh[live]
    users, pane, n = one(both.column("user_id")), both.column("pane").to_numpy(), both.column("n").to_numpy()
    codes = codes_of(users)
    keyed = Keyed(codes, pane)
    keys, some, inverse = np.unique(keyed.keys, return_index=True, return_inverse=True)
    sums = np.bincount(inverse, n, len(keys)).astype(np.int64)
    held = pa.table({"user_id": users.take(pa.array(some)), "pane": pane[some], "n": sums})

    changed = some[np.unique(inverse[fresh])]
    row, first = np.repeat(changed, panes), (pane[changed][:, None] - np.arange(panes)).ravel()
    row, first = row[open_(first)], first[open_(first)]
    row = row[each := np.unique(Keyed(codes[row], first).keys, return_index=True)[1]]
    first, totals = first[each], np.append(0, np.cumsum(sums))
    counts = totals[np.searchsorted(keys, keyed.above(codes[row], first + panes - 1))] - totals[np.searchsorted(keys, keyed.below(codes[row], first))]
    return pa.table({"user_id": users.take(pa.array(row)), "first": first, "n": counts}), held
