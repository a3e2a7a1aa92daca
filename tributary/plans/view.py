"""Continuous views: aggregates kept as merged partial states, finished when read."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import date_round, interval_micros
from ..operators.aggregate import Agg, finish, merge_states, partial_states
from ..sources.stores import MemoryStore

BUCKET, GROUPING = "_bucket", "grouping_id"
ALL = "_all"
STEP_FACTOR = 5


def cube(*keys: str) -> list[list[str]]:
    return [list(c) for n in range(len(keys), -1, -1) for c in combinations(keys, n)]


def rollup(*keys: str) -> list[list[str]]:
    return [list(keys[:n]) for n in range(len(keys), -1, -1)]


def _column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


class View:
    """One continuous view.

    keys: group columns by name. aggs: aggregates by name. outputs: results by name, expressions over keys and
    aggs; as default all of them. where: which rows count; prepare: the FROM clause, from a batch to the rows to
    be filtered (joins with tables see them as they are when the batch runs). Without aggs the view has the
    distinct keys (distinct) or all rows, one for each (append only).

    sliding_window: only groups within this time before as_of are read. Rows are counted in steps of time_column
    (step_factor percent of the window, a second at least), so they leave the window up to a step early. ttl:
    groups whose ttl_column is older than that go when expire() runs. grouping_sets: lists of keys; the state is
    also kept by grouping_id unless collapse, where a null key and a key left out are one group. limit and offset
    hold when the view is read, in the order of order_by; the state has all groups.
    """

    def __init__(
        self, name: str, keys: dict[str, Column | str] | None = None, aggs: dict[str, Agg] | None = None, outputs: dict[str, Column | str] | None = None,
        where: Column | str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, sliding_window=None, time_column: str = "arrival_timestamp", step_factor: float | None = None,
        ttl=None, ttl_column: str | None = None, grouping_sets: list[list[str]] | None = None, collapse: bool = False, distinct: bool = False, distinct_on: list[str] | None = None,
        order_by: list | None = None, limit: int | None = None, offset: int = 0, pk: str | None = None, store=None,
    ):
        self.name, self.keys, self.aggs = name, dict(keys or {}), dict(aggs or {})
        self.where, self.prepare, self.distinct, self.distinct_on = where, prepare, distinct or bool(distinct_on), distinct_on
        self.order_by, self.limit, self.offset, self.pk = order_by, limit, offset, pk
        self.store = store if store is not None else MemoryStore()
        self.grouping_sets, self.collapse = grouping_sets, collapse
        self.outputs = {n: c for n, c in outputs.items()} if outputs else {n: F.col(f"`{n}`") for n in [*self.keys, *([GROUPING] if grouping_sets and not collapse else []), *self.aggs]}
        self.window = self.step = self.ttl = None
        self.ttl_column = None
        if step_factor is not None and sliding_window is None:
            raise ValueError("step_factor needs a sliding window")
        if sliding_window is not None:
            if ttl is not None:
                raise ValueError("a sliding window and a ttl exclude each other")
            if distinct or distinct_on:
                raise ValueError("DISTINCT can't be used with a sliding window")
            self.window = interval_micros(sliding_window)
            if self.window < 1_000_000:
                raise ValueError("a sliding window is a second at least")
            factor = STEP_FACTOR if step_factor is None else step_factor
            if not 0 < factor <= 50:
                raise ValueError("step_factor lies above 0 and up to 50 percent")
            self.step = max(1_000_000, int(self.window * factor / 100))
        self.time_column = time_column
        self.set_ttl(ttl, ttl_column)
        if pk is not None and pk not in self.outputs:
            raise ValueError(f"primary key {pk!r} is not a column of the view")
        if taken := {BUCKET, ALL, "_batch", "_row", "$pk"} & {*self.keys, *self.aggs, *self.outputs}:
            raise ValueError(f"column name {min(taken)!r} is reserved")
        self._last: DataFrame | None = None  # the overlay at the last tick

    # the state's columns

    def set_ttl(self, ttl, ttl_column: str | None) -> None:
        if (ttl is None) != (ttl_column is None):
            raise ValueError("ttl and ttl_column go together")
        if ttl is not None and self.window is not None:
            raise ValueError("a view with a sliding window has no ttl of its own")
        micros = None if ttl is None else interval_micros(ttl)
        if micros is not None and micros < 1_000_000:
            raise ValueError("a ttl is a second at least")
        if ttl_column is not None and ttl_column not in {*self.keys, *self.aggs}:
            raise ValueError(f"ttl column {ttl_column!r} is not a column of the view")
        self.ttl, self.ttl_column = micros, ttl_column

    @property
    def rows_only(self) -> bool:
        """Whether the state is plain rows."""
        return not self.aggs and not self.distinct

    @property
    def groups(self) -> list[str]:
        """What a group is read by."""
        return [*self.keys, *([GROUPING] if self.grouping_sets and not self.collapse else [])] or [ALL]

    @property
    def state_keys(self) -> list[str]:
        return [*self.groups, *([BUCKET] if self.window else [])]

    # from rows to states

    def partial(self, batch: DataFrame, number: int = 0, as_of: dt.datetime | None = None) -> DataFrame:
        """The partial state of a batch."""
        df = self.prepare(batch) if self.prepare else batch
        if self.where is not None:
            df = df.where(self.where)
        if self.window and as_of is not None:
            df = df.where(_column(self.time_column).cast("timestamp_ntz") > F.lit(as_of - dt.timedelta(microseconds=self.window)).cast("timestamp_ntz"))
        if any(a.ordered for a in self.aggs.values()):
            df = df.withColumns({"_batch": F.lit(number).cast("long"), "_row": F.monotonically_increasing_id()})
        made = {f"_k{i}": _column(c) for i, c in enumerate(self.keys.values())}
        names = dict(zip(self.keys, made))
        if not self.keys and not self.rows_only:
            made["_k0"], names = F.lit(0), {ALL: "_k0"}
        if self.window:
            made["_kb"] = date_round(self.time_column, dt.timedelta(microseconds=self.step)) if not self.rows_only else _column(self.time_column)
            names[BUCKET] = "_kb"
        df = df.withColumns(made)
        if self.grouping_sets:
            every = list(self.keys)
            sets = [F.struct(*[(F.col(names[k]) if k in s else F.lit(None)).alias(names[k]) for k in every], F.lit(sum(1 << (len(every) - 1 - i) for i, k in enumerate(every) if k not in s)).cast("long").alias("_kg")) for s in self.grouping_sets]
            kinds = dict(df.select(*made).dtypes)
            kind = "array<struct<" + ",".join([f"{names[k]}:{kinds[names[k]]}" for k in every] + ["_kg:bigint"]) + ">>"
            df = df.withColumn("_set", F.explode(F.array(*sets).cast(kind)))
            df = df.withColumns({names[k]: F.col(f"_set.{names[k]}") for k in every})
            if not self.collapse:
                df, names = df.withColumn("_kg", F.col("_set._kg")), names | {GROUPING: "_kg"}
        if self.rows_only:
            return df.select(*[F.col(c).alias(n) for n, c in names.items()])
        columns = [names[k] for k in self.state_keys]
        out = partial_states(df, columns, self.aggs)
        return out.withColumnsRenamed({names[k]: k for k in self.state_keys})

    def merged(self, pieces: DataFrame) -> DataFrame:
        return pieces if self.rows_only else merge_states(pieces, self.state_keys, self.aggs)

    def state(self) -> DataFrame | None:
        """All groups' states (with a sliding window: of each step), or None before the first batch."""
        pieces = self.store.read()
        return None if pieces is None else self.merged(pieces)

    # from states to results

    def _in_window(self, state: DataFrame, as_of: dt.datetime | None, window: int | None = None) -> DataFrame:
        if not self.window:
            return state
        if as_of is None:
            raise ValueError("a sliding window is read as of a time")
        since = F.lit(as_of - dt.timedelta(microseconds=window or self.window)).cast("timestamp_ntz")
        return state.where(F.col(BUCKET).cast("timestamp_ntz") > since)

    def overlay(self, pieces: DataFrame, as_of: dt.datetime | None = None, window: int | None = None) -> DataFrame:
        """The groups of pieces of state with their results as a struct `out`."""
        df = self._in_window(pieces, as_of, window)
        if not self.rows_only:
            df = finish(merge_states(df, self.groups, self.aggs), self.groups, self.aggs)
        results = F.struct(*[_column(c).alias(n) for n, c in self.outputs.items()])
        return df.select(*([] if self.rows_only else self.groups), results.alias("out"))

    def read(self, as_of: dt.datetime | None = None, window=None) -> DataFrame | None:
        """The view's rows; window: a shorter one than the view's. None before the first batch."""
        pieces = self.store.read()
        if pieces is None:
            return None
        micros = None if window is None else interval_micros(window)
        if micros is not None and (not self.window or micros > self.window or micros < 2 * self.step):
            raise ValueError("a window over a view is two steps of the view's window at least and not longer than it")
        df = self.overlay(pieces, as_of, micros).select("out.*")
        if self.distinct_on:
            order = self.order_by or [c for c in self.outputs if c not in self.distinct_on] or self.distinct_on
            w = Window.partitionBy(*self.distinct_on).orderBy(*order)
            df = df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        elif self.order_by:
            df = df.orderBy(*self.order_by)
        if self.offset:
            df = df.offset(self.offset)
        return df if self.limit is None else df.limit(self.limit)

    def combine(self, columns: list[str] | dict[str, str], group_by: dict[str, Column | str] | list[str] | None = None, where=None, having=None, as_of: dt.datetime | None = None, pieces: DataFrame | None = None) -> DataFrame:
        """States merged over other groups and then finished. columns: aggregates of the view, or new names to them."""
        columns = columns if isinstance(columns, dict) else {c: c for c in columns}
        for c in columns.values():
            if c not in self.aggs:
                raise ValueError(f"{c!r} is not an aggregate of {self.name!r}")
            if not self.aggs[c].combinable:
                raise ValueError(f"{self.aggs[c].name} has no state that can be combined")
        df = self.store.read() if pieces is None else pieces
        if df is None:
            raise ValueError(f"{self.name!r} has no state yet")
        df = self._in_window(df, as_of)
        if where is not None:
            df = df.where(where)
        by = {g: g for g in group_by} if isinstance(group_by, list) else dict(group_by or {})
        keys = {f"_g{i}": _column(c) for i, c in enumerate(by.values())} or {"_g0": F.lit(0)}
        used = {c: self.aggs[c] for c in columns.values()}
        done = finish(merge_states(df.withColumns(keys), list(keys), used), list(keys), used)
        done = done.select(*[F.col(f"_g{i}").alias(n) for i, n in enumerate(by)], *[F.col(c).alias(n) for n, c in columns.items()])
        return done if having is None else done.where(having)

    # batches

    def ingest(self, batch: DataFrame, batch_id: str | None = None, as_of: dt.datetime | None = None, changes: bool = False) -> DataFrame | None:
        """Adds a batch; one whose id was added before changes nothing. Returns what changed, if asked (see `changed`).

        Whoever asks calls `settle` after reading the changes; else pieces of state are merged here when there are many.
        """
        if batch_id is not None and self.store.has(batch_id):
            return None
        number = self.store.next_batch()
        delta = self.partial(batch, number, as_of)
        before = self.store.read() if changes else None
        self.store.append(delta, batch_id)
        out = None
        if changes:
            out = self.changed(before, self.store.read() if isinstance(self.store, MemoryStore) else (delta if before is None else before.unionByName(delta)), delta)
        else:
            self.settle()
        return out

    def settle(self) -> None:
        """Merges the pieces of state if there are many."""
        if self.store.crowded():
            self.compact()

    def compact(self) -> None:
        state = self.state()
        if state is not None:
            self.store.replace(state)

    def merge_state(self, states: DataFrame, batch_id: str | None = None) -> None:
        """Adds partial states that another view of the same definition has made."""
        if batch_id is None or not self.store.has(batch_id):
            self.store.append(states, batch_id)

    def truncate(self) -> None:
        self.store.replace(None)

    def changed(self, before: DataFrame | None, after: DataFrame, delta: DataFrame) -> DataFrame:
        """Groups that differ: structs old and new (null if there is none) and, but for sliding windows, delta, the batch's state.

        Only groups of the batch are looked up.
        """
        if self.rows_only:
            new = self.overlay(delta).select("out")
            return new.select(F.when(F.lit(False), F.col("out")).alias("old"), F.col("out").alias("new"), F.struct(*[F.col(f"out.`{c}`").alias(c) for c in self.outputs]).alias("delta"))
        keys = self.groups
        touched = delta.select(*keys).distinct()
        same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
        pick = lambda df: df.join(touched, same(df, touched), "left_semi")
        new = self.overlay(pick(after)).withColumnRenamed("out", "new")
        state = delta.select(*keys, F.struct(*[F.col(f"`{c}`") for c in delta.columns]).alias("delta"))
        out = _attach(new, state, keys)
        if before is None:
            out = out.withColumn("old", F.when(F.lit(False), F.col("new")))
        else:
            out = _attach(out, self.overlay(pick(before)).withColumnRenamed("out", "old"), keys)
        return out.where(distinct_from(F.col("old"), F.col("new"))).select("old", "new", "delta")

    def tick(self, as_of: dt.datetime) -> DataFrame | None:
        """What a sliding window's passing changed since the last tick: structs old and new, null where a group came or went."""
        if not self.window:
            raise ValueError("only sliding windows tick")
        pieces = self.store.read()
        if pieces is None:
            return None
        now, last = self.store.snapshot(self.overlay(pieces, as_of)), self._last
        self._last = now
        keys = self.groups
        if last is None:
            return now.select(F.when(F.lit(False), F.col("out")).alias("old"), F.col("out").alias("new"))
        a = last.select(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], F.col("out").alias("old"))
        b = now.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.col("out").alias("new"))
        on = reduce(lambda x, y: x & y, [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))])
        return a.join(b, on, "full").where(distinct_from(F.col("old"), F.col("new"))).select("old", "new")

    def expire(self, now: dt.datetime) -> int:
        """Drops groups past their ttl, and steps that a sliding window has left; returns how many."""
        if self.window is None and self.ttl is None:
            raise ValueError(f"{self.name!r} has no ttl")
        state = self.state()
        if state is None:
            return 0
        column, span = (BUCKET, self.window) if self.window else (self.ttl_column, self.ttl)
        if column in self.aggs:
            column = self.aggs[column].columns(column)[0]
        old = F.coalesce(F.col(f"`{column}`").cast("timestamp_ntz") <= F.lit(now - dt.timedelta(microseconds=span)).cast("timestamp_ntz"), F.lit(False))
        gone = state.where(old).count()
        if gone:
            self.store.replace(state.where(~old))
        return gone


def _attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r{i}"]) for i, k in enumerate(keys)])
    return left.join(renamed, on, "left").drop(*[f"_r{i}" for i in range(len(keys))])
