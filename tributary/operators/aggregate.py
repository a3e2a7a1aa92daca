"""Mergeable aggregates: partial states of a batch, merging of states, and finishing.

An `Agg` has state columns, each with an expression that makes it from rows and one that merges it; a final
expression turns the state into the result. A `FrameAgg` makes and merges its one state column by a query of
its own, grouped by the keys and a cell first, so that no key's rows meet unreduced; it is joined by the keys.
Both work on any split of the rows into batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keep = Callable[[Column], Column]
#: Columns that tell when a row came: the batch and the row within it.
ORDINAL = ("_batch", "_row")


@dataclass(frozen=True)
class Part:
    suffix: str
    make: Callable[[Keep], Column]
    merge: Callable[[Column], Column]


@dataclass(frozen=True)
class Agg:
    """name: as in SQL. final: of the parts' columns, in order."""

    name: str
    parts: tuple[Part, ...] = ()
    final: Callable[..., Column] = lambda c: c
    condition: Column | None = None
    #: Whether make() looks at ORDINAL.
    ordered: bool = False
    #: Made from the columns that `combine` names; None means that states cannot be combined by users.
    combinable: bool = True
    #: What the states are made of. Aggregates of one view where it is equal share a state, since sketches that are
    #: merged at random would else differ; None is equal to none.
    same: tuple | None = None

    def where(self, condition: Column | str) -> Agg:
        """The aggregate over rows that meet the condition only."""
        c = F.expr(condition) if isinstance(condition, str) else condition
        return replace(self, condition=c if self.condition is None else self.condition & c)

    def columns(self, alias: str) -> list[str]:
        return [f"{alias}__{p.suffix}" for p in self.parts]

    def keep(self, c: Column) -> Column:
        return c if self.condition is None else F.when(self.condition, c)

    def partial(self, alias: str) -> list[Column]:
        return [p.make(self.keep).alias(n) for p, n in zip(self.parts, self.columns(alias))]

    def merged(self, alias: str) -> list[Column]:
        return [p.merge(F.col(n)).alias(n) for p, n in zip(self.parts, self.columns(alias))]

    def finished(self, alias: str) -> Column:
        return self.final(*[F.col(n) for n in self.columns(alias)])

    def of_states(self, alias: str, struct: str) -> Agg:
        """The aggregate of rows that have states of this one, named alias, in a struct column."""
        if not self.combinable:
            raise ValueError(f"{self.name} has no state that can be combined")
        make = lambda p, n: (lambda keep: p.merge(keep(F.col(struct)[n])))
        return replace(self, parts=tuple(Part(p.suffix, make(p, n), p.merge) for p, n in zip(self.parts, self.columns(alias))), condition=None, ordered=False, same=None)


@dataclass(frozen=True)
class FrameAgg(Agg):
    """State in one column, an array that queries of its own make and merge."""

    def columns(self, alias: str) -> list[str]:
        return [f"{alias}__cells"]

    def rows(self, df: DataFrame) -> DataFrame:
        return df if self.condition is None else df.where(self.condition)

    def partial_frame(self, df: DataFrame, keys: list[str], out: str) -> DataFrame:
        raise NotImplementedError

    def merge_frame(self, df: DataFrame, keys: list[str], out: str) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class CellAgg(FrameAgg):
    """State: an array of (k: cell, v: its value). cells: an array of (k, v) for each row. fold: of the v of one cell."""

    cells: Column | None = None
    fold: Callable[[Column], Column] = F.sum
    refold: Callable[[Column], Column] | None = None

    def of_states(self, alias: str, struct: str) -> Agg:
        return replace(self, cells=F.col(struct)[self.columns(alias)[0]], fold=self.refold or self.fold, condition=None, ordered=False)

    def _gather(self, rows: DataFrame, fold: Callable[[Column], Column], keys: list[str], out: str) -> DataFrame:
        per = rows.groupBy(*keys, F.col("_e.k").alias("_k")).agg(fold(F.col("_e.v")).alias("_v"))
        return per.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_k").alias("k"), F.col("_v").alias("v"))).alias(out))

    def partial_frame(self, df: DataFrame, keys: list[str], out: str) -> DataFrame:
        return self._gather(self.rows(df).select(*keys, F.explode(self.cells).alias("_e")), self.fold, keys, out)

    def merge_frame(self, df: DataFrame, keys: list[str], out: str) -> DataFrame:
        return self._gather(df.select(*keys, F.explode(out).alias("_e")), self.refold or self.fold, keys, out)


@dataclass(frozen=True)
class FirstAgg(FrameAgg):
    """State: an array of the n first structs by ascending order. struct_of: of a row. Partial limits come before the shuffle."""

    n: int = 1
    struct_of: Column | None = None

    def of_states(self, alias: str, struct: str) -> Agg:
        raise ValueError(f"states of {self.name} can't be combined from changes")

    def _gather(self, rows: DataFrame, keys: list[str], out: str) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy(*keys).orderBy("_e")
        first = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= self.n)
        return first.groupBy(*keys).agg(F.array_sort(F.collect_list("_e")).alias(out))

    def partial_frame(self, df: DataFrame, keys: list[str], out: str) -> DataFrame:
        return self._gather(self.rows(df).select(*keys, self.struct_of.alias("_e")), keys, out)

    def merge_frame(self, df: DataFrame, keys: list[str], out: str) -> DataFrame:
        return self._gather(df.select(*keys, F.explode(out).alias("_e")), keys, out)


def _joined(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """base with extra's columns where all keys are equal, nulls being equal."""
    renamed = extra.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], *[c for c in extra.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [base[k].eqNullSafe(renamed[f"_j{i}"]) for i, k in enumerate(keys)])
    return base.join(renamed, on, "left").drop(*[f"_j{i}" for i in range(len(keys))])


def _alike(aggs: dict[str, Agg]) -> dict[str, str]:
    """Each aggregate's name to that of the first with the same states, which is its own if there is none."""
    first: dict[tuple, str] = {}
    return {a: a if agg.same is None or agg.condition is not None else first.setdefault(agg.same, a) for a, agg in aggs.items()}


def _state_columns(aggs: dict[str, Agg]) -> list[Column]:
    alike = _alike(aggs)
    return [F.col(made).alias(c) for a, agg in aggs.items() for made, c in zip(agg.columns(alike[a]), agg.columns(a))]


def partial_states(df: DataFrame, keys: list[str], aggs: dict[str, Agg]) -> DataFrame:
    """One row for each group of df: its keys and the states of all aggregates."""
    alike = _alike(aggs)
    plain = [c for a, agg in aggs.items() if not isinstance(agg, FrameAgg) and alike[a] == a for c in agg.partial(a)]
    frames = {a: agg for a, agg in aggs.items() if isinstance(agg, FrameAgg)}
    out = df.groupBy(*keys).agg(*plain) if plain else df.select(*keys).distinct()
    for a, agg in frames.items():
        out = _joined(out, agg.partial_frame(df, keys, agg.columns(a)[0]), keys)
    return out.select(*keys, *_state_columns(aggs))


def merge_states(states: DataFrame, keys: list[str], aggs: dict[str, Agg]) -> DataFrame:
    """States of the same groups made one."""
    alike = _alike(aggs)
    plain = [c for a, agg in aggs.items() if not isinstance(agg, FrameAgg) and alike[a] == a for c in agg.merged(a)]
    frames = {a: agg for a, agg in aggs.items() if isinstance(agg, FrameAgg)}
    out = states.groupBy(*keys).agg(*plain) if plain else states.select(*keys).distinct()
    for a, agg in frames.items():
        out = _joined(out, agg.merge_frame(states, keys, agg.columns(a)[0]), keys)
    return out.select(*keys, *_state_columns(aggs))


def finish(states: DataFrame, keys: list[str], aggs: dict[str, Agg]) -> DataFrame:
    """Keys and results."""
    return states.select(*keys, *[agg.finished(a).alias(a) for a, agg in aggs.items()])
