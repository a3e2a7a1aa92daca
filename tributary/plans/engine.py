"""The engine: streams, continuous views, transforms, and what flows between them."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.streams import ARRIVAL, Stream, read_copy
from ..sources.stores import MemoryStore, TableStore
from .view import View

MOST_QUERIES = 1024


class QueryFailed(RuntimeError):
    """Readers of a batch that failed, with their errors; all others have it."""


@dataclass
class Transform:
    """Rows of a stream, changed and passed on: to another stream, to a function of a DataFrame, or only to readers of its output."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    into: str | None = None
    output: Callable[[DataFrame], None] | None = None


@dataclass
class Query:
    """A view or transform with its source and counters."""

    item: View | Transform
    source: str
    text: str = ""
    active: bool = True
    stats: Counter = field(default_factory=Counter)
    error: str | None = None

    @property
    def kind(self) -> str:
        return "view" if isinstance(self.item, View) else "transform"


class Engine:
    """Everything by name. root: a folder for states that outlive the session; without it they are plans in memory.

    clock: the time that windows and arrival are judged by, unless a call says another. count_rows: counts each
    batch's rows for the statistics, which reads the batch once more.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, clock: Callable[[], dt.datetime] | None = None, count_rows: bool = False, step_factor: float = 5, enabled: bool = True, targets: list[str] | None = None):
        self.spark, self.root, self.count_rows = spark, root, count_rows
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))
        self.step_factor, self.enabled, self.targets = step_factor, enabled, targets
        self.streams: dict[str, Stream] = {}
        self.queries: dict[str, Query] = {}
        self.stream_stats: dict[str, Counter] = {}

    # definitions

    def _free(self, name: str) -> None:
        if name in self.streams or name in self.queries:
            raise ValueError(f"{name!r} exists already")

    def _add(self, name: str, query: Query) -> None:
        self._free(name)
        if len(self.queries) >= MOST_QUERIES:
            raise ValueError(f"there are {MOST_QUERIES} continuous queries already")
        self._stream_of(query.source)
        self.queries[name] = query

    def _stream_of(self, source: str) -> None:
        if source not in self.streams and not (source in self.queries):
            raise ValueError(f"there is no stream {source!r}")

    def create_stream(self, name: str, ddl) -> Stream:
        self._free(name)
        self.streams[name] = Stream.of(name, ddl)
        self.stream_stats[name] = Counter()
        return self.streams[name]

    def create_view(self, name: str, source: str, text: str = "", **options) -> View:
        """A continuous view over a stream, or over the output of another query. options: those of View."""
        self._free(name)
        if "store" not in options:
            options["store"] = TableStore(self.spark, f"{self.root}/{name}") if self.root else MemoryStore()
        if options.get("sliding_window") is not None and options.get("step_factor") is None:
            options["step_factor"] = self.step_factor
        view = View(name, **options)
        self._add(name, Query(view, source, text))
        return view

    def create_transform(self, name: str, source: str, apply: Callable[[DataFrame], DataFrame], into: str | None = None, output: Callable[[DataFrame], None] | None = None, text: str = "") -> Transform:
        if into is not None and into not in self.streams:
            raise ValueError(f"there is no stream {into!r}")
        item = Transform(name, apply, into, output)
        self._add(name, Query(item, source, text))
        return item

    def output_of(self, name: str) -> str:
        """The name under which queries read the changes of a view or the rows of a transform."""
        self._query(name)
        return name

    def _query(self, name: str) -> Query:
        if name not in self.queries:
            raise ValueError(f"there is no continuous query {name!r}")
        return self.queries[name]

    def view(self, name: str) -> View:
        item = self._query(name).item
        if not isinstance(item, View):
            raise ValueError(f"{name!r} is not a continuous view")
        return item

    def readers(self, source: str) -> list[str]:
        return [n for n, q in self.queries.items() if q.source == source]

    def drop(self, name: str, cascade: bool = False) -> None:
        """Drops a stream, view or transform; with cascade its readers too."""
        if name not in self.streams and name not in self.queries:
            raise ValueError(f"there is no {name!r}")
        if (readers := self.readers(name)) and not cascade:
            raise ValueError(f"{readers[0]!r} reads {name!r}")
        for r in readers:
            if r in self.queries:
                self.drop(r, True)
        if name in self.streams:
            into = [n for n, q in self.queries.items() if isinstance(q.item, Transform) and q.item.into == name]
            if into and not cascade:
                raise ValueError(f"{into[0]!r} writes to {name!r}")
            for n in into:
                self.drop(n, True)
            del self.streams[name], self.stream_stats[name]
        else:
            item = self.queries.pop(name).item
            if isinstance(item, View):
                item.truncate()

    def rename(self, old: str, new: str) -> None:
        self._free(new)
        if old in self.streams:
            self.streams[new] = self.streams.pop(old)
            self.streams[new].name = new
            self.stream_stats[new] = self.stream_stats.pop(old)
        else:
            self._query(old)
            self.queries = {new if n == old else n: q for n, q in self.queries.items()}
            self.queries[new].item.name = new
        for q in self.queries.values():
            q.source = new if q.source == old else q.source
            if isinstance(q.item, Transform) and q.item.into == old:
                q.item.into = new

    def activate(self, name: str) -> bool:
        """Whether this changed anything."""
        return self._switch(name, True)

    def deactivate(self, name: str) -> bool:
        return self._switch(name, False)

    def _switch(self, name: str, active: bool) -> bool:
        q = self._query(name)
        changed, q.active = q.active != active, active
        return changed

    # rows

    def insert(self, stream: str, df: DataFrame, columns: list[str] | None = None, targets: list[str] | None = None, batch_id: str | None = None, as_of: dt.datetime | None = None, strict: bool = False) -> None:
        """Writes a batch to a stream: each of its readers takes it, and what they put out goes on to theirs.

        targets: only these readers. batch_id: readers that have added this batch already leave it. A reader
        that fails is skipped and its error kept; the others go on. strict: once all have run, QueryFailed is raised
        if any has failed, so that the writer can try the batch again.
        """
        if stream not in self.streams:
            raise ValueError(f"there is no stream {stream!r}")
        targets = self.targets if targets is None else targets
        for t in targets or []:
            self._query(t)
        if not self.enabled:
            return
        now = self.clock() if as_of is None else as_of
        rows = self.streams[stream].coerce(df, columns, F.lit(now))
        stats = self.stream_stats[stream]
        stats["input_batches"] += 1
        if self.count_rows:
            stats["input_rows"] += rows.count()
        before = {n: q.stats["errors"] for n, q in self.queries.items()}
        self._feed(stream, rows, targets, batch_id, now)
        failed = [f"{n}: {q.error}" for n, q in self.queries.items() if q.stats["errors"] > before.get(n, 0)]
        if strict and failed:
            raise QueryFailed("; ".join(failed))

    def copy(self, stream: str, path: str | list[str], format: str = "text", columns: list[str] | None = None, targets: list[str] | None = None, batch_id: str | None = None, as_of: dt.datetime | None = None, **options) -> None:
        """Writes delimited files to a stream; options as in COPY."""
        if stream not in self.streams:
            raise ValueError(f"there is no stream {stream!r}")
        self.insert(stream, read_copy(self.spark, self.streams[stream], path, format, columns, **options), targets=targets, batch_id=batch_id, as_of=as_of)

    def _feed(self, source: str, rows: DataFrame, targets: list[str] | None, batch_id: str | None, now: dt.datetime) -> None:
        for name in self.readers(source):
            q = self.queries.get(name)
            if q is None or not q.active or (targets is not None and name not in targets):
                continue
            try:
                self._run(name, q, rows, batch_id, now)
                q.stats["batches"] += 1
                if self.count_rows:
                    q.stats["input_rows"] += rows.count()
            except Exception as e:  # one query's failure must not stop the others
                q.stats["errors"] += 1
                q.error = str(e)

    def _run(self, name: str, q: Query, rows: DataFrame, batch_id: str | None, now: dt.datetime) -> None:
        onward = self.readers(name)
        if isinstance(q.item, View):
            # what a sliding window shows changes with time, so its readers hear of it at ticks only
            change = q.item.ingest(rows, batch_id, now if q.item.window else None, changes=bool(onward) and not q.item.window)
            out = None if change is None else change.withColumn(ARRIVAL, F.lit(now).cast("timestamp"))
        else:
            if not onward and q.item.into is None and q.item.output is None:
                return
            out = q.item.apply(rows)
            if q.item.output is not None:
                q.item.output(out)
            if q.item.into is not None:
                self.insert(q.item.into, out, batch_id=None if batch_id is None else f"{name}/{batch_id}", as_of=now, targets=None)
            if ARRIVAL not in out.columns:
                out = out.withColumn(ARRIVAL, F.lit(now).cast("timestamp"))
        if onward and out is not None:
            self._feed(name, out, None, None if batch_id is None else f"{name}/{batch_id}", now)
        if isinstance(q.item, View):
            q.item.settle()  # readers have the changes by now, which are made from the pieces

    def tick(self, as_of: dt.datetime | None = None) -> None:
        """Lets time pass: changes of sliding windows go to the readers of their output."""
        now = self.clock() if as_of is None else as_of
        for name, q in list(self.queries.items()):
            if isinstance(q.item, View) and q.item.window and q.active:
                change = q.item.tick(now)
                if change is not None and self.readers(name):
                    self._feed(name, change.withColumn(ARRIVAL, F.lit(now).cast("timestamp")), None, None, now)

    # reading

    def read(self, name: str, as_of: dt.datetime | None = None, window=None) -> DataFrame:
        view = self.view(name)
        out = view.read((as_of or self.clock()) if view.window else None, window)
        if out is None:
            raise ValueError(f"no rows have reached {name!r} yet")
        return out

    def combine(self, name: str, columns, group_by=None, where=None, having=None, as_of: dt.datetime | None = None, pieces: DataFrame | None = None) -> DataFrame:
        """pieces: the view's states with further columns, such as those of a table that they are joined with."""
        view = self.view(name)
        return view.combine(columns, group_by, where, having, (as_of or self.clock()) if view.window else None, pieces)

    def combine_table(self, name: str, states: DataFrame) -> None:
        """Adds a table of partial states, of the columns of the view's own state."""
        view = self.view(name)
        own = view.store.read()
        if own is not None and (missing := [c for c in own.columns if c not in states.columns]):
            raise ValueError(f"the table lacks column {missing[0]!r}")
        view.merge_state(states if own is None else states.select(*[F.col(f"`{c}`") for c in own.columns]))

    def truncate(self, name: str) -> None:
        self.view(name).truncate()

    def set_ttl(self, name: str, ttl, column: str | None) -> None:
        self.view(name).set_ttl(ttl, column)

    def ttl_expire(self, name: str, now: dt.datetime | None = None) -> int:
        return self.view(name).expire(now or self.clock())

    def flush(self) -> None:
        """Merges each view's pieces of state; batches themselves are added at once."""
        for q in self.queries.values():
            if isinstance(q.item, View):
                q.item.compact()

    # the catalogue as tables

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def get_streams(self) -> DataFrame:
        return self._table([(n, s.schema(), self.readers(n)) for n, s in self.streams.items()], "name string, columns string, queries array<string>")

    def get_views(self) -> DataFrame:
        return self._table([(n, q.source, q.active, q.text) for n, q in self.queries.items() if q.kind == "view"], "name string, source string, active boolean, query string")

    def get_transforms(self) -> DataFrame:
        rows = [(n, q.source, q.active, q.item.into, getattr(q.item.output, "__name__", None), q.text) for n, q in self.queries.items() if q.kind == "transform"]
        return self._table(rows, "name string, source string, active boolean, into string, output string, query string")

    def get_stream_readers(self) -> DataFrame:
        return self._table([(q.source, n, q.kind) for n, q in self.queries.items()], "stream string, reader string, kind string")

    def query_stats(self) -> DataFrame:
        rows = [(n, q.kind, q.stats["batches"], q.stats["input_rows"], q.stats["errors"], q.error) for n, q in self.queries.items()]
        return self._table(rows, "name string, kind string, batches long, input_rows long, errors long, last_error string")

    def get_stream_stats(self) -> DataFrame:
        return self._table([(n, s["input_batches"], s["input_rows"]) for n, s in self.stream_stats.items()], "name string, input_batches long, input_rows long")

    def db_stats(self) -> DataFrame:
        """Sums of query_stats by kind."""
        return self.query_stats().groupBy("kind").agg(F.sum("batches").alias("batches"), F.sum("input_rows").alias("input_rows"), F.sum("errors").alias("errors"))

    def worker_query(self, name: str) -> str:
        """The plan that makes a view's partial states from rows of its stream."""
        view, source = self.view(name), self.queries[name].source
        if source not in self.streams:
            raise ValueError(f"{name!r} does not read a stream")
        empty = self.spark.createDataFrame([], self.streams[source].schema())
        return view.partial(empty, as_of=None)._jdf.queryExecution().optimizedPlan().toString()

    def combiner_query(self, name: str) -> str:
        """The plan that merges a view's pieces of state."""
        state = self.view(name).state()
        if state is None:
            raise ValueError(f"no rows have reached {name!r} yet")
        return state._jdf.queryExecution().optimizedPlan().toString()

    def version(self) -> str:
        return "0.1.0"
