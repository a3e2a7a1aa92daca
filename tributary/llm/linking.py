"""Connected components, and components of rows that share buckets, without ever gathering a bucket in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, hinted, shuffle_partitions

#: Nodes that a task holds at a time; further ones begin another forest.
FOREST_NODES = 500_000


def _stars(up: dict, kind: pa.DataType) -> pa.RecordBatch:
    tops = [_root(up, x) for x in up]
    return pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([None if t == x else t for x, t in zip(up, tops)], kind)], ["id", "up"])


def _root(up: dict, x):
    while up[x] != x:
        up[x] = x = up[up[x]]
    return x


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task to stars: each end once, with the smallest end that edges lead to (null for that end itself)."""
    up: dict = {}
    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            up.setdefault(x, x)
            up.setdefault(y, y)
            x, y = _root(up, x), _root(up, y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > FOREST_NODES:
            yield _stars(up, kind)
            up = {}
    if up:
        yield _stars(up, kind)


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Edges (a, b) to rows (id, comp): every end of an edge with the smallest id of its component.

    Tasks join their own edges to stars first. An id then has one row for each task at most, so that it can be
    grouped without skew: of its parents the least stays, the others are linked with that one, and parents that
    have parents themselves are skipped. This is repeated until every id has one parent, which has none.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def stars(df: DataFrame) -> DataFrame:
        return df.mapInArrow(_forest, f"id {kind}, up {kind}")

    step = stars(edges.select("a", "b"))
    while True:
        by_id = step.groupBy("id").agg(F.collect_set("up").alias("ups"), F.max(F.col("up").isNull()).alias("top"))
        least = by_id.select("id", F.array_min("ups").alias("up"), "ups", "top")
        now = ws.keep(least.select("id", "up", F.filter("ups", lambda x: x > F.col("up")).alias("more"), "top"), "stars")
        middle = now.where("top and up is not null").select(F.col("id").alias("up"), F.col("up").alias("next"))
        if now.where("size(more) > 0 or (top and up is not null)").isEmpty():
            return now.select("id", F.coalesce("up", "id").alias("comp"))
        below = now.where("up is not null")
        short = below.select("id", "up").join(hinted(middle), "up", "left").select(F.col("id").alias("a"), F.coalesce("next", "up").alias("b"))
        extra = below.select(F.explode("more").alias("a"), F.col("up").alias("b"))
        step = stars(short.unionByName(extra))


#: Rounds in which every id is tried against one hub.
ROUNDS = 2
#: Members of a bucket that meet each other in one group, and pairs that are compared at a time.
BLOCK, PAIRS = 2048, 1 << 18

#: Of rows l and r (numbers), with a way to get a column, those positions that may be linked.
Alike = Callable[[Callable[[str], np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def distinct_buckets(ws: Workspace, members: DataFrame, bucket: list[str], apart: list[str] = (), marks: list[str] = ()) -> DataFrame:
    """Of the buckets with the same members, more than one of them, the first only: rows of `bucket` and n, its number of members.

    members has each id once a bucket. marks: flags of a member, one of which must be set in a bucket. Only buckets
    that agree in the columns `apart` stand for each other. Sets of members are the same if their numbers, least
    and largest ids and checksums over ids and marks agree. A small group has most of its buckets in common, so
    that few of them are left.
    """
    about = [F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id", *marks)).alias("x"), *[F.max(c).alias(c) for c in marks]]
    sizes = members.groupBy(*bucket).agg(*about).where("n > 1")
    for c in marks:
        sizes = sizes.where(c)
    first = sizes.groupBy("n", "lo", "hi", "x", *apart).agg(F.min(F.struct(*bucket)).alias("b"))
    return ws.keep(first.select("b.*", "n"), "buckets")


def _pairs(batches: Iterator[pa.RecordBatch], names: list[str], alike: Alike) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of the groups (bucket, lo, hi) of sorted rows: of one block with itself, or of two blocks."""
    held = None
    for b in batches:
        if b.num_rows:
            held = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
            key = [held.column(c).to_numpy() for c in ("bucket", "lo", "hi")]
            last = int(np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))[-1]) + 1 if held.num_rows > 1 and any((k != k[-1]).any() for k in key) else 0
            if last:
                yield from _group_pairs(held.slice(0, last), names, alike)
                held = held.slice(last)
    if held is not None:
        yield from _group_pairs(held, names, alike)


def _group_pairs(rows: pa.Table, names: list[str], alike: Alike) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    column = {c: rows.column(c).to_numpy() for c in ("bucket", "lo", "hi", "block", "base", *names)}
    bucket, lo, hi, block, base = (column[c] for c in ("bucket", "lo", "hi", "block", "base"))
    n = len(bucket)
    comp = rows.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
    new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
    size = np.diff(np.append(new, n))
    end = np.repeat(new + size, size)
    other = (block != lo).astype(np.int64)
    first_other = np.repeat(new + size - np.add.reduceat(other, new), size)  # rows of block hi come after those of lo
    begin = np.where(lo == hi, np.arange(n) + 1, np.where(other == 1, end, first_other))
    count = end - begin
    upto = np.concatenate([[0], np.cumsum(count)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS, "right")) - 1)
        c = count[i:j]
        left = np.repeat(np.arange(i, j), c)
        right = np.repeat(begin[i:j] - (upto[i:j] - upto[i]), c) + np.arange(len(left))
        ok = (comp[left] != comp[right]) & (base[left] | base[right])
        left, right = left[ok], right[ok]
        ok = alike(column.__getitem__, left, right)
        if len(ok):
            ids = rows.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(left[ok])), ids.take(pa.array(right[ok]))], ["a", "b"])
        i = j


def link_by_buckets(ws: Workspace, members: DataFrame, verify: Callable[[DataFrame], DataFrame], payload: DataFrame, alike: Alike, rounds: int = ROUNDS, meetings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Components of the ids that share a bucket and pass `verify`.

    members: (bucket, id, base, n, more...), each (bucket, id) once, n the bucket's number of members, written already.
    Two ids of a bucket are a candidate pair if one of them is marked base. verify: pairs (a, b) to those that are
    linked. payload: one row for each id, of numbers. alike: a test that a linked pair passes in one of its buckets at
    least, on whole columns of members with their payload. meetings: coarser and fewer buckets (bucket, id, base, n) of
    the same ids, in which the rounds look for hubs; as default the members.

    In each round every bucket names one base id its hub (at first one that shares most buckets with others) and
    every id is tried against the hub that it meets in most buckets, one pair for each id. So large groups
    become a component without their pairs being listed. Pairs that links already join need no test; all other
    pairs of a bucket, those between two components, are compared by `alike`, large buckets in pairs of blocks,
    and tested in full if they pass, so no link is lost. Returns (id, comp) of linked ids and the tested links (a, b).
    """
    slim = (members if meetings is None else meetings).select("bucket", "id", "base", "n")
    comp = links = None
    for r in range(rounds):
        if comp is None:
            weight = slim.where("base").groupBy("id").agg(F.sum("n").alias("weight"))
            named = slim.select("bucket", "id", "base", F.col("id").alias("comp"))
            hubs = slim.where("base").join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", "id", F.col("id").alias("comp"))).alias("hub"))
        else:
            # only buckets with more than one component hold pairs that are still open
            named = slim.join(comp, "id", "left").select("bucket", "id", "base", F.coalesce("comp", "id").alias("comp"))
            order = F.struct(F.xxhash64(F.lit(r), "id").alias("weight"), "id", "comp")
            hubs = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("base"), order)).alias("hub")).where("lo < hi").select("bucket", "hub")
        met = named.join(hubs, "bucket").where(F.col("comp") != F.col("hub.comp")).groupBy("id", F.col("hub.id").alias("hub")).agg(F.count("*").alias("c"))
        best = met.groupBy("id").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
        found = ws.keep(verify(best.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()), "links")
        links = found if links is None else links.unionByName(found)
        comp = connected_components(ws, found if comp is None else _with(comp, found))
    named = members.select("bucket", "id").join(comp, "id", "left").select("bucket", F.coalesce("comp", "id").alias("comp"), "id")
    open_ = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("lo < hi").select("bucket", "blocks")
    about = payload.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    rest = members.drop("n").join(open_, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    with_ = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    rest = rest.select("*", with_).withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")}).drop("with", "blocks").join(about, "id")
    kind, names = members.schema["id"].dataType.simpleString(), [c for c in rest.columns if c not in ("bucket", "lo", "hi", "block", "id", "comp", "base")]
    grouped = rest.repartition(shuffle_partitions(ws.spark), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", F.col("block") != F.col("lo"))
    pairs = grouped.mapInArrow(lambda b: _pairs(b, names, alike), f"a {kind}, b {kind}")
    cross = ws.keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cross")
    more = ws.keep(verify(cross), "links")
    if not more.isEmpty():
        comp = connected_components(ws, _with(comp, more))
    return comp, links.unionByName(more)


def _with(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of components and further links."""
    stars = comp.where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b"))
    return stars.unionByName(links.select("a", "b"))
