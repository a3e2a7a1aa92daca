"""Exact top-k by inner product: a Voronoi join.

Vectors go to the cell of their nearest pivot. A cell's summary has its number of vectors, its radius and the
vectors closest to the pivot. From the summaries each query gets a score that its k-th best reaches at least,
and an upper bound of any score in a cell (q.p + |q| radius); it goes only to cells whose bound reaches that
score. Large cells are dealt in blocks, and blocks of queries meet blocks of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, hinted

#: Vectors that meet in one group, and pivots: the fewest and the most.
BLOCK, FEWEST, MOST = 4096, 64, 4096


def _matrix(column: pa.Array | pa.ChunkedArray | list, dim: int) -> np.ndarray:
    """Rows of whole numbers as float64, filled up with zeros. Numbers whose scores could pass 2**53 are refused."""
    if isinstance(column, list):
        column = pa.array(column, pa.list_(pa.int64()))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dim))
    if len(column):
        size = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy()
        row = np.repeat(np.arange(len(column)), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        if len(flat) and dim * float(np.abs(flat).max()) ** 2 >= 2**53:
            raise OverflowError("components are too large for exact scores")
    return out


def _quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, column = b.column("id"), b.column("v")
            ok = pc.and_(ids.is_valid(), column.is_valid())
            ids, column = ids.filter(ok), column.filter(ok)
            size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
            flat = column.flatten().cast(pa.float64())
            x = np.floor(scale * pc.fill_null(flat, np.nan).to_numpy()) if len(flat) else np.zeros(0)
            bad = np.bincount(np.repeat(np.arange(len(size)), size), ~np.isfinite(x), len(size)) > 0 if len(size) else np.zeros(0, bool)
            x = x[~np.repeat(bad, size)]
            if len(x) and np.abs(x).max() >= 2**53:
                raise OverflowError("components are too large for exact scores")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[~bad])]), pa.int32()), pa.array(x.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(~bad)), lists], ["id", "v"])

    return run


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1), 0))


def top_k_inner(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, pivots: int | None = None, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query its k best other vectors by the integer inner product of floor(scale * component).

    Returns query_id, rank (from 1), id, score; equal scores go to the smaller id; fewer than k candidates give
    all. queries: rows of the same columns. Vectors that are null, hold null or a non-finite component, or have
    no id take no part. Shorter vectors count as if filled up with zeros. Rows that repeat an id are candidates
    of their own, but not of a query of that id. Other columns are ignored; empty tables give no rows.

    The driver holds the pivots and, for each cell, k + 1 vectors. A query's scores are exact, so pruning never
    drops a result; vectors that no bound prunes cost a comparison with every query, as in any exact search.
    Queries are grouped by their own nearest pivot too, and a cell's vectors go only to those groups that have a query
    whose bound reaches into the cell. pivots: as default a quarter of the root of the number of vectors.
    """
    ws = Workspace(vectors.sparkSession, "knn")

    def read(df: DataFrame) -> DataFrame:
        return df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("v")).mapInArrow(_quantise(scale), "id long, v array<bigint>")

    names = f"query_id long, rank int, {id_col} long, score long"
    data = ws.keep(read(vectors), "vectors")
    asked = ws.keep(read(queries), "queries")
    dim = data.agg(F.max(F.size("v"))).first()[0]
    most = asked.agg(F.max(F.size("v")), F.count("*")).first()
    if not dim or not most[1]:
        return vectors.sparkSession.createDataFrame([], names)
    dim = max(dim, most[0] or 0)
    pivots = pivots or int(min(MOST, max(FEWEST, data.count() ** 0.5 / 4)))
    p = _matrix([r["v"] for r in data.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()], dim)
    p = np.unique(p, axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_matrix(b.column("v"), dim), p) if b.num_rows else np.zeros((0, len(p)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1, initial=np.inf), pa.float64())], ["id", "v", "cell", "d"])

    cells = ws.keep(data.mapInArrow(assign, "id long, v array<bigint>, cell int, d double"), "cells")
    size = {r["cell"]: (r["n"], r["r"]) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect()}
    near = Window.partitionBy("cell").orderBy("d", "id")
    heart = cells.select("cell", "id", "d", "v").withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).select("id", "v").collect()
    heart_ids, heart_v = np.array([r["id"] for r in heart]), _matrix([r["v"] for r in heart], dim)
    numbers = np.array(sorted(size))
    radius = np.array([size[c][1] for c in numbers])
    parts = np.array([-(-size[c][0] // block) for c in numbers])
    # queries in groups by their own cell, large groups in blocks
    asked = ws.keep(asked.mapInArrow(assign, "id long, v array<bigint>, cell int, d double").withColumnRenamed("cell", "own"), "asked")
    blocks = {r["own"]: -(-r["n"] // block) for r in asked.groupBy("own").agg(F.count("*").alias("n")).collect()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("v"), dim)
            known = q @ heart_v.T
            known[b.column("id").to_numpy()[:, None] == heart_ids] = -np.inf
            floor_ = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(q), -np.inf)
            bound = q @ p[numbers].T + np.sqrt((q * q).sum(1))[:, None] * radius
            bound += 1e-6 * np.abs(bound) + 1
            row, cell = np.nonzero(bound >= floor_[:, None])
            each = parts[cell]
            row, cell = np.repeat(row, each), np.repeat(cell, each)
            part = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("v").take(take), b.column("own").take(take), pa.array(numbers[cell], pa.int32()), pa.array(part, pa.int32())], ["id", "v", "own", "cell", "part"])

    of = lambda found, c: F.element_at(F.create_map(*[F.lit(int(x)) for pair in found for x in pair]), F.col(c))
    ask = F.col("own").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit(1)), of(blocks.items(), "own"))
    sent = ws.keep(asked.mapInArrow(route, "id long, v array<bigint>, own int, cell int, part int").withColumn("ask", ask).drop("own"), "sent")
    pairs = ws.keep(sent.select("cell", "ask").distinct(), "pairs")
    held = cells.select("id", "v", "cell", F.pmod(F.xxhash64("id", F.lit(2)), of(zip(numbers, parts), "cell")).cast("int").alias("part")).join(hinted(pairs), "cell")

    def solve(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")
        rows = rows.sort_values("id", kind="stable")
        ids, x = rows["id"].to_numpy(), _matrix(rows["v"].tolist(), dim)
        out = []
        for i in range(0, len(queries), 256):
            part = queries.iloc[i : i + 256]
            score = _matrix(part["v"].tolist(), dim) @ x.T
            score[part["id"].to_numpy()[:, None] == ids] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids ascend, so ties do
            for q, s, b in zip(part["id"].tolist(), score, best):
                out += [(q, int(ids[j]), int(s[j])) for j in b if np.isfinite(s[j])]
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")

    by = ["cell", "part", "ask"]
    local = sent.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(solve, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
