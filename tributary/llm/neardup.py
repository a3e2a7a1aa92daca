"""MinHash near-duplicate detection with tensored banding.

Each document has two small collections of M half keys, each of R min-hashes. A table key is a pair of one half
key from either collection: M * M tables of 2 R rows come from 2 M R min-hashes. A pair of documents of
similarity s meets with probability (1 - (1 - s^R)^M)^2, 0.9999 at 0.8. Candidates are compared on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Workspace, conflicting_ids, hinted, list_array, longs, mix, parities, raw, shingles, slices
from .linking import distinct_buckets, link_by_buckets

M, R = 14, 3
LANES = 7
BITS = 512
_ODD = mix(np.arange(1, 2 * M * R + 1, dtype=U)) | U(1)
_ADD = mix(np.arange(1000, 1000 + 2 * M * R, dtype=U))
_POW = mix(np.arange(5000, 5000 + R, dtype=U)) | U(1)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """2 M R min-hashes of each set (row); an empty set has the largest value throughout."""
    out = np.full((len(at) - 1, 2 * M * R), np.iinfo(np.uint64).max, U)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        for i in range(2 * M * R):
            x = sets * _ODD[i]
            x += _ADD[i]
            x ^= x >> U(29)
            x *= _ODD[-1 - i]
            out[full, i] = np.minimum.reduceat(x, at[:-1][full])
    return out


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets, at = shingles(*raw(b.column("text")), k)
            sig = signatures(sets, at)
            halves = mix((sig.reshape(-1, 2 * M, R) * _POW).sum(axis=2, dtype=U) + np.arange(2 * M, dtype=U))
            lanes = mix(sig).reshape(len(sig), -1, LANES) & U(127)
            sketch = np.concatenate([parities(sets, at, BITS), (lanes << (np.arange(LANES, dtype=U) * U(8))).sum(axis=2, dtype=U)], axis=1)
            n = np.diff(at)
            ids = [hashlib.blake2b(sets[s:e].tobytes(), digest_size=16).digest() if e > s else None for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            rows = np.arange(len(n) + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), list_array(pa.array(longs(halves).reshape(-1)), rows * 2 * M), list_array(pa.array(longs(sketch).reshape(-1)), rows * sketch.shape[1])],
                ["id", "n_shingles", "same", "halves", "sketch"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets, at = shingles(*raw(b.column("text")), k)
            yield pa.RecordBatch.from_arrays([b.column("id"), list_array(pa.array(longs(sets)), at)], ["id", "set"])

    return run


def _alike(percent: int):
    """What linked sets meet, by sizes, bitmaps and min-hashes, in the first table that they share.

    Of two linked sets the smaller has percent of the larger at least. i >= p u and u = (sum + d) / 2, where d are
    in one set only, give d <= (1 - p) / (1 + p) of the sum; bitmaps differ in d bits at most. Of the min-hashes
    hardly fewer than p agree. Of the tables of a pair the first is that with no earlier half key that agrees (32 bits of
    each are compared).
    """
    s, n = percent / 100, 2 * M * R
    most = int(n * (1 - s + 6 * (s * (1 - s) / n) ** 0.5))
    ones, tops = (U(sum(x << (8 * j) for j in range(LANES))) for x in (0x7F, 0x80))
    low = U(0xFFFFFFFF)

    def alike(column, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        size = column("size")
        at = np.flatnonzero((100 * size[l] >= percent * size[r]) & (100 * size[r] >= percent * size[l]))
        room = (100 - percent) * (size[l[at]] + size[r[at]]) // (100 + percent)
        for names, weigh, limit in (([f"p{j}" for j in range(BITS // 64)], lambda x: x, None), ([f"s{j}" for j in range(n // LANES)], lambda x: (x + ones) & tops, most)):
            apart = np.zeros(len(at), np.int64)
            for name in names:
                x = column(name).view(U)
                apart += np.bitwise_count(weigh(x[l[at]] ^ x[r[at]]))
                ok = apart <= (room if limit is None else limit)
                at, apart, room = at[ok], apart[ok], room[ok]
        for t in range(2 * M):
            x = column(f"h{t // 2}").view(U)
            x = x[l[at]] ^ x[r[at]]
            same = (x >> U(32) if t % 2 == 0 else x & low) == 0
            at = at[(column("i" if t < M else "j")[l[at]] <= t) | ~same]
        return at

    return alike


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose sets of k-word shingles are alike: 100 * intersection >= percent * union.

    Words are runs of bytes other than white space, A-Z lower-cased. A text with fewer than k words has its whole
    sequence as its one shingle; null texts and texts without words have none and are linked with nothing. Returns
    id, n_shingles, component_id (the smallest id reachable over links, itself included) and kept (its id is that
    one). Equal rows of one id are one document. Rows of one id whose sets differ are linked with nothing; so are
    rows of null id, which are kept with a null component. Other columns are ignored, and an empty table gives no rows.

    Documents of one set are one class from the start, so copies are never paired. Classes meet by half keys:
    only half keys that two classes share are paired to table keys, and of half keys (and table keys) that the
    same classes share only the first. `link_by_buckets` then looks for hubs by half keys and tests candidates on full
    sets, joined as arrays of 64-bit shingle hashes.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near")
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    kind = "id long, n_shingles long, same binary, halves array<bigint>, sketch array<bigint>"
    rows = ws.keep(slim.mapInArrow(_features(k), kind), "features")
    some = rows.where("same is not null and id is not null")
    odd = conflicting_ids(ws, rows.select("id", F.coalesce("same", F.lit(b"")).alias("same")), "same")
    if odd is not None:
        some = some.join(odd, "id", "left_anti")
    least = ws.keep(some.groupBy("same").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n"), F.first("halves").alias("halves"), F.first("sketch").alias("sketch")), "classes")
    # a half key that only one class has leads to no pair, and of those that the same classes have one will do
    half = least.select("id", F.posexplode("halves").alias("i", "h")).withColumn("first", F.col("i") < M)
    shared = distinct_buckets(ws, half, ["first", "i", "h"], apart=["first"]).select("i", "h", "n")
    half = ws.keep(half.join(shared, ["i", "h"]).select("id", "i", "h", "first", "n"), "halves")
    mine = lambda c: F.collect_list(F.when(c, F.struct("i", F.xxhash64("i", "h").alias("h"))))
    left = half.groupBy("id").agg(mine(F.col("first")).alias("p"), mine(~F.col("first")).alias("q")).where("size(p) > 0 and size(q) > 0")
    keys = left.select("id", F.explode("p").alias("p"), "q").select("id", "p", F.explode("q").alias("q")).select(F.xxhash64("p.h", "q.h").alias("bucket"), "id", F.col("p.i").cast("byte").alias("i"), F.col("q.i").cast("byte").alias("j"))
    keys = ws.keep(keys, "keys")
    tables = distinct_buckets(ws, keys, ["i", "j", "bucket"])
    members = ws.keep(keys.join(tables, ["i", "j", "bucket"]).withColumn("base", F.lit(True)), "members")
    words, lanes = BITS // 64, 2 * M * R // LANES
    two = lambda j: F.shiftleft(F.col("halves")[2 * j], 32).bitwiseOR(F.col("halves")[2 * j + 1].bitwiseAND(F.lit(0xFFFFFFFF)))
    payload = least.select("id", F.col("n").alias("size"), *[F.col("sketch")[j].alias(f"p{j}") for j in range(words)], *[F.col("sketch")[words + j].alias(f"s{j}") for j in range(lanes)], *[two(j).alias(f"h{j}") for j in range(M)])

    wanted = ws.keep(members.select("id").distinct(), "wanted")
    meetings = half.join(hinted(wanted), "id", "left_semi").select(F.xxhash64("i", "h").alias("bucket"), "id", F.lit(True).alias("base"), "n")
    sets = ws.keep(slim.join(hinted(wanted), "id", "left_semi").mapInArrow(_sets(k), "id long, set array<bigint>").dropDuplicates(["id"]), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        two = one.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        return two.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t")).where(f"100 * i >= {percent} * (t - i)").select("a", "b")

    comp, _ = link_by_buckets(ws, members, verify, payload, _alike(percent), meetings=ws.keep(meetings, "meetings"))

    named = least.select("same", "id").join(comp, "id", "left").select("same", F.coalesce("comp", "id").alias("component"))
    named = ws.keep(named, "named")
    out = rows.select("id", "n_shingles", "same")
    if odd is not None:
        out = out.join(odd.withColumn("odd", F.lit(True)), "id", "left").withColumn("same", F.when(F.col("odd").isNull(), F.col("same"))).drop("odd")
    out = out.withColumn("same", F.when(F.col("id").isNotNull(), F.col("same"))).join(named, "same", "left")
    group = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", group.alias("component_id"), F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that a smaller id of their group stands for."""
    ws = Workspace(docs.sparkSession, "gone")
    gone = near_duplicates(docs, k, percent, id_col, text_col).where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    gone = hinted(ws.keep(gone, "gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
