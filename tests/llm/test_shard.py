"""Sharding against the published loop, and what growing moves."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tributary.llm.shard import jump, shard_documents


def loop(key: int, buckets: int) -> int:
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("buckets", [1, 2, 40, 41, 1000])
def test_jump(spark, buckets):
    keys = [0, 1, 2, 12345678901, 2**60 - 1, 2**62, 2**63 - 1, *[i * 7919**3 % 2**60 for i in range(200)]]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump(F.col("k"), buckets).alias("b")).collect()
    assert {r["k"]: r["b"] for r in got} == {k: loop(k, buckets) for k in keys}
    with pytest.raises(ValueError):
        jump(F.lit(1), 0)


def test_documents(odd):
    df, rows = odd
    out = shard_documents(df, 40).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == sorted((r[0] or -1, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in out:
        key = int(hashlib.md5(("null" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16)
        assert r["law"] == "key" and r["shard"] == loop(key, 40) and r["grown_shard"] in (r["shard"], 40) and r["grown_shard"] == loop(key, 41)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_spread_and_reruns(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 50 AS int)) AS text")
    out = shard_documents(df, 40)
    n = Counter(r["shard"] for r in out.collect())
    assert len(n) == 40 and max(n.values()) < 1.25 * min(n.values())
    assert out.where("grown_shard <> shard").count() < 20_000 / 41 * 1.3
    assert sorted(out.collect()) == sorted(shard_documents(df.repartition(5), 40).collect())
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_empty(empty):
    assert shard_documents(empty).collect() == []
