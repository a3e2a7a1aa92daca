"""Mixing: targets, apportionment and what documents give."""

import heapq
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tributary.llm.mix import mix_documents, repeat_documents, sainte_lague, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 10}, {"a": 1, None: 5000, "b": 0}, {"only": 9}, {None: 3}, {"z": 0}, {"é": 5, "z": 7, "Z": 900, "😀": 40, "": 12}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "no_source boolean, source string, source_size long")
    got = {(None if r["no_source"] else r["source"]): r["target"] for r in targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


@pytest.mark.parametrize(("weights", "seats"), [([53, 24, 23], 7), ([5, 2, 1], 1000), ([1, 1, 1, 1], 6), ([10, 0, 3], 5), ([1000, 1], 3), ([2.5, 2.5], 0)])
def test_sainte_lague(spark, weights, seats):
    heap = [(-w, i, 0) for i, w in enumerate(weights) if w]
    want = Counter()
    heapq.heapify(heap)
    for _ in range(seats):
        _, i, s = heapq.heappop(heap)
        want[i] += 1
        heapq.heappush(heap, (-weights[i] / (2 * s + 3), i, s + 1))
    df = spark.createDataFrame([(i, float(w), seats) for i, w in enumerate(weights)], "k int, w double, n long")
    assert {r["k"]: r["got"] for r in sainte_lague(df, [], ["k"], "w", "n", "got").collect() if r["got"]} == dict(want)


def test_mix(spark, odd):
    df, rows = odd
    out = mix_documents(df).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], size(r[1])) for r in rows)
    again = mix_documents(df.repartition(7)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def test_small_shards(spark):
    """Sources of many documents of a word or a few take their targets too, to a word."""
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randrange(0, 6), "big") for i in range(600)] + [(1000 + i, "w " * rnd.randrange(1, 5), "small") for i in range(300)] + [(5000, "one", "tiny")]
    out = mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in out:
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_whole_repeats(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "abc"[i % 3]) for i in range(60)], "doc_id long, text string, source string")
    taken = mix_documents(docs)
    n = Counter(r["doc_id"] for r in repeat_documents(docs, taken).collect())
    for r in taken.collect():
        assert n[r["doc_id"]] == int(r["taken"] / 50 + 0.5)


def test_empty(empty, spark):
    assert mix_documents(empty).collect() == [] and repeat_documents(empty, mix_documents(empty)).collect() == []


def test_no_python(spark, odd):
    plan = mix_documents(odd[0].select("doc_id", "text", "source"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_words_only(spark):
    r = mix_documents(spark.createDataFrame([(1, None, "a"), (2, " \t\n", "a")], "doc_id long, text string, source string")).agg(F.sum("taken"), F.count("*")).first()
    assert tuple(r) == (0, 2)
