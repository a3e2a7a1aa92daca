"""Exact top-k against all scores."""

import math
import random

import pytest

from tributary.llm.knn import top_k_inner

SCHEMA = "vec_id long, embedding array<float>, id int, v int, cell int"


def brute(rows, k=5):
    import numpy as np

    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, x in whole:
        if q % 50 == 0:
            s = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q))[:k]
            out[q] = [(i, -m) for m, i in s]
    return {q: v for q, v in out.items() if v}


def ask(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    out = {}
    for r in top_k_inner(df, df.where("pmod(vec_id, 50) = 0"), **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("block", [4096, 40])
def test_against_all(spark, block):
    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rnd.gauss(0, 0.2) for c in rnd.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2101, [float("inf")] * 8), (None, [1.0] * 8), (2150, [0.0] * 8), (-50, [-1.0] * 8)]
    assert ask(spark, rows, block=block, pivots=16) == brute(rows)


def test_few(spark):
    assert ask(spark, [(0, [1.0, 2.0])]) == {} and ask(spark, []) == {}
    assert ask(spark, [(0, [1.0, 2.0]), (1, [1.0, 0.5])]) == {0: [(1, 256 * 256 + 512 * 128)]}
    assert ask(spark, [(7, [1.0])]) == {}


def test_one_value_everywhere(spark):
    """All vectors equal: every cell but one is empty, and ties go to the smaller id."""
    got = ask(spark, [(i, [0.5] * 4) for i in range(120)], block=16)
    assert got[50] == [(i, 4 * 128 * 128) for i in range(5)] and got[0] == [(i, 4 * 128 * 128) for i in range(1, 6)]


def test_only_needed_vectors_are_copied(spark, monkeypatch):
    """A cell goes to the groups of queries that may find a result in it, once each; clusters far apart stay by themselves."""
    from tributary.llm import knn

    rnd = random.Random(7)
    rows = [(i, [20.0 * (j == i % 8) + rnd.gauss(0, 0.1) for j in range(8)]) for i in range(1600)]
    kept = {}
    keep = knn.Workspace.keep
    monkeypatch.setattr(knn.Workspace, "keep", lambda self, df, name="t": kept.setdefault(name, keep(self, df, name)))
    assert ask(spark, rows, pivots=64, block=100) == brute(rows)
    cells, pairs = kept["cells"].count(), kept["pairs"]
    copies = kept["cells"].join(pairs, "cell").count()
    asks = kept["sent"].select("ask").distinct().count()
    assert copies < 0.5 * asks * cells
