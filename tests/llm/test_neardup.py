"""Near-duplicates against all pairs compared."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tributary.llm.common import parities
from tributary.llm.linking import connected_components
from tributary.llm.common import Workspace
from tributary.llm.neardup import near_duplicates, one_of_each_group

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    """id to (n, component); ids with rows of different sets are linked with nothing."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingle_set(t, k))
    one = {i: next(iter(s)) for i, s in sets.items() if len(s) == 1}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(i for i in one if one[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(one[a] & one[b])
            if 100 * both >= percent * (len(one[a]) + len(one[b]) - both):
                p, q = sorted((root(a), root(b)))
                comp[q] = p
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_against_all_pairs(odd, k):
    df, rows = odd
    want = brute([(r[0], r[1]) for r in rows], k, 80)
    out = near_duplicates(df, k=k).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) and r["n_shingles"] == len(shingle_set(texts[r["doc_id"]], k))
    assert len({r["component_id"] for r in out}) < len(out) - 10


def test_a_large_group_of_near_copies(spark):
    """Copies of one text with more and fewer changes: many buckets with many members, few of them linked to one hub."""
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(900)}" for _ in range(100)]
    rows = []
    for i in range(300):
        w = base[:]
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(100)] = f"x{rnd.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == brute(rows, 4, 80)


def test_rows_of_one_id_that_differ(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, t), (2, t), (2, "something else here now"), (3, t)]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (2, 2), (2, 2), (3, 1)]


def test_one_stays(odd):
    df, rows = odd
    want = brute([(r[0], r[1]) for r in rows], 5, 80)
    out = one_of_each_group(df)
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in rows if r[0] is None or want[r[0]] == r[0])


def test_empty(empty):
    assert near_duplicates(empty).collect() == [] and one_of_each_group(empty).collect() == []


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(30)]
    got = {r["id"]: r["comp"] for r in connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(80):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_parity_bitmaps_bound_the_difference():
    rnd = np.random.default_rng(0)
    for n in (0, 5, 300, 5000):
        a = rnd.integers(0, 2**64, n, np.uint64)
        b = np.concatenate([a[n // 7 :], rnd.integers(0, 2**64, n // 9, np.uint64)])
        p = parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
        assert np.bitwise_count(p[0] ^ p[1]).sum() <= n // 7 + n // 9
