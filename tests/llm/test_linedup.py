"""Near-duplicate lines against all pairs of lines."""

import hashlib
import random
from collections import Counter

import pytest

from tributary.llm.linedup import LEAST_BYTES, TAU, dedup_lines, line_repeats, pair_parities, within, without_lines
from tributary.llm.queries import op9_line_dedup


def distance(s: bytes, t: bytes) -> int:
    row = list(range(len(t) + 1))
    for i, a in enumerate(s, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_within(k):
    rnd = random.Random(k)
    for _ in range(400):
        s = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(0, 30)))
        t = bytearray(s)
        for _ in range(rnd.randrange(0, k + 3)):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randrange(2)] = bytes([rnd.choice(b"abc")]) * rnd.randrange(2)
        assert within(s, bytes(t), k) == (distance(s, bytes(t)) <= k)


def test_parities():
    """Lines within tau edits differ in four bits an edit at most."""
    rnd = random.Random(2)
    for _ in range(300):
        s = bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 60)))
        t = bytearray(s)
        for _ in range(TAU):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randrange(2)] = bytes([rnd.randrange(256)]) * rnd.randrange(2)
        p = pair_parities([s, bytes(t), b""])
        assert sum(int(x).bit_count() for x in p[0] ^ p[1]) <= 4 * TAU and not p[2].any()


def brute(rows):
    """(id, number) of the lines that go, and those of them whose bytes aren't the first line's."""
    lines = {}
    for i, t in rows:
        if i is not None:
            for n, s in enumerate((t or "").split("\n")):
                lines.setdefault((i, n), set()).add(s.encode())
    every = {b for s in lines.values() for b in s}
    bodies = sorted(b for b in every if len(b) >= LEAST_BYTES)
    comp = {b: b for b in every}

    def root(b):
        while comp[b] != b:
            b = comp[b]
        return b

    for x, a in enumerate(bodies):
        for b in bodies[x + 1 :]:
            if abs(len(a) - len(b)) <= TAU and root(a) != root(b) and within(a, b, TAU):
                comp[root(b)] = root(a)
    first = {}
    places = sorted((p, b) for p, s in lines.items() for b in s)
    for p, b in places:
        first.setdefault(root(b), (p, b))
    removed = {p for p, b in places if first[root(b)][0] != p}
    near = {p for p, b in places if p in removed and first[root(b)][1] != b}
    return removed, near


def random_rows(seed, n):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcde fgh é") for _ in range(rnd.randrange(5, 70))) for _ in range(25)]

    def line():
        s = list(rnd.choice(pool))
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            at = rnd.randrange(len(s) + 1)
            s[at : at + rnd.randrange(2)] = rnd.choice("xyz") * rnd.randrange(2)
        return "".join(s)

    return [(i, "\n".join(line() for _ in range(rnd.randrange(1, 6)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = random_rows(seed, 80)
    removed, near = brute(rows)
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], n) for r in out for n in r["removed"]} == removed and sum(r["n_near"] for r in out) == len(near)
    assert {r["doc_id"]: r["n_lines"] for r in out} == {i: t.count("\n") + 1 for i, t in rows}


def test_a_frequent_line_with_many_variants(spark):
    rnd = random.Random(3)
    base = "subscribe to our newsletter and never miss an update again"
    rows = [(i, base[: (c := rnd.randrange(len(base)))] + rnd.choice("XYZQ") * rnd.randrange(1, 3) + base[c + rnd.randrange(2) :]) for i in range(250)]
    removed, _ = brute(rows)
    got = {(r["doc_id"], n) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() for n in r["removed"]}
    assert got == removed


def test_odd_table(odd):
    df, rows = odd
    out = dedup_lines(df).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    removed, _ = brute([(r[0], r[1]) for r in rows])
    assert {(r["doc_id"], n) for r in out for n in r["removed"]} == removed
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    found = line_repeats(df)
    kept = without_lines(df, found)
    assert kept.columns == df.columns
    for r in kept.collect():
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]]
            want = t if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if (r["doc_id"], n) not in removed)
            assert r["text"] == want
    assert without_lines(df, found, drop_empty=True).count() < df.count()


def test_empty(empty):
    assert dedup_lines(empty).collect() == [] and without_lines(empty, line_repeats(empty)).collect() == []


def test_short_repeats(spark, tmp_path):
    """Equal lines of any length are repeats of the first one; short lines are still not linked by edits."""
    long = "a line that is long enough to be linked by edits"
    rows = [(1, "Les.\nAll rights reserved.\n" + long), (2, "All rights reserved.\nLes!\n\n" + long + "x"), (3, "Les.\n\nLes.\nLes"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: (r["n_removed"], r["n_near"]) for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    assert out == {1: (0, 0), 2: (2, 1), 3: (3, 0), 4: (1, 0)}
    out = {r["doc_id"]: (r["removed"], r["n_near"], r["text"]) for r in dedup_lines(docs).collect()}
    assert out == {1: ([], 0, rows[0][1]), 2: ([0, 3], 1, "Les!\n"), 3: ([0, 1, 2], 0, "Les"), 4: ([0], 0, None)}


def test_query_on_null_and_repeated_ids(spark, odd, tmp_path):
    """One row a document, whatever its id; what is left of each text is hashed."""
    df, rows = odd
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = op9_line_dedup(spark, str(tmp_path)).collect()
    removed, _ = brute([(r[0], r[1]) for r in rows])

    def left(i, t):
        gone = [] if i is None else [n for j, n in removed if j == i]
        kept = "\n".join(s for n, s in enumerate((t or "").split("\n")) if n not in gone)
        return i, (t or "").count("\n") + 1, len(gone), hashlib.sha256(kept.encode()).hexdigest()

    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in out) == Counter(left(r[0], r[1]) for r in rows)
