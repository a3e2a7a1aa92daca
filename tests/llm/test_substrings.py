"""Repeated byte strings against a table of all strings."""

import hashlib
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tributary.llm.substrings import remove_repeats


def brute(docs, length):
    first, out = {}, {}
    for d in sorted(docs):
        b = docs[d]
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if first.setdefault(s, d) < d:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def result(df, **more):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(df, **more).collect()}


@pytest.mark.parametrize(("length", "gram"), [(50, 18), (24, 9)])
def test_random_overlaps(spark, length, gram):
    rnd = random.Random(length)
    pool = ["".join(rnd.choice("ab é漢") for _ in range(rnd.randrange(20, 200))) for _ in range(12)] + ["a" * 90, "ab" * 60]
    rows = [(i, "".join(rnd.choice(pool)[rnd.randrange(20) :] for _ in range(rnd.randrange(1, 5)))) for i in range(120)] + [(500, None), (501, ""), (502, "a" * 49)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length=length, gram=gram)
    assert got == brute({i: (t or "").encode() for i, t in rows}, length)


def test_odd_table(odd):
    df, rows = odd
    out = remove_repeats(df).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    want = brute({r[0]: (r[1] or "").encode() for r in rows if r[0] is not None}, 50)
    for r in out:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_slices_and_parts(spark, monkeypatch):
    """Slices of a document or two and many ranges give the same."""
    import tributary.llm.substrings as m

    monkeypatch.setattr(m, "SLICE", 600)
    monkeypatch.setattr(m, "PART_BYTES", 500)
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefg ") for _ in range(300))
    rows = [(i, "".join(rnd.choice("abcdefg ") for _ in range(rnd.randrange(90))) + passage[rnd.randrange(100) : rnd.randrange(150, 300)]) for i in range(90)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute({i: t.encode() for i, t in rows}, 50)


def test_ids_with_different_texts_take_nothing(spark):
    t = "x" * 10 + "".join(map(str, range(60)))
    got = sorted((r["doc_id"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame([(1, t), (1, "other"), (2, t), (3, t)], "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (2, 0), (3, len(t))]


def test_empty(empty):
    assert remove_repeats(empty).collect() == []


def test_large_ids_beside_a_null_one(spark):
    """Ids near 2**60 stay what they are in a batch with a null id."""
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefg ") for _ in range(400))
    rows = [((1 << 60) + i, passage[rnd.randrange(50) : rnd.randrange(200, 400)] + str(i) * 20) for i in range(30)]
    got = remove_repeats(spark.createDataFrame([*rows, (None, passage)], "doc_id long, text string").coalesce(1)).collect()
    want = brute({i: t.encode() for i, t in rows}, 50)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got if r["doc_id"] is not None} == want


def test_asked_windows_are_few_and_small(spark, monkeypatch):
    """Phrases that many texts have by chance ask for hardly any windows; edges of passages travel as bytes, not as hashes of each window."""
    import tributary.llm.common as m

    keep, tables = m.Workspace.keep, {}

    def spy(self, df, name="t"):
        tables[name] = keep(self, df, name)
        return tables[name]

    def asked(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        assert result(df) == brute({i: t.encode() for i, t in rows}, 50)
        sent = tables["first"].where("part is not null")
        sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in sent.dtypes if kind == "binary"]
        return sent.agg(F.coalesce(F.sum(sum(sizes, F.lit(0))), F.lit(0))).first()[0]

    monkeypatch.setattr(m.Workspace, "keep", spy)
    rnd = random.Random(11)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrases = [noise(24) for _ in range(5)]
    rows = [(i, "".join(noise(30) + rnd.choice(phrases) for _ in range(20)) + noise(30)) for i in range(80)]
    assert asked(rows) < 0.05 * sum(len(t) for _, t in rows)  # sides' 16 bits agree by chance
    passage = noise(3000)
    rows = [(i, "".join(noise(40) + passage[(a := rnd.randrange(2900)) : a + 100] for _ in range(15))) for i in range(80)]
    assert 0 < asked(rows) < 1.5 * sum(len(t) for _, t in rows)


def test_kept_tables_leave_no_shuffle_files(spark, monkeypatch):
    """Shuffles of a table go when it is written, and the session's setting stays what it was."""
    import tributary.llm.common as m

    key, seen = m.CLEANUP, []
    was = spark.conf.get(key, None)
    keep = m.Workspace.keep

    def spy(self, df, name="t"):
        out = keep(self, df, name)
        seen.append((self.tidy, spark.conf.get(key, None)))
        return out

    monkeypatch.setattr(m.Workspace, "keep", spy)
    local = os.path.join(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    files = lambda: {f for _, _, fs in os.walk(local) for f in fs if f.startswith("shuffle_")}
    before, ws = files(), m.Workspace(spark, "tidy", tidy=True)
    ws.keep(spark.range(1000).repartition(3, "id"))
    for _ in range(50):  # they are deleted beside the query
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and seen == [(True, was)]
