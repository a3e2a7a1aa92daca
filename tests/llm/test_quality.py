"""The rule ensemble: what it learns, and that the compiled column is the model."""

import math
import os
import random
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from tributary.llm.common import raw
from tributary.llm.quality import FEATURES, fit, holds, score_quality, statistics, without_rejected

D = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    got = {r["doc_id"]: r for r in score_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    y = np.array([q for q, _ in held])
    assert auc(y, np.array([g["score"] for _, g in held])) > 0.9
    good = [g["predicted"] for q, g in held if q == 1]
    assert np.mean(good) > 0.85 and np.mean([g["predicted"] for q, g in held if q == 0]) < 0.3


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
def test_other_columns_are_no_inputs(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    held = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(CAST(CAST(doc_id AS string) AS binary)), 4) = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a = score_quality(docs, labels).orderBy("doc_id").collect()
    b = score_quality(docs.selectExpr("doc_id", "text", "'xx' AS lang", "'yy' AS source", "0L AS n_chars"), held).orderBy("doc_id").collect()
    assert a == b


def test_statistics():
    x = dict(zip(FEATURES, statistics(*raw(pa.array(["a a a b, C!", None, "  "], pa.large_string())))[0]))
    assert x["log_words"] == pytest.approx(np.log1p(5)) and x["longest_run"] == 3 and x["exclaims"] == 0.2 and x["distinct"] == 0.6 and x["top_share"] == 0.6 and x["uppers"] == 0.2
    assert not statistics(*raw(pa.array([None, "  ", ""], pa.large_string()))).any()


def test_fit_finds_a_rule():
    rnd = np.random.default_rng(1)
    x = rnd.random((600, len(FEATURES)))
    y = ((x[:, 2] > 0.6) & (x[:, 5] <= 0.5)).astype(float)
    model = fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97 and 0 < len(model.rules) < 150
    assert holds(((2, True, 0.6), (5, False, 0.5)), x).sum() == y.sum()


def test_few_labels(spark, odd, empty):
    df, rows = odd
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in score_quality(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0]] + [(None, 1, 0), (9999, 0, 0), (1, None, None)], LABELS)
    out = score_quality(df, one).collect()
    assert len(out) == len(rows) and all(r["predicted"] == 1 for r in out) and not next(r["held_out"] for r in out if r["doc_id"] is None)
    assert score_quality(empty, one).collect() == [] and without_rejected(empty, one).collect() == []


def test_column_is_the_model(spark, odd):
    df, rows = odd
    labels = spark.createDataFrame([(r[0], int(len(r[1] or "") > 300), 0) for r in rows if r[0]], LABELS)
    got = {r["doc_id"]: r["score"] for r in score_quality(df, labels).collect()}
    ids = sorted({r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2})
    texts = {r[0]: r[1] for r in rows}
    x = statistics(*raw(pa.array([texts[i] for i in ids], pa.large_string())))
    y = np.array([float(len(texts[i] or "") > 300) for i in ids])
    order = np.lexsort([*x.T[::-1], y, ids])
    model = fit(x[order], y[order])
    assert [got[i] for i in ids] == pytest.approx(model.score(x).tolist())
    kept = without_rejected(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s >= 0.7}


def test_statistics_by_hand():
    """Each statistic counted anew from the bytes of a text."""
    rnd = random.Random(6)
    texts = ["", "   ", "One", "!!! A|B 12,5 é\n漢字 same same same", *["".join(rnd.choice("abC 1!|#é\n.") for _ in range(rnd.randrange(400))) for _ in range(40)]]
    got = statistics(*raw(pa.array(texts, pa.large_string())))
    for t, row in zip(texts, got):
        b = t.encode()
        words = b.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")
        words = [w for w in words if w]
        n, solid = max(len(words), 1), sum(map(len, words))
        letters = sum(chr(c).isalpha() for c in b if c < 128)
        runs = [len(list(g)) for _, g in groupby(words)]
        count = lambda chars: sum(c in chars for c in b)
        want = [math.log1p(len(words)), solid / n, count(b"#$%&*@^~<>{}[]\\_=+`") / n, count(b"!") / n, count(bytes(range(65, 91))) / max(letters, 1), count(b"|") / n, count(b"0123456789") / n, count(b".,;:?") / n, sum(c > 127 for c in b) / max(solid, 1), count(b"\n") / n]
        want += [1 - len(runs) / len(words), max(runs), len(set(words)) / len(words), max(Counter(words).values()) / len(words)] if words else [0] * 4
        assert row.tolist() == pytest.approx(want), t


def test_all_labels(spark):
    """Without a bound all labelled rows are learned from."""
    docs = spark.createDataFrame([(i, "good words here " * (i % 5 + 1) if i % 2 else "### !!! ### " * (i % 4 + 1)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    out = score_quality(docs, labels, fit_rows=None).collect()
    assert len(out) == 200 and all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in out)
