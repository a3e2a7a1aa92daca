"""The corpus pipeline: each stage's decisions, and the whole against stages run by hand."""

import os
import re
from collections import Counter

import pytest
from test_linedup import brute as repeated_lines
from test_mix import brute_targets

import corpus_pipeline as cp
from tributary.llm.mix import mix_documents
from tributary.llm.quality import score_quality
from tributary.llm.tokenizing import default_path

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


def linked_sets(texts: dict) -> set:
    """Ids that stay: the smallest of each component of texts whose sets of five-word shingles are alike."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, min(len(w), 1)))}
    comp = {i: i for i in texts}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                comp[q] = p
    return {i for i in ids if root(i) == i}


def test_stages(spark):
    """Each stage on all that the one before it kept: labels, lines, groups, weights and tokens by brute force."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    table = {r["doc_id"]: r for r in docs.collect()}
    predicted = {r["doc_id"]: r["predicted"] for r in score_quality(docs, spark.read.parquet(f"{D}/labels.parquet")).collect()}
    one = cp.quality(spark, docs, D).cache()
    assert one.columns == columns and sorted(one.collect()) == sorted(r for i, r in table.items() if predicted[i])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in table]
    assert sum(predicted[i] for i in good) >= 0.9 * len(good)
    removed, _ = repeated_lines([(r["doc_id"], r["text"]) for r in one.collect()])
    gone, want = Counter(i for i, _ in removed), {}
    for r in one.collect():
        kept = [s for n, s in enumerate(r["text"].split("\n")) if (r["doc_id"], n) not in removed]
        if not gone[r["doc_id"]] or any(s.strip(" ") for s in kept):
            want[r["doc_id"]] = "\n".join(kept)
    two = cp.lines(spark, one, D).cache()
    assert two.columns == columns and {r["doc_id"]: r["text"] for r in two.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = cp.near(spark, two, D).cache()
    assert three.columns == columns and {r["doc_id"] for r in three.collect()} == linked_sets(want)
    sizes, source = {r["doc_id"]: len(r["text"].split()) for r in three.collect()}, {r["doc_id"]: r["source"] for r in three.collect()}
    taken = {r["doc_id"]: r["taken"] for r in mix_documents(three).collect()}
    per = Counter()
    for i, n in sizes.items():
        per[source[i]] += n
    got = Counter()
    for i, n in taken.items():
        got[source[i]] += n
    assert all(abs(got[s] - t) <= 1 for s, t in brute_targets(per).items())
    times = {i: int(taken[i] / n + 0.5) if n else 1 for i, n in sizes.items()}
    four = cp.mixing(spark, three, D).cache()
    assert four.columns == columns and Counter(r["doc_id"] for r in four.collect()) == +Counter(times)
    coder = Tokenizer.from_file(default_path())
    tokens = {i: len(coder.encode(want[i], add_special_tokens=False).ids) + 1 for i, n in times.items() if n}
    got, held = Counter(), Counter()
    for r in cp.packing(spark, four, D).collect():
        assert r["doc_tokens"] == tokens[r["doc_id"]]
        got[r["doc_id"]] += r["length"]
        held[r["sequence_id"]] += r["length"]
    assert got == {i: times[i] * n for i, n in tokens.items()} and max(held.values()) <= 4096
    pieces = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.where("start = 0").collect())
    assert pieces(cp.run(spark, D)) == {(i, tokens[i]): n for i, n in times.items() if n}


def test_odd_and_empty_tables(spark, odd, empty):
    df, _ = odd
    for docs in (df, empty):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, D)
            rows = out.collect()
            assert name == "packing" or out.columns == docs.columns
            assert rows or not docs.count() or name == "quality classifier"


def test_stage_list():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "near-duplicates", "mixing", "packing"] and cp.ORACLE_SQL is None


def test_packing_sends_small_batches(spark, monkeypatch):
    """Few rows go to a worker at once, and the session's own setting holds again after that."""
    from tributary.llm.common import ARROW_ROWS

    def sizes(docs):
        import pyarrow as pa

        return docs.select("doc_id").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long")

    monkeypatch.setattr(cp, "pack_documents", sizes)
    docs, before = spark.range(0, 3000, 1, 1).withColumnRenamed("id", "doc_id"), spark.conf.get(ARROW_ROWS)
    try:
        for own, most in ((before, 500), ("100", 100), ("0", 500)):
            spark.conf.set(ARROW_ROWS, own)
            rows = [r.n for r in cp.packing(spark, docs, "").collect()]
            assert sum(rows) == 3000 and max(rows) == most and spark.conf.get(ARROW_ROWS) == own
    finally:
        spark.conf.set(ARROW_ROWS, before)
