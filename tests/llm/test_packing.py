"""Packing: pieces rebuild documents, sequences are gapless, cuts are the best, ids are the tokenizer's."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tributary.llm.packing import CHUNK_COST, SENTENCE_COST, choose_cuts, pack_documents
from tributary.llm.tokenizing import ChunkEncoder, default_path

STRANGE = [
    "", "   ", ". . .", "A", "It's, isn't!? naïve. ÀÉ; x<y>z... 'twas 's 12,000.50 e-mail: İstanbul.", "ΣΑΣ, ñandú; á, b́. ;; ; ;! a.b.c 😀! 't.'re, don't... I'll, ﬁ. Ⅷ, ª.", "ẞß. STRASSE!", "\x1ca\x1fb. c\x1d",
    "K ÅÀ. ſs ß\xad! œuvre. ÿ? \u212b. \u212ael. Ñandú, über; µm ªº e\u0301té. ÷ × ÐÞ. Öl:", "a b.　c\x85d", "one\ttwo\nthree\x0b.", "!start .mid end?", "x" * 9000, "漢字 かな。カナ", "<s> </s> <unk>",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def test_ids_are_the_tokenizers(tokenizer, odd):
    coder = ChunkEncoder(default_path(), kept=50)  # so small that it forgets again and again
    texts = STRANGE + [r[1] or "" for r in odd[1]]
    for t, (ids, ends, stops) in zip(texts, coder.encode_column(pa.array(texts))):
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and coder.encode(t)[0].tolist() == want and coder.count(t) == len(want)
        assert len(ends) == len(stops) and (not len(ends) or ends[-1] == len(want))


def test_other_tokenizer_files_encode_whole_texts(tmp_path, tokenizer):
    import json

    rules = json.load(open(default_path()))
    rules["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(rules))
    from tokenizers import Tokenizer

    coder, own = ChunkEncoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    for t in STRANGE:
        assert coder.encode(t)[0].tolist() == own.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_cheapest(seed):
    rnd = random.Random(seed)
    pos = [0, *itertools.accumulate(rnd.randrange(1, 6) for _ in range(9))]
    cost = [0] + [rnd.choice([0, SENTENCE_COST, CHUNK_COST]) for _ in range(9)]
    length = 8

    def price(cuts):
        ends = [pos[i] for i in cuts]
        starts = [0, *ends[:-1]]
        if any(e - s > length for s, e in zip(starts, ends)):
            return float("inf")
        return sum(length - (e - s) for s, e in zip(starts, ends)) + sum(cost[i] for i in cuts)

    best = min(price([*c, 9]) for n in range(9) for c in itertools.combinations(range(1, 9), n))
    assert price(choose_cuts(np.array(pos), np.array(cost), length)) == best


def check(rows, docs, tokenizer, length):
    """docs: id to texts. Every row of the table is one document of its own."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    want = sorted(zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for ts in docs.values() for t in ts)
    assert by_doc.keys() == docs.keys()
    whole = []
    for i, ts in docs.items():
        pieces = by_doc[i]
        if len(ts) == 1:
            ids = np.array([*tokenizer.encode(ts[0] or "", add_special_tokens=False).ids, 2], "<u4")
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes()) and p["length"] > 0
                at += p["length"]
            assert at == len(ids)
            whole.append(zlib.crc32(ids.tobytes()))
        else:
            assert sum(p["length"] for p in pieces) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in ts)
            whole += [zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for t in ts]
    assert sorted(whole) == want
    used = padded = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length
        used += at
        padded += at if at & (at - 1) == 0 else length
    return used / padded


def test_round_trip(odd, tokenizer):
    df, rows = odd
    docs = defaultdict(list)
    for r in rows:
        docs[r[0]].append(r[1])
    assert check(pack_documents(df).collect(), docs, tokenizer, 4096) > 0.95
    assert check(pack_documents(df, length=64, batch_tokens=500).collect(), docs, tokenizer, 64) > 0.6


def test_empty(empty):
    assert pack_documents(empty).collect() == []


def test_a_task_holds_one_batch(monkeypatch):
    """A batch of Spark's is let go before the next one is read, and is encoded in small slices."""
    import types

    import pyspark

    from tributary.llm import packing as m

    monkeypatch.setattr(pyspark, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    names, text = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "one two three, naïve four. " * 2000
    sizes, held, base = [], [], pa.total_allocated_bytes()
    encode = ChunkEncoder.encode_column
    monkeypatch.setattr(ChunkEncoder, "encode_column", lambda self, c: sizes.append(sum(len(t) for t in c.to_pylist())) or encode(self, c))

    def batches():
        for i in range(3):
            held.append(pa.total_allocated_bytes() - base)
            yield pa.RecordBatch.from_arrays([pa.array(range(80 * i, 80 * i + 80)), pa.array([text] * 80)], ["id", "text"])

    pieces = sum(b.num_rows for b in m._pack(default_path(), 4096, 1 << 16, 2, names)(batches()))
    assert pieces >= 240 and sum(sizes) == 240 * len(text)
    assert max(held) < 40 * len(text) and max(sizes) <= 1 << 20


def test_columns_share_what_is_known(tokenizer):
    """Pieces are known from one column to the next, some forgotten between, and take few bytes each."""
    import tracemalloc

    rnd = random.Random(7)
    pieces = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(40_000)]
    for kept in (50, 10**6):
        coder = ChunkEncoder(default_path(), kept=kept)
        for texts in ([], STRANGE, [" ".join(pieces[i : i + 30]) for i in range(0, 300, 20)], STRANGE + pieces[:100], [None, "", "A."], STRANGE):
            want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert [x[0].tolist() for x in coder.encode_column(pa.array(texts, pa.string()))] == want
            assert coder.count_column(pa.array(texts, pa.string())).tolist() == list(map(len, want))
            assert [coder.count(t or "") for t in texts] == list(map(len, want))  # by strings, beside the columns

    coder, column = ChunkEncoder(default_path()), pa.array([" ".join(pieces)])
    tracemalloc.start()
    try:
        coder.encode_column(column)
        assert tracemalloc.get_traced_memory()[0] < 100 * len(pieces)
    finally:
        tracemalloc.stop()
