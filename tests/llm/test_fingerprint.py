"""Fingerprints: the contract's columns, and that equal substrings are named alike."""

import hashlib
import random
from collections import Counter

import numpy as np

from tributary.llm.common import raw
from tributary.llm.fingerprint import compare_with_next, fingerprint_documents, fingerprints, likeness, parse, sketch_of


def text(rnd, n):
    return "".join(rnd.choice("abcdefghij klmnop") for _ in range(n))


def test_columns(spark, odd):
    df, rows = odd
    rows = [r for r in rows if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())  # ids once, so that the order is one
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rows.sort(key=lambda r: r[0])
    out = {r["doc_id"]: r for r in compare_with_next(df).collect()}
    assert len(out) == len(rows)
    for x, y in zip(rows, rows[1:] + rows[:1]):
        a, b = x[1] or "", y[1] or ""
        q = len(a) // 4
        edited = a[: len(a) - q] + b[:q]
        r = out[x[0]]
        prints, sketches = fingerprints([a.encode(), edited.encode(), b.encode()])
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(a), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1])
        assert r["near_edited"] == likeness(sketches[0], sketches[1]) and r["near_next"] == likeness(sketches[0], sketches[2]) and 0 <= r["near_edited"] <= 1
        assert np.array_equal(sketch_of(r["fingerprint"]), sketches[0])


def test_odd_tables(spark, odd, empty):
    df, rows = odd
    assert Counter(r["doc_id"] for r in compare_with_next(df).collect()) == Counter(r[0] for r in rows)
    assert compare_with_next(empty).collect() == [] and fingerprint_documents(empty).collect() == []
    one = compare_with_next(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_ranges(spark, monkeypatch):
    """Many ranges of ids: each row still meets the next one, over the borders too."""
    import tributary.llm.fingerprint as fp

    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 10)
    rows = [(i * 7 % 211, f"text number {i} " * 5) for i in range(211)]
    rows += [(500 + i, "x") for i in range(3)]
    ordered = sorted(rows)
    out = {r["doc_id"]: r["edited_sha256"] for r in fp.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for (i, a), (_, b) in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(a) // 4
        assert out[i] == hashlib.sha256((a[: len(a) - q] + b[:q]).encode()).hexdigest()


def test_equal_substrings_have_equal_phrases():
    rnd = random.Random(3)
    shared = text(rnd, 3000)
    docs = [(text(rnd, n) + shared + text(rnd, m)).encode() for n, m in ((0, 50), (13, 700), (997, 0))]
    import pyarrow as pa

    _, kept = parse(*raw(pa.array(docs, pa.large_binary())))
    names, at = kept[0]
    inside = [set(names[at[i] : at[i + 1]].tolist()) for i in range(3)]
    alone, own = parse(*raw(pa.array([shared.encode()], pa.large_binary())))
    of_shared = set(own[0][0].tolist())
    for s in inside:
        assert len(s & of_shared) >= 0.9 * len(of_shared)


def test_likeness_follows_the_edit():
    rnd = random.Random(9)
    a, b = text(rnd, 8000), text(rnd, 8000)
    prints, s = fingerprints([a.encode(), a.encode(), (a[:6000] + b[:2000]).encode(), b.encode(), b"", b"x" * 100_000])
    assert prints[0] == prints[1] and likeness(s[0], s[1]) == 1.0
    assert 0.35 < likeness(s[0], s[2]) < 0.85 and likeness(s[0], s[3]) < 0.1 and likeness(s[4], s[4]) == 1.0 and likeness(s[4], s[0]) == 0.0
    assert len(set(prints)) == 5


def test_alone_or_together():
    rnd = random.Random(8)
    docs = [text(rnd, n).encode() for n in (0, 1, 2, 3, 7, 50, 51, 999)] + [b"aaaaaaaa", b"abababab", b"aab" * 50, "é漢😀".encode() * 20]
    together = fingerprints(docs)[0]
    assert together == [fingerprints([d])[0][0] for d in docs]


# the parse once more, text by text and in whole numbers

ALL = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ALL
    return x ^ (x >> 31)


def tossed(symbols, first):
    """A round of coin tossing: the lowest place in which a symbol differs from the one before, and its bit there."""
    out = []
    for i, x in enumerate(symbols):
        d = x ^ (symbols[i - 1] if i else 0)
        place = (d & -d).bit_length() - 1 if d else (63 if first else 8)
        out.append(place << 1 | (x >> (place if first else place & 7)) & 1)
    return out


def phrases(symbols, level):
    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    label = [x for x, _ in runs]
    for r in range(4):
        label = tossed(label, level > 1 and r == 0)
    values = [mixed((x + n * 0x9E3779B97F4A7C15) & ALL) for x, n in runs]
    n = len(runs)
    begin = [i == 0 or (i < n - 1 and label[i] > label[i - 1] and label[i] >= label[i + 1]) for i in range(n)]
    starts = [i for i in range(n) if begin[i]]
    weights = [mixed(77 + i) | 1 for i in range(64)]
    return [mixed((sum(values[j] * weights[(j - a) & 63] for j in range(a, b)) + b - a) & ALL) for a, b in zip(starts, [*starts[1:], n])]


def by_hand(data):
    symbols, level, root, names = list(data), 0, 0, set()
    if not symbols:
        return "0" * 16
    while not root or level < 3:
        symbols = phrases(symbols, level + 1)
        level += 1
        if level in (2, 3):
            names |= {mixed((x + level) & ALL) >> 32 for x in symbols}
        if len(symbols) == 1 and not root:
            root = mixed((symbols[0] + level) & ALL)
    return f"{root:016x}" + "".join(f"{x:08x}" for x in sorted(names)[:64])


def test_against_a_parse_by_hand():
    rnd = random.Random(8)
    texts = [b"", b"a", b"ab", b"aaaa", b"abababab", "é漢😀".encode() * 7, b" " * 300] + [bytes(rnd.choice(b"abcdefgh \n") for _ in range(rnd.randrange(1, 900))) for _ in range(60)]
    assert fingerprints(texts)[0] == [by_hand(t) for t in texts]
