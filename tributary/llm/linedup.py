"""Near-duplicate lines by a segment-partition edit join.

Two lines within `tau` edits share one of tau + 1 segments of the shorter one, unchanged and hardly moved. Each line
is indexed under its segments and probes the segments of lines up to tau bytes shorter, at the few places where
a match can lie. Candidates are verified with a banded bit-parallel edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import GOLD, U, Workspace, hinted, longs, mix, pack, parities, raw, shuffle_partitions, slices, unpack
from .linking import distinct_buckets, link_by_buckets

TAU, LEAST_BYTES = 2, 24
PART_BYTES = 4 << 20
BITS = 128
_MASK = (1 << 64) - 1
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
KEY = np.dtype([("key", "<u8"), ("line", "V16"), ("base", "u1")])
_BYTES = mix(np.arange(1, 257, dtype=U))


def within(s: bytes, t: bytes, k: int) -> bool:
    """Whether the edit distance of two byte strings is k (below 32) at most: Hyyro's banded bit vectors after common ends are cut."""
    if s == t:
        return True
    if abs(len(s) - len(t)) > k:
        return False
    i, n = 0, min(len(s), len(t))
    a, b = np.frombuffer(s, np.uint8, n), np.frombuffer(t, np.uint8, n)
    d = np.flatnonzero(a != b)
    i = int(d[0]) if len(d) else n
    s, t = s[i:], t[i:]
    n = min(len(s), len(t))
    if n:
        d = np.flatnonzero(np.frombuffer(s, np.uint8)[len(s) - n :][::-1] != np.frombuffer(t, np.uint8)[len(t) - n :][::-1])
        j = int(d[0]) if len(d) else n
        s, t = s[: len(s) - j], t[: len(t) - j]
    m, n = len(s), len(t)
    if not m or not n:
        return max(m, n) <= k
    if m <= k or n <= k:
        row = list(range(n + 1))
        for i in range(1, m + 1):
            new = [i]
            for j in range(1, n + 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (s[i - 1] != t[j - 1])))
            row = new
        return row[n] <= k
    where: dict[int, int] = {}
    for i, c in enumerate(s):
        where[c] = where.get(c, 0) | (1 << i)
    vp, vn, dist, horizontal = (_MASK << (63 - k)) & _MASK, 0, k, 1 << 62
    give_up = k + n - (m - k)
    for j in range(n):
        x = ((where.get(t[j], 0) << (63 - k)) >> j) & _MASK
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & _MASK
        hp, hn = (vn | ~(d0 | vp)) & _MASK, d0 & vp
        if j < m - k:
            dist += not d0 >> 63
        else:
            dist += (hp & horizontal > 0) - (hn & horizontal > 0)
            horizontal >>= 1
        if dist > give_up:
            return False
        vp, vn = (hn | ~((d0 >> 1) | hp)) & _MASK, (d0 >> 1) & hp
    return dist <= k


def lines_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all texts, the text of each and its number there; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    n = len(at) - 1
    text_of_break = np.searchsorted(at, breaks, "right") - 1
    starts = np.concatenate([at[:-1], breaks + 1])
    order = np.lexsort((np.concatenate([np.full(n, -1), breaks]), np.concatenate([np.arange(n), text_of_break])))
    starts, text = starts[order], np.concatenate([np.arange(n), text_of_break])[order]
    ends = np.append(starts[1:] - 1, at[-1]) if len(starts) else starts
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    ends = np.where(last, at[1:][text], ends) if len(text) else ends
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
    return starts, ends, text, np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    out = []
    for base in (BASE, INVERSE):
        x = np.ones(max(n, 1), U)
        x[1:] = base
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def segment_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of lines, the line of each, and whether the line is indexed (else it probes) there.

    A segment's hash comes from running sums of a polynomial over all bytes, so that its length costs nothing.
    """
    size, keys, line, base = ends - starts, [], [], []
    rows = np.arange(len(starts))
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * power[:-1], out=sums[1:])
    for shorter in range(tau + 1):
        length = size - shorter
        short, rest = length // (tau + 1), length % (tau + 1)
        for i in range(tau + 1):
            seg = short + (i >= tau + 1 - rest)
            begin = i * short + np.maximum(0, i - (tau + 1 - rest))
            for shift in range(max(-i, shorter - (tau - i)), min(i, shorter + (tau - i)) + 1):
                ok = (seg > 0) & (begin + shift >= 0) & (begin + shift + seg <= size)
                b = starts[ok] + begin[ok] + shift
                h = (sums[b + seg[ok]] - sums[b]) * inverse[b]
                keys.append(mix(mix(h) ^ (length[ok].astype(U) * GOLD + U(i))))
                line.append(rows[ok])
                base.append(np.full(ok.sum(), shorter == 0 and shift == 0))
    return np.concatenate(keys), np.concatenate(line), np.concatenate(base)


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    view = data.tobytes()
    return [hashlib.blake2b(view[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist())]


def pair_parities(lines: list[bytes]) -> np.ndarray:
    """Each line's bitmap of its pairs of neighbouring bytes, as BITS / 64 words; an edit changes four pairs at most."""
    size = np.array([len(x) for x in lines], np.int64)
    data = np.frombuffer(b"".join(lines), np.uint8).astype(U)
    at = np.concatenate([[0], np.cumsum(size)])
    inside = np.ones(max(len(data) - 1, 0), bool)
    cuts = at[1:-1]
    inside[cuts[(cuts > 0) & (cuts < len(data))] - 1] = False
    pairs = mix((data[:-1] << U(8) | data[1:]) + U(1))[inside] if len(data) else np.zeros(0, U)
    return parities(pairs, np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))]), BITS)


def _long_lines(b: pa.RecordBatch, least: int):
    data, at = raw(b.column("text"))
    starts, ends, text, number = lines_of(data, at)
    ok = ends - starts >= least
    return data, starts[ok], ends[ok], text[ok], number[ok]


def _at(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def line_repeats(docs: DataFrame, tau: int = TAU, least_bytes: int = LEAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated lines by document: id, removed (numbers of its lines from 0, ascending) and n_near, for ids that have any.

    Lines end at U+000A; a null text has one empty line. Equal lines of any length are linked, down to the empty
    line, and lines of least_bytes UTF-8 bytes or more also if tau edits of bytes make one the other; a class is all
    lines reachable over links. Of each class the first line stays, by id and then number; the others are
    removed. n_near counts those whose bytes are not that line's. Rows of null id have no repeats and are none.
    Rows with one id are taken as one: where their texts differ, a line that is removed from one is removed from
    all. Other columns are ignored; an empty table gives no rows.

    Repeats of one line are one member of the join. Keys are packed per slice of text before the shuffle. Lines
    are joined back by broadcast if they are small enough, else by a shuffle.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lines")
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null")
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-total // PART_BYTES))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, starts, ends, text, number = _long_lines(b, 0)
            yield pa.RecordBatch.from_arrays([pa.array(_digests(data, starts, ends), pa.binary()), b.column("id").take(pa.array(text)), pa.array(number, pa.int32())], ["line", "id", "number"])

    at = ws.keep(slim.mapInArrow(places, "line binary, id long, number int"), "places")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, starts, ends, _, _ = _long_lines(b, least_bytes)
            if not len(starts):
                continue
            digest = np.frombuffer(b"".join(_digests(data, starts, ends)), "V16")
            _, one = np.unique(digest, return_index=True)
            keys, line, base = segment_keys(data, starts[one], ends[one], tau)
            row = np.zeros(len(keys), KEY)
            row["key"], row["line"], row["base"] = keys, digest[one][line], base
            yield pack(row, parts)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = unpack(batches, KEY)
        if not len(rows):
            return
        rows = rows[np.argsort(rows["key"], kind="stable")]
        new = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])
        size = np.diff(np.append(np.flatnonzero(new), len(rows)))
        rows = rows[np.repeat(size > 1, size)]
        if not len(rows):
            return
        line = np.ascontiguousarray(rows["line"]).view("<u8").reshape(-1, 2)
        order = np.lexsort((1 - rows["base"].astype(int), line[:, 0], line[:, 1], rows["key"]))
        rows, line = rows[order], line[order]
        k = rows["key"]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (line[1:] != line[:-1]).any(1)])
        rows = rows[fresh]  # each line once a key, as indexed if it is
        k = rows["key"]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(begin, len(rows)))
        good = (size > 1) & (np.add.reduceat(rows["base"].astype(int), begin) > 0)
        rows = rows[np.repeat(good, size)]
        for i in range(0, len(rows), 100_000):
            r = rows[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r["key"]).view(np.int64)), _at(r["line"]), pa.array(r["base"].astype(bool))], ["bucket", "id", "base"])

    packed = slim.mapInArrow(index, "part int, rows binary").repartition(parts, "part")
    found = ws.keep(packed.mapInArrow(shared, "bucket long, id binary, base boolean"), "found")
    members = ws.keep(found.join(distinct_buckets(ws, found, ["bucket"], marks=["base"]), "bucket"), "members")
    wanted = ws.keep(members.select("id").distinct(), "wanted")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, starts, ends, _, _ = _long_lines(b, least_bytes)
            view = data.tobytes()
            body = dict(zip(_digests(data, starts, ends), zip(starts.tolist(), ends.tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(list(body), pa.binary()), pa.array([view[s:e] for s, e in body.values()], pa.binary())], ["id", "body"])

    bit_names = [f"p{j}" for j in range(BITS // 64)]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            bits = longs(pair_parities(b.column("body").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("body"), *[pa.array(bits[:, j]) for j in range(BITS // 64)]], ["id", "body", *bit_names])

    body = slim.mapInArrow(bodies, "id binary, body binary").join(hinted(wanted), "id", "left_semi").groupBy("id").agg(F.first("body").alias("body"))
    body = ws.keep(body.mapInArrow(sketched, "id binary, body binary, " + ", ".join(f"{c} long" for c in bit_names)), "bodies")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [within(x, y, tau) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        one = pairs.join(body.select(F.col("id").alias("a"), F.col("body").alias("x")), "a")
        two = one.join(body.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
        near = F.abs(F.octet_length("x") - F.octet_length("y")) <= tau
        return two.where(near).select("a", "b", "x", "y").mapInArrow(linked, "a binary, b binary")

    def alike(column, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        """tau edits change the length by tau and four pairs of bytes each at most."""
        at = np.flatnonzero(np.abs(column("size")[l] - column("size")[r]) <= tau)
        apart = sum(np.bitwise_count(column(c)[l[at]].view(U) ^ column(c)[r[at]].view(U)).astype(np.int64) for c in bit_names)
        return at[apart <= 4 * tau]

    payload = body.select("id", F.octet_length("body").alias("size"), *bit_names)
    comp, _ = link_by_buckets(ws, members, verify, payload, alike)
    place = F.struct("id", "number")
    lines = at.groupBy("line").agg(F.min(place).alias("at"), F.count("*").alias("n")).join(comp.withColumnRenamed("id", "line"), "line", "left").where("n > 1 or comp is not null")
    lines = ws.keep(lines.withColumn("comp", F.coalesce("comp", "line")), "classes")
    first = lines.groupBy("comp").agg(F.min("at").alias("first"), F.min_by("line", "at").alias("first_line"))
    known = ws.keep(lines.join(first, "comp").select("line", "first", (F.col("line") != F.col("first_line")).alias("near")), "known")
    gone = at.join(hinted(known), "line").where((F.col("id") != F.col("first.id")) | (F.col("number") != F.col("first.number")))
    return ws.keep(gone.groupBy("id").agg(F.sort_array(F.collect_set("number")).alias("removed"), F.count_if("near").alias("n_near")).withColumnRenamed("id", id_col), "repeats")


def _cut(batches: Iterator[pa.RecordBatch], texts: list[int], drop_empty: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose last columns are text and the numbers of the lines to take out, to rows without those two columns.

    texts: the columns that get what is left of the text.
    """
    for b in slices(batches, "_text"):
        stay, left = [], []
        for text, gone in zip(b.column("_text").to_pylist(), b.column("_gone").to_pylist()):
            if gone is not None:
                gone = set(gone)
                kept = [x for i, x in enumerate((text or "").split("\n")) if i not in gone]
                text = None if text is None else "\n".join(kept)
                stay.append(not drop_empty or any(x.strip(" ") for x in kept))
            else:
                stay.append(True)
            left.append(text)
        columns = b.columns[:-2]
        for i in texts:
            columns[i] = pa.array(left, columns[i].type)
        out = pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-2])
        yield out if all(stay) else out.filter(pa.array(stay))


def without_lines(docs: DataFrame, removed: DataFrame, drop_empty: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed lines (id, removed) taken out of their texts, one row for each of its rows.

    drop_empty: without documents of which nothing but spaces is left. removed: each id once, as `line_repeats` has it.
    """
    per = removed.where(F.size("removed") > 0).select(F.col(id_col).alias("_id"), F.col("removed").alias("_gone"))
    joined = docs.join(hinted(per), docs[id_col] == per["_id"], "left")
    # by frame, since docs may have columns of any name
    named = joined.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], docs[text_col].alias("_text"), per["_gone"].alias("_gone"))
    at = [i for i, c in enumerate(docs.columns) if c == text_col]
    kind = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)])
    out = named.mapInArrow(lambda b: _cut(b, at, drop_empty), kind)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def dedup_lines(docs: DataFrame, tau: int = TAU, least_bytes: int = LEAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `line_repeats` takes out of each row of docs, and what is left of it.

    Returns, for each row, id, n_lines, removed, n_near and text (the lines left; null stays null). Rows
    with one id whose texts differ have the same list of lines to remove.
    """
    per = line_repeats(docs, tau, least_bytes, id_col, text_col).select(F.col(id_col).alias("_id"), "removed", "n_near")
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    joined = slim.join(hinted(per), F.col("id") == F.col("_id"), "left").select("id", "text", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n, texts = [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("removed").to_pylist()):
                n.append((text or "").count("\n") + 1)
                if gone and text is not None:
                    gone = set(gone)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), b.column("removed"), b.column("n_near"), pa.array(texts, pa.string())], [id_col, "n_lines", "removed", "n_near", "text"])

    return joined.mapInArrow(cut, f"{id_col} long, n_lines long, removed array<int>, n_near long, text string")
