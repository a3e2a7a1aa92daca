"""Removing byte strings that an earlier document has: anchors and grouping by hash.

A suffix array of a whole corpus needs tens of bytes for each byte of text. Here no suffixes are sorted or compared.
In each window of `length` bytes the k-gram of least hash is its anchor. Equal windows have their anchor at the same
place, so a window can only repeat where its anchor does. Spans and windows are partitioned by the range of their
anchor's hash and grouped by 64-bit hashes of their bytes, which are not verified:

1. Consecutive windows of one anchor form a span. If the same span begins in an earlier document, all its windows
   repeat. If no earlier document has the anchor, none does.
2. Else (the edges of repeated passages) the windows are compared one by one, if the bytes left or right of the
   anchor are alike too: half of what a window has beside its anchor lies on one side of it. The bytes of such spans
   are partitioned by their anchors again, and their windows sorted by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, U, Workspace, conflicting_ids, hinted, mix, raw, slices, span_hashes

LENGTH, GRAM = 50, 18
SLICE, PART_BYTES = 2 << 20, 12 << 20


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    """For each span: its anchor's hash, its first window's start, the start after its last window, its text, its anchor's start."""
    n, w = len(data), length - gram + 1
    z = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, U), z, z, z, z
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    eight = np.ndarray(n + length, "<u8", padded.data, strides=(1,))
    h, step = eight[:n] * GOLD, 8
    while step < gram:
        o = min(step, gram - 8)
        h ^= h >> U(29)
        h += eight[o : o + n]
        h *= U(0xBF58476D1CE4E5B9)
        step += 8
    h ^= h >> U(32)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(29)
    m, size = ((h >> U(32)) << U(32)) | np.arange(n, dtype=U), 1
    while size * 2 <= w:
        m, size = np.minimum(m[:-size], m[size:]), size * 2
    if size < w:
        m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(m)]
    start = np.flatnonzero(np.arange(len(m)) + length <= at[1:][text])
    if not len(start):
        return np.zeros(0, U), z, z, z, z
    anchor, text = (m[start] & U(0xFFFFFFFF)).astype(np.int64), text[start]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    # least hashes are all small; mixed, they are spread over the ranges
    return mix(h[anchor[new]]), start[new], start[np.append(new[1:], len(start)) - 1] + 1, text[new], anchor[new]


def sides(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of a hash of what lies left of each span's anchor, and right of it; 0 where no window of the span has it whole.

    A window has `length` - `gram` bytes beside its anchor, so the half of that, rounded up, on one side at least. Two
    spans of one anchor share no window unless they have that side alike.
    """
    half = (length - gram + 1) // 2
    out = []
    for there, begin in ((anchor - lo >= half, anchor - half), (hi - 1 + length - (anchor + gram) >= half, anchor + gram)):
        side = np.zeros(len(lo), np.uint16)
        begin = begin[there]
        side[there] = span_hashes(data, begin, begin + half) % U(65535) + U(1)
        out.append(side)
    return out[0], out[1]


#: Columns of what is shuffled: a span's hash, 16 bits of its anchor's and of each side's, the document and a number in it.
SPAN = ("<u8", "<u2", "<u2", "<u2", "<i8", "<i4")
#: Of a span whose windows are asked: the document, where the span starts in it, its windows. Its bytes come behind.
ASKED = ("<i8", "<i4", "<u2")


CODEC = "zstd"


def _blob(columns: list[np.ndarray], kinds: tuple[str, ...]) -> bytes:
    """Whole columns one after the other, ids and numbers as differences, compressed behind their length."""
    return _squeezed(b"".join((c if k[1] == "u" else np.diff(c, prepend=c.dtype.type(0))).tobytes() for c, k in zip(columns, kinds)))


def _squeezed(x: bytes) -> bytes:
    return len(x).to_bytes(4, "little") + pa.Codec(CODEC).compress(x, asbytes=True)


def _unsqueezed(x: bytes) -> bytes:
    return pa.Codec(CODEC).decompress(memoryview(x)[4:], int.from_bytes(x[:4], "little"), asbytes=True)


def _pack(by: np.ndarray, columns: list[np.ndarray], kinds: tuple[str, ...], parts: int, data: np.ndarray | None = None, begin: np.ndarray | None = None, size: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows as one binary value for each range of `by` that has any; rows keep their order within a range.

    data, begin and size: bytes of each row, one row's after the other's; they are a column "bytes".
    """
    part = ((by >> U(32)) * U(parts)) >> U(32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(part))
    columns = [c[order].astype(k) for c, k in zip(columns, kinds)]
    values = [_blob([c[b:e] for c in columns], kinds) for b, e in zip(at.tolist(), ends.tolist())]
    out, names = [pa.array(part[at].astype(np.int32)), pa.array(values, pa.binary())], ["part", "rows"]
    if data is not None:
        begin, size = begin[order], size[order]
        texts = [_squeezed(data[_runs(begin[b:e], size[b:e])].tobytes()) for b, e in zip(at.tolist(), ends.tolist())]
        out, names = [*out, pa.array(texts, pa.binary())], [*names, "bytes"]
    return pa.RecordBatch.from_arrays(out, names)


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for as many as size says, one run after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _unpack(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of all rows that a task got."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    found: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in batches:
        for packed in b.column("rows").to_pylist():
            x = _unsqueezed(packed)
            n, at = len(x) // width, 0
            for k, out in zip(kinds, found):
                c = np.frombuffer(x, k, n, at)
                at += c.nbytes
                out.append(c if k[1] == "u" else np.cumsum(c, dtype=k))
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(found, kinds)]


def _ids(b: pa.RecordBatch) -> np.ndarray:
    """The batch's ids, 0 for null ones, as whole numbers throughout: a null would make them floats of 53 bits."""
    return pc.fill_null(b.column("id"), 0).to_numpy()


def _offer(batches: Iterator[pa.RecordBatch], length: int, gram: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Spans by the range of their anchor. Of equal spans in a slice only the smallest document's goes there.

    The others are whole repeats for certain; they go to any one range, marked, as documents and numbers.
    """
    for b in slices(batches, "text", SLICE):
        data, at = raw(b.column("text"))
        key, lo, hi, text, anchor = anchors(data, at, length, gram)
        if not len(key):
            continue
        ids = _ids(b)
        number = np.arange(len(key)) - np.searchsorted(text, np.arange(len(at)))[text]
        item, docs = span_hashes(data, lo, hi + length - 1), ids[text]
        both = mix(key * GOLD + item)
        again = _least_of(both, docs, np.argsort(both, kind="stable")) < docs
        send = ~again
        left, right = sides(data, lo[send], hi[send], anchor[send], length, gram)
        out = _pack(key[send], [both[send], key[send], left, right, docs[send], number[send]], SPAN, parts)
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.zeros(out.num_rows, bool))], ["part", "rows", "known"])
        if again.any():
            where = int(both[again][0] % U(parts))
            value = _blob([docs[again].astype("<i8"), number[again].astype("<i4")], ("<i8", "<i4"))
            yield pa.RecordBatch.from_arrays([pa.array([where], pa.int32()), pa.array([value], pa.binary()), pa.array([True])], ["part", "rows", "known"])


def _least_of(key: np.ndarray, docs: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The smallest document of each row's key; order sorts by key."""
    k = key[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(docs[order], begin), np.diff(np.append(begin, len(k))))
    return out


#: A document and a number in it, doubled, with one added for what is known to repeat.
FOUND = ("<i8", "<i4")


def _to_docs(docs: np.ndarray, numbers: np.ndarray, known: np.ndarray | int, parts: int) -> pa.RecordBatch:
    """Numbers on their way to their documents: one packed row for each range of (mixed) ids."""
    return _pack(mix(docs.astype(U)), [docs, numbers.astype(np.int64) * 2 + known], FOUND, parts)


def _per_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document: its numbers, sorted and packed."""
    d, v = _unpack(batches, FOUND)
    order = np.lexsort((v, d))
    d, v = d[order], v[order].astype("<u4")
    begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(d))
    for i in range(0, len(begin), 10_000):
        part = zip(begin[i : i + 10_000].tolist(), end[i : i + 10_000].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(d[begin[i : i + 10_000]]), pa.array([v[s:e].tobytes() for s, e in part], pa.binary())], ["id", "spans"])


def _compare(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    asked = []
    for b in batches:
        sure = b.filter(b.column("known"))
        if sure.num_rows:
            docs, numbers = _unpack(iter([sure]), ("<i8", "<i4"))
            yield _to_docs(docs, numbers, 1, parts)
        asked.append(b.filter(pc.invert(b.column("known"))))
    item, key, left, right, docs, numbers = _unpack(iter(asked), SPAN)
    if not len(key):
        return
    whole = _least_of(item, docs, np.argsort(item, kind="stable")) < docs
    # a repeated span's first one will do; its windows are needed wherever a span of a later document has a side of it
    rest = np.flatnonzero(~whole)
    ask = np.zeros(len(key), bool)
    for side in (left, right):
        here = rest[side[rest] > 0]
        if len(here):
            ask[here[_shared(key[here].astype(U) << U(16) | side[here], docs[here])]] = True
    say = whole | ask
    yield _to_docs(docs[say], numbers[say], whole[say].astype(np.int64), parts)


def _shared(key: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which rows have a key that several documents have."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], docs[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    several = np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(several, np.diff(np.append(begin, len(k))))
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in slices(batches, "text", SLICE):
        yield b, [np.frombuffer(x or b"", "<u4") for x in b.column("spans").to_pylist()]


def _marked(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which bytes lie in one of the intervals."""
    depth = np.zeros(len(data) + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, stops, -1)
    return np.cumsum(depth[:-1]) > 0


def _result(data: np.ndarray, at: np.ndarray, gone: np.ndarray) -> list[tuple[int, int, int, str]]:
    view, out = data.tobytes(), []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        g = gone[s:e]
        removed = int(g.sum())
        runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if removed else 0
        body = view[s:e] if not removed else data[s:e][~g].tobytes()
        out.append((e - s, removed, runs, hashlib.sha256(body).hexdigest()))
    return out


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _columns(ids: pa.Array, rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return [ids, *[pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]]


def _expand(pa_spans: list[np.ndarray], text: np.ndarray, n_texts: int):
    """The slice's span numbers that are whole repeats, and those whose windows are asked."""
    first = np.searchsorted(text, np.arange(n_texts + 1))
    whole, asked = [], []
    for i, s in enumerate(pa_spans):
        if len(s):
            n = first[i] + (s >> 1).astype(np.int64)
            whole.append(n[(s & 1) == 1])
            asked.append(n[(s & 1) == 0])
    z = np.zeros(0, np.int64)
    return np.concatenate(whole) if whole else z, np.concatenate(asked) if asked else z


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each text when every byte goes that lies in a string of `length` bytes which also starts in a
    document of a smaller id.

    Texts are UTF-8 bytes; strings are judged on the texts as given, and never reach over two documents. Returns
    id, n_bytes, n_removed, n_spans (runs of removed bytes) and kept_sha256 of the bytes left. A null text is
    empty. Equal rows of one id are one document. Rows of null id, and rows of one id whose texts differ, lose
    nothing and take nothing away. Other columns are ignored; an empty table gives no rows.

    Comparison is by 64-bit hashes of whole spans and windows. Rows are packed per slice of text, as fixed-width
    arrays that a range's task sorts.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "repeats", tidy=True)
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    known = slim.where("id is not null")
    odd = conflicting_ids(ws, slim.select("id", F.xxhash64("text").alias("h")), "h")
    if odd is not None:
        known = known.join(odd, "id", "left_anti")
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // PART_BYTES))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _offer(batches, length, gram, parts)

    kind = "part int, rows binary"
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare(batches, parts)

    def gathered(found: DataFrame, name: str) -> DataFrame:
        return ws.keep(found.repartition(parts, "part").mapInArrow(_per_doc, "id long, spans binary"), name)

    spans = known.mapInArrow(offer, f"{kind}, known boolean").repartition(parts, "part").mapInArrow(compare, kind)
    spans = gathered(spans, "spans")
    joined = slim.join(spans, "id", "left").select("id", "text", "spans")

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "part", "rows", "bytes"]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results as if no asked window repeated, and the slice's spans whose windows are asked."""
        for b, said in _gathered(batches):
            data, at = raw(b.column("text"))
            key, lo, hi, text, _ = anchors(data, at, length, gram)
            whole, asked = _expand(said, text, len(at) - 1)
            gone = _marked(data, lo[whole], hi[whole] + length - 1)
            rows = _result(data, at, gone)
            n = len(rows)
            yield pa.RecordBatch.from_arrays([*_columns(b.column("id"), rows), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
            if len(asked):
                asked = np.sort(asked)
                start, count, ids = lo[asked], hi[asked] - lo[asked], _ids(b)
                # by anchor, since equal windows have equal ones; bytes take less than the hashes of a span's windows
                p = _pack(key[asked], [ids[text[asked]], start - at[text[asked]], count], ASKED, parts, data, start, count + length - 1)
                n = p.num_rows
                none = [pa.nulls(n, pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*none, pa.nulls(n, pa.string()), *p.columns], names)

    first = ws.keep(joined.mapInArrow(first_pass, f"id long, {RESULT}, {kind}, bytes binary"), "first")
    results = first.where("part is null").select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts = [], []
        for b in batches:
            rows.append(b)
            texts += [_unsqueezed(x) for x in b.column("bytes").to_pylist()]
        ids, starts, count = _unpack(iter(rows), ASKED)
        if len(ids):
            count = count.astype(np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
            size = count + length - 1
            at = _runs(np.cumsum(size) - size, count)
            key = span_hashes(data, at, at + length)
            ids, starts = np.repeat(ids, count), _runs(starts.astype(np.int64), count)
            again = _least_of(key, ids, np.argsort(key, kind="stable")) < ids
            yield _to_docs(ids[again], starts[again], 0, parts)

    more = first.where("part is not null").select("part", "rows", "bytes").repartition(parts, "part").mapInArrow(windows, kind)
    more = gathered(more, "windows").withColumnRenamed("spans", "windows")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, said in _gathered(batches):
            data, at = raw(b.column("text"))
            _, lo, hi, text, _ = anchors(data, at, length, gram)
            whole, _ = _expand(said, text, len(at) - 1)
            start = [a + (np.frombuffer(x, "<u4") >> 1).astype(np.int64) for a, x in zip(at.tolist(), b.column("windows").to_pylist())]
            start = np.concatenate(start) if start else np.zeros(0, np.int64)
            gone = _marked(data, np.concatenate([lo[whole], start]), np.concatenate([hi[whole] + length - 1, start + length]))
            yield pa.RecordBatch.from_arrays(_columns(b.column("id"), _result(data, at, gone)), ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    again = slim.join(hinted(more.select("id")), "id", "left_semi").join(more, "id").join(spans, "id", "left").select("id", "text", "spans", "windows")
    final = again.mapInArrow(second_pass, f"id long, {RESULT}")
    out = results.join(more.select("id"), "id", "left_anti").unionByName(final)
    return out.withColumnRenamed("id", id_col)
