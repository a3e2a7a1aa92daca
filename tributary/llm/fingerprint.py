"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases into longer ones, and so on. Runs of one symbol are one
symbol; then deterministic coin tossing (Cole and Vishkin) reduces symbols to a few labels that differ between
neighbours, and each local maximum of the labels begins a phrase. Where a phrase begins depends on a few symbols
on either side only, so equal substrings get equal phrases inside, whatever their offset. A fingerprint has the
name of the whole text and a bottom-k sketch of the names of two levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, mix, raw, slices

K = 64
LEVELS = (2, 3)
ROUNDS = 4
#: Rows of a range: the fewest and the most that are aimed at; between them there are RANGES ranges.
ROWS_PER_RANGE, MOST_ROWS, RANGES = 2000, 20_000, 10_000
_LOWEST = np.array([8] + [(i & -i).bit_length() - 1 for i in range(1, 256)], np.uint8)
_WEIGHT = mix(np.arange(77, 77 + 64, dtype=U)) | U(1)


def _labels(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Labels below 8 of symbols that differ from their neighbours; the first symbol of a text is tossed against 0."""
    first = at[:-1][at[:-1] < at[1:]]
    if x.dtype != np.uint8:
        d = np.empty_like(x)
        d[0], d[1:] = x[0], x[1:] ^ x[:-1]
        d[first] = x[first]
        pos = np.bitwise_count((d & (~d + U(1))) - U(1)).astype(np.uint8) & np.uint8(63)
        x = (pos << np.uint8(1)) | ((x >> pos.astype(U)) & U(1)).astype(np.uint8)
        rounds = ROUNDS - 1
    else:
        rounds = ROUNDS
    for _ in range(rounds):
        d = np.empty_like(x)
        d[0], d[1:] = x[0], x[1:] ^ x[:-1]
        d[first] = x[first]
        pos = _LOWEST[d]
        x = (pos << np.uint8(1)) | ((x >> (pos & np.uint8(7))) & np.uint8(1))
    return x


def parse_level(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: symbols and their offsets by text to the names of phrases and their offsets by text."""
    n = len(x)
    if not n:
        return np.zeros(0, U), at
    full = at[:-1][at[:-1] < at[1:]]
    new = np.empty(n, bool)
    new[0], new[1:] = True, x[1:] != x[:-1]
    new[full] = True
    starts = np.flatnonzero(new)
    if len(starts) < n:
        run = np.diff(np.append(starts, n))
        x = x[starts]
        value = x.astype(U) + run.astype(U) * U(0x9E3779B97F4A7C15)
        at = np.searchsorted(starts, at)
        n = len(x)
        full = at[:-1][at[:-1] < at[1:]]
    else:
        value = x.astype(U) + U(0x9E3779B97F4A7C15)
    label = _labels(x, at)
    begin = np.zeros(n, bool)
    begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    begin[full] = True
    ends = at[1:][at[:-1] < at[1:]] - 1
    begin[ends[ends > 0]] &= np.isin(ends[ends > 0], full, assume_unique=True)  # a last symbol stays with its phrase
    starts = np.flatnonzero(begin)
    size = np.diff(np.append(starts, n))
    inside = np.arange(n) - np.repeat(starts, size)
    names = mix(np.add.reduceat(mix(value) * _WEIGHT[inside & 63], starts) + size.astype(U))
    return names, np.searchsorted(starts, at)


def parse(data: np.ndarray, at: np.ndarray, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The name of each text (0 for an empty one) and, for each asked level, all phrase names with offsets by text."""
    root, kept, level, x = np.zeros(len(at) - 1, U), [], 0, data
    while True:
        x, at = parse_level(x, at)
        level += 1
        if level in levels:
            kept.append((mix(x + U(level)), at))
        size = np.diff(at)
        done = (size == 1) & (root == 0)
        root[done] = mix(x[at[:-1][done]] + U(level))
        if level >= max(levels) and not (size > 1).any():
            return root, kept
        if (size <= 1).any():  # what is done doesn't go on to the next level
            go = np.repeat(size > 1, size)
            if level >= max(levels):
                x, at = x[go], np.concatenate([[0], np.cumsum(np.where(size > 1, size, 0))])


def fingerprints(texts: list[bytes] | pa.Array, k: int = K) -> tuple[list[str], list[np.ndarray]]:
    """Each text's fingerprint and its sketch: 16 hexadecimal digits of its name, and 8 for each of the k smallest names."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary())
    data, at = raw(column)
    root, kept = parse(data, at)
    out, sketches = [], []
    small = [((x >> U(32)).astype(np.uint32), a) for x, a in kept]
    for i, name in enumerate(root.tolist()):
        s = np.unique(np.concatenate([x[a[i] : a[i + 1]] for x, a in small]))[:k]
        sketches.append(s)
        out.append(f"{name:016x}" + s.astype(">u4").tobytes().hex())
    return out, sketches


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of phrases in common, from two sketches; exact if both texts have few phrases."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.unique(np.concatenate([a, b]))[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def sketch_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint[16:]), ">u4")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of each whole text. A null text is empty; ids may be null or repeated; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fingerprints(b.column("text"))[0])], [id_col, "fingerprint"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"{id_col} long, fingerprint string")


def _dealt(splits: np.ndarray, tails: dict[int, list[int]]):
    """Rows to rows with their range, and the first row of each range once more for the range before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(splits)
        for b in batches:
            ids = b.column("id").to_pylist()
            part = np.array([last if i is None else int(np.searchsorted(splits, i, "right")) for i in ids], np.int32)
            again = [(j, p) for j, i in enumerate(ids) for p in tails.get(i, ())]
            rows = pa.array(list(range(len(ids))) + [j for j, _ in again], pa.int64())
            flag = pa.array([0] * len(ids) + [1] * len(again), pa.int32())
            part = pa.array(part.tolist() + [p for _, p in again], pa.int32())
            yield pa.RecordBatch.from_arrays([part, flag, b.column("id").take(rows), b.column("text").take(rows)], ["part", "tail", "id", "text"])

    return run


def _compare(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which waits for its next one
        for b in slices(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            prints, sketches = fingerprints(b.column("text"))
            rows = list(zip(b.column("part").to_pylist(), b.column("tail").to_pylist(), b.column("id").to_pylist(), texts, prints, sketches))
            if held is not None:
                rows.insert(0, held)
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and not x[1]]
            held = rows[-1]
            edited = []
            for x, y in pairs:
                n = len(x[3])
                q = n // 4
                edited.append((x[3][: n - q] + y[3][:q]).encode("utf-8", "surrogatepass"))
            new, changed = fingerprints(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                    pa.array([x[4] for x, _ in pairs], pa.string()), pa.array(new, pa.string()),
                    pa.array([likeness(x[5], s) for (x, _), s in zip(pairs, changed)], pa.float64()), pa.array([likeness(x[5], y[5]) for x, y in pairs], pa.float64()),
                ],
                names,
            )

    return run


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against an edited text and against the next document, in ascending order of id.

    The edited text has its last floor(n / 4) code points replaced by as many of the next document's first ones
    (or all it has). After the last document comes the first. Null texts are empty, null ids come last, and rows
    with one id are in order of their text's checksum; a single row is its own next. Other columns are ignored;
    an empty table gives no rows.

    Ids are cut into ranges of some thousand rows by approximate quantiles. A range is sorted in one task, which
    streams it; the first row of each range goes to the range before it as well. The driver holds one split
    point for each range.
    """
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    n = slim.count()
    ranges = max(1, -(-n // min(MOST_ROWS, max(ROWS_PER_RANGE, n // RANGES))))
    splits = np.zeros(0, np.int64)
    if ranges > 1:
        got = slim.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], max(4 * ranges, 20 * min(ranges, RANGES)))).first()[0]
        splits = np.unique(np.array(got or [], np.int64))
    last = len(splits)
    # the smallest id of each range: one row each
    firsts = {}
    if last:
        found = slim.select("id").where("id is not null").mapInArrow(lambda it: _first_ids(it, splits), "p int, id long").groupBy("p").agg(F.min("id").alias("id")).collect()
        firsts = {r["p"]: r["id"] for r in found}
        if last not in firsts and not slim.where("id is null").isEmpty():
            firsts[last] = None
    tails: dict = {}
    if firsts:
        order = sorted(firsts)
        for p, nxt in zip(order, [*order[1:], order[0]]):
            tails.setdefault(firsts[nxt], []).append(p)
    else:
        low = slim.agg(F.min("id")).first()[0] if n else None
        tails[low] = [0]
    dealt = slim.mapInArrow(_dealt(splits, tails), "part int, tail int, id long, text string")
    sorted_ = dealt.repartition(max(1, last + 1), "part").sortWithinPartitions("part", "tail", F.col("id").asc_nulls_last(), F.crc32(F.encode("text", "UTF-8")))
    return sorted_.mapInArrow(_compare(names), kind)


def _first_ids(batches: Iterator[pa.RecordBatch], splits: np.ndarray) -> Iterator[pa.RecordBatch]:
    least: dict[int, int] = {}
    for b in batches:
        ids = b.column("id").to_numpy()
        part = np.searchsorted(splits, ids, "right")
        order = np.lexsort((ids, part))
        p, i = part[order], ids[order]
        for a, z in zip(*(x[np.concatenate([[True], p[1:] != p[:-1]])].tolist() if len(p) else [] for x in (p, i))):
            least[a] = min(z, least.get(a, z))
    yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64())], ["p", "id"])
