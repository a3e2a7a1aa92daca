"""Packing tokens into sequences by order-preserving dynamic programming.

Documents stay in the order in which their partition holds them. Windows of at most `length` tokens are cut at
ends of documents, ends of sentences, or, dearer, ends of chunks; of all such cuts the sum of padding and
penalties is least. best(j) = cut(j) + length - pos(j) + min over i in reach of (best(i) + pos(i)), and the
minimum over a sliding window comes from a monotone queue.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, trim_memory
from .tokenizing import default_path, encoder

LENGTH, END_ID = 4096, 2
SENTENCE_COST, CHUNK_COST = 12, 48
STRIDE = 16
BATCH_TOKENS = 1 << 20
#: Bytes of text that are encoded at once; results do not depend on it.
SLICE = 1 << 19
SCHEMA = "{id} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose_cuts(pos: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """Indices of pos (ascending, pos[0] = 0) where windows end, least in padding plus cost; the last is always one.

    Neighbouring positions must be at most `length` apart. Each index enters and leaves the queue once.
    """
    p, c = pos.tolist(), (cost + length).tolist()
    n = len(p)
    # key(j) = best(j) + pos(j) = cost(j) + length + the least key in reach; queue[head:tail] has ascending keys
    key, back, queue, head, tail = [0] * n, [0] * n, [0] * (n + 1), 0, 1
    for j in range(1, n):
        reach = p[j] - length
        while p[queue[head]] < reach:
            head += 1
        i = queue[head]
        k = key[j] = c[j] + key[i]
        back[j] = i
        while tail > head and key[queue[tail - 1]] >= k:
            tail -= 1
        queue[tail] = j
        tail += 1
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs one partition's documents; holds at most `batch` tokens and one document."""

    def __init__(self, block: int, length: int, batch: int):
        self.length, self.batch = length, batch
        self.next_id = block << 32
        self.docs: list[list] = []  # id, ids, from where, ends, stops
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> None:
        self.docs.append([doc_id, ids, 0, ends, stops])
        self.held += len(ids)
        if self.held >= self.batch:
            self.pack(False)

    def pack(self, last: bool) -> None:
        if not self.held:
            return
        parts, costs, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, ids, start, ends, stops in self.docs:
            e, s = ends[ends > start] - start, stops[ends > start]
            n = len(ids) - start
            # every sentence's end, and a chunk's end every few tokens, so that there are few candidates
            keep = s.copy()
            if len(e):
                keep |= np.concatenate([[True], (e // STRIDE)[1:] != (e // STRIDE)[:-1]])
            e, s = e[keep & (e < n)], s[keep & (e < n)]
            wide = np.flatnonzero(np.diff(np.concatenate([[0], e, [n]])) > self.length)
            if len(wide):  # a chunk longer than a window can be cut anywhere
                more = np.arange(self.length, n, self.length)
                e, order = np.unique(np.concatenate([e, more]), return_index=True)
                s = np.concatenate([s, np.zeros(len(more), bool)])[order]
            parts += [base + e, np.array([base + n])]
            costs += [np.where(s, SENTENCE_COST, CHUNK_COST), np.zeros(1, np.int64)]
            base += n
        pos, cost = np.concatenate(parts), np.concatenate(costs)
        windows = [int(pos[i]) for i in choose_cuts(pos, cost, self.length)]
        if last:
            begin = windows[-2] if len(windows) > 1 else 0
            windows.pop()
            left = base - begin
            while left:  # the rest in sequences of a power of two each, which need no padding
                size = 1 << (left.bit_length() - 1)
                begin, left = begin + size, left - size
                windows.append(begin)
        elif len(windows) > 1:
            windows.pop()
        self.emit(windows)

    def emit(self, windows: list[int]) -> None:
        begin, base, i = 0, 0, 0
        for end in windows:
            offset = 0
            while begin < end:
                doc = self.docs[i]
                n = min(end - begin, len(doc[1]) - doc[2])
                piece = doc[1][doc[2] : doc[2] + n]
                self.rows.append((doc[0], doc[2], n, zlib.crc32(piece.tobytes()), len(doc[1]), self.next_id, offset))
                doc[2] += n
                offset, begin = offset + n, begin + n
                i += doc[2] == len(doc[1])
            self.next_id += 1
        del base
        self.docs = self.docs[i:]
        self.held = sum(len(d[1]) - d[2] for d in self.docs)


def _pack(path: str, length: int, batch: int, end_id: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, packer = encoder(path), Packer(TaskContext.get().partitionId(), length, batch)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for b in slices(batches, "text", SLICE, encoders=True):
            for doc_id, (ids, ends, stops) in zip(b.column("id").to_pylist(), coder.encode_column(b.column("text"))):
                packer.add(doc_id, np.append(ids, np.uint32(end_id)).astype("<u4"), ends, stops)
            del b, ids, ends, stops  # b holds Spark's whole batch
            if packer.rows:
                yield out()
                trim_memory()
        packer.pack(True)
        if packer.rows:
            yield out()

    return run


def pack_documents(docs: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = END_ID, batch_tokens: int = BATCH_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: where it starts in the document's ids, its length and checksum, its place in a sequence.

    A document's ids are those of its whole text by the tokenizer and then end_id; a null text has only that.
    Ids may be null or repeated: each row is a document of its own. Other columns are ignored; an empty table
    gives no rows. Sequences hold `length` ids at most; the last ids of a partition form sequences of a power
    of two, which are not padded.

    Each partition is packed where it is read: no shuffle, and a task holds batch_tokens and one text.
    """
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return slim.mapInArrow(_pack(path or default_path(), length, batch_tokens, end_id, names), SCHEMA.format(id=id_col))
