"""Token counts that follow edits.

A document's text is held as leaves, runs of pre-tokens of about `LEAF` code points that are cut where white space
follows other characters. No token spans such a place, so a leaf's count depends on the leaf alone. A segment tree
holds sums of leaf counts; sizes and counts of the leaves are kept as a table, from which later edits begin. An edit re-encodes the leaves it touches (with the neighbour, if a cut is no longer at white space) and updates the
sums on their paths; all other leaves stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, list_array, slices
from .tokenizing import default_path, encoder

LEAF = 512
GAP = re.compile(r"(?<=[^ \t\n\r\x0b\x0c])(?=[ \t\n\r\x0b\x0c])")


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    """The text in pieces that begin with white space, except the first, and have `size` code points or reach the next such place."""
    out, i = [], 0
    while len(text) - i > size:
        m = GAP.search(text, i + size)
        if not m:
            break
        out.append(text[i : m.start()])
        i = m.start()
    if i < len(text) or not out:
        out.append(text[i:])
    return out


class TokenTree:
    """A text with its token count, as leaves and a segment tree of sums over them.

    count: the tokens of pieces of text; counts: those of the leaves, if they are known, with the leaves' sizes;
    encoded: code points that were counted so far.
    """

    def __init__(self, text: str, count: Callable[[list[str]], list[int]], size: int = LEAF, sizes: list[int] | None = None, counts: list[int] | None = None):
        self.count, self.size, self.encoded = count, size, 0
        if counts is None:
            self.leaves = leaves_of(text, size)
            counts = self._counts(self.leaves)
        else:
            ends = [*accumulate(sizes)]
            self.leaves = [text[i:j] for i, j in zip([0, *ends], ends)]
        self._build(counts)

    def _counts(self, leaves: list[str]) -> list[int]:
        self.encoded += sum(map(len, leaves))
        return self.count(leaves)

    def leaf_counts(self) -> list[int]:
        return self.tokens[self.n : self.n + len(self.leaves)]

    def _build(self, counts: list[int]) -> None:
        n = 1 << max(0, (len(counts) - 1).bit_length())
        pad = [0] * (n - len(counts))
        self.n = n
        self.tokens = [0] * n + counts + pad
        self.chars = [0] * n + [len(x) for x in self.leaves] + pad
        for i in range(n - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def __len__(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point `at` (the last leaf for the end) and where that leaf begins."""
        if at >= self.chars[1]:
            last = len(self.leaves) - 1
            return last, self.chars[1] - len(self.leaves[last])
        i, begin = 1, 0
        while i < self.n:
            i *= 2
            if at - begin >= self.chars[i]:
                begin += self.chars[i]
                i += 1
        return i - self.n, begin

    def touched(self, start: int, length: int, new: str) -> tuple[int, int, list[str]]:
        """Leaves a to b that an edit changes, and the leaves that take their place. start and length are cut to the text."""
        start = max(0, min(start, len(self)))
        end = max(start, min(start + length, len(self)))
        a, begin = self.find(start)
        b, begin_b = self.find(max(start, end - 1)) if end > start else (a, begin)
        text = self.leaves[a][: start - begin] + new + self.leaves[b][end - begin_b :]
        # cuts on either side must still lie between other characters and white space
        while a > 0 and not (text and GAP.match(self.leaves[a - 1][-1:] + text[:1], 1)):
            a -= 1
            text = self.leaves[a] + text
        while b + 1 < len(self.leaves) and not (text and GAP.match(text[-1:] + self.leaves[b + 1][:1], 1)):
            b += 1
            text += self.leaves[b]
        return a, b, leaves_of(text, self.size) if text or len(self.leaves) == b + 1 - a else []

    def put(self, a: int, b: int, fresh: list[str], counts: list[int]) -> None:
        """Puts leaves and their counts in place of leaves a to b; all others keep theirs."""
        self.encoded += sum(map(len, fresh))
        self.leaves[a : b + 1] = fresh
        if len(fresh) == b + 1 - a:
            for i, (leaf, c) in enumerate(zip(fresh, counts), a + self.n):
                self.tokens[i], self.chars[i] = c, len(leaf)
                while i > 1:
                    i //= 2
                    self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
                    self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        else:  # leaves came or went: only sums are built anew
            old = self.tokens[self.n : self.n + len(self.leaves) - len(fresh) + b + 1 - a]
            self._build(old[:a] + counts + old[b + 1 :])

    def replace(self, start: int, length: int, new: str) -> None:
        """Puts new in place of `length` code points from start; both are cut to the text."""
        a, b, fresh = self.touched(start, length, new)
        self.put(a, b, fresh, self.count(fresh))


def standard_edits(text: str) -> list[tuple[int, int, str]]:
    """The query's edits, by code points: ten go at a fifth, a word comes in at the middle, the last five become a full stop."""
    n = len(text)
    return [(n // 5, 10, ""), (n // 2, 0, " edited "), (max(0, n - 5), 5, ".")]


def _counter(path: str) -> Callable[[list[str]], list[int]]:
    coder = encoder(path)
    return lambda leaves: coder.count_column(pa.array(leaves, pa.large_string())).tolist()


STATE = "id long, text string, sizes array<int>, counts array<int>"


def token_state(docs: DataFrame, path: str | None = None, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """Each document's text with the sizes of its leaves in code points and their token counts: what later edits begin from.

    A null text is empty; ids may be null or repeated; other columns are ignored; an empty table gives no rows.
    Keep it as a table; `edit_tokens` takes it and gives the state after the edits. edits_col: a column that goes along, as
    `edits`.
    """
    path = path or default_path()
    more = [docs[edits_col].alias("edits")] if edits_col else []
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for b in slices(batches, "text", encoders=True):
            texts = [t or "" for t in b.column("text").to_pylist()]
            leaves = [leaves_of(t, leaf) for t in texts]
            counts, at = count([x for each in leaves for x in each]), np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
            sizes = pa.array([len(x) for each in leaves for x in each], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts), list_array(sizes, at), list_array(pa.array(counts, pa.int32()), at), *b.columns[2:]], ["id", "text", "sizes", "counts", *b.schema.names[2:]])

    return slim.mapInArrow(run, STATE + "".join(f", edits {f.dataType.simpleString()}" for f in slim.schema.fields[2:]))


def _edits(column: pa.Array | None, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Each row's edits; fields are told by their names, or by their order where the names are other ones."""
    if column is None:
        return [standard_edits(t) for t in texts]
    out = []
    for row in column.to_pylist():
        found = []
        for e in row or []:
            if e is not None:
                start, length, new = (e[k] for k in ("start", "length", "new")) if {"start", "length", "new"} <= e.keys() else e.values()
                found.append((start or 0, length or 0, new or ""))
        out.append(found)
    return out


def edit_tokens(state: DataFrame, edits_col: str | None = None, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """State rows after their edits, with figures of them.

    state: as `token_state` gives it, with the edits in a column: an array of struct(start, length, new), in code points,
    applied one after the other to the text as it then is; null is no edit, and parts beyond the text are cut off.
    Without edits_col, `standard_edits`. Only leaves that an edit touches are counted again. Adds n_tokens and n_leaves
    (before), edited_tokens, edited_chars, encoded_chars (those of the text before) and again_chars (code points counted again).
    """
    path = path or default_path()
    kind = f"{STATE}, n_tokens long, n_leaves long, edited_tokens long, edited_chars long, encoded_chars long, again_chars long"
    slim = state.select("id", "text", "sizes", "counts", *([F.col(edits_col).alias("edits")] if edits_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for b in slices(batches, "text", encoders=True):
            texts = [t or "" for t in b.column("text").to_pylist()]
            trees = [TokenTree(t, count, leaf, s, c) for t, s, c in zip(texts, b.column("sizes").to_pylist(), b.column("counts").to_pylist())]
            before = [(t.total(), len(t.leaves)) for t in trees]
            edits = _edits(b.column("edits") if edits_col else None, texts)
            for k in range(max(map(len, edits), default=0)):  # the k-th edit of all rows, so that leaves are counted together
                at = [(t, *t.touched(*e[k])) for t, e in zip(trees, edits) if k < len(e)]
                counts, i = count([x for *_, fresh in at for x in fresh]), 0
                for tree, x, y, fresh in at:
                    tree.put(x, y, fresh, counts[i : i + len(fresh)])
                    i += len(fresh)
            ends = np.concatenate([[0], np.cumsum([len(t.leaves) for t in trees])])
            sizes, counts = pa.array([len(x) for t in trees for x in t.leaves], pa.int32()), pa.array([c for t in trees for c in t.leaf_counts()], pa.int32())
            figures = [(*n, t.total(), len(t), len(text), t.encoded) for n, t, text in zip(before, trees, texts)]
            names = ["id", "text", "sizes", "counts", "n_tokens", "n_leaves", "edited_tokens", "edited_chars", "encoded_chars", "again_chars"]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([t.text() for t in trees]), list_array(sizes, ends), list_array(counts, ends), *[pa.array(c, pa.int64()) for c in zip(*figures)]], names)

    return slim.mapInArrow(run, kind)


def count_tokens(docs: DataFrame, edits_col: str | None = None, path: str | None = None, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text before and after edits: the state is made and kept as a table, and the edits begin from that.

    edits_col and the edits are those of `edit_tokens`. Returns id, n_tokens, n_leaves, edited_tokens, edited_chars,
    encoded_chars (counted at first) and again_chars (counted again for the edits). A null text is empty; ids may be
    null or repeated; other columns are ignored; an empty table gives no rows. There is no shuffle.
    """
    ws = Workspace(docs.sparkSession, "tokens")
    state = ws.keep(token_state(docs, path, leaf, id_col, text_col, edits_col), "state")
    done = edit_tokens(state, "edits" if edits_col else None, path, leaf)
    return done.select(F.col("id").alias(id_col), "n_tokens", "n_leaves", "edited_tokens", "edited_chars", "encoded_chars", "again_chars")
