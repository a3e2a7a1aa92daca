"""Token ids by the tokenizers library, with the ids of chunks kept.

word_bpe_49k drops white space and never joins characters across it, so a text's ids are those of its chunks
between white space, one after the other. Each new chunk is encoded by the library once; after that it is a
lookup. A text with U+001C to U+001F, which Python and the tokenizer class differently, is split by pattern.
"""

from __future__ import annotations

import json
import os
import re
import sys
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import LOWER, raw, span_hashes, words

ODD = re.compile("[\x1c-\x1f]")
PLAIN = re.compile(r"[ \t\n\r\x0b\x0c\x85\xa0  -     　]+")
KEPT = 400_000
FULL_STOP = (".", "!", "?", "…", "。", "！", "？")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What a tokenizer file must say for its texts to be encoded chunk by chunk.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TAIL = ".,;:!?"
LETTERS = "a-z\xe0-\xf6\xf8-\xff"
WORD, LATIN = re.compile(f"([{LETTERS}]+)([.,;:!?]*)"), re.compile(f"[{LETTERS}]+")
_TAIL, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_TAIL[list(TAIL.encode())], _LETTER[97:123] = True, True
#: Byte-level models write a byte as the character of its number if that is printable, else as the next one from 256 on.
_SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
LEVEL = {b: chr(b if b in _SEEN else 256 + sum(x not in _SEEN for x in range(b))) for b in range(256)}


class ChunkEncoder:
    """encode(text) gives (ids, ends, stops): all ids, for each chunk how many ids end with it, and whether it ends a sentence.

    Chunks are the text between white space where the file lower-cases, drops white space and cuts words from
    punctuation as word_bpe_49k does; else a text is one chunk. A chunk of an ASCII letter and then punctuation
    is encoded as two parts, and ASCII parts in lower case, so that most new chunks are made of known parts.
    """

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        cut = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        self.fine = (rules.get("normalizer") or {}).get("normalizers") == NORMALIZERS and cut[0].get("pattern") == {"Regex": PIECES} and bool(cut[0].get("invert")) and not rules.get("post_processor")
        self.fine = self.fine and len(cut) == 2 and level.items() <= cut[1].items() and not any(t["content"].isalpha() for t in rules.get("added_tokens") or [])
        self.part: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.start, self.size, self.stop = (np.zeros(0, t) for t in (np.int64, np.int32, bool))
        self.used = 0
        # pieces of columns are known by their hashes alone (ascending), which takes a third of what strings take
        self.seen, self.seen_number = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def parts(self, chunk: str) -> tuple[str, ...]:
        """The chunk's parts; a chunk that holds white space beyond ASCII has several."""
        if not self.fine:
            return (chunk,)
        if not chunk.isascii():
            return tuple(x for c in self.split(chunk) for x in self._cut(c))
        if chunk[-1] not in TAIL:
            return (chunk.lower(),) if not ODD.search(chunk) else tuple(x for c in self.split(chunk) for x in self._cut(c))
        return self._cut(chunk) if not ODD.search(chunk) else tuple(x for c in self.split(chunk) for x in self._cut(c))

    @staticmethod
    def _cut(chunk: str) -> tuple[str, ...]:
        core = chunk.rstrip(TAIL)
        if core and len(core) < len(chunk) and core[-1].isascii() and core[-1].isalpha():
            return (core.lower() if core.isascii() else core), chunk[len(core) :]
        return (chunk.lower() if chunk.isascii() else chunk,)

    def learn(self, chunks: list[str]) -> None:
        """Ids of new chunks, which get the next numbers."""
        # a word of small Latin letters is one piece as it stands, so the model alone gives its ids
        tokens, simple = self.tokenizer.model.tokenize, LATIN.fullmatch if self.fine else lambda c: None
        lists = [tuple([t.id for t in tokens(c if c.isascii() else c.encode("utf-8").decode("latin-1").translate(LEVEL))]) if simple(c) else None for c in chunks]
        rest = [i for i, x in enumerate(lists) if x is None]
        if rest:
            known = self.part
            pairs = [m.groups() if self.fine and (m := WORD.fullmatch(chunks[i].lower())) else self.parts(chunks[i]) for i in rest]
            new = list(dict.fromkeys(x for x in chain.from_iterable(pairs) if x not in known))
            if known and len(known) + len(new) > self.kept // 16:
                known.clear()
                new = list(dict.fromkeys(chain.from_iterable(pairs)))
            known[""] = ()
            for part, code in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                known[part] = tuple(code.ids)
            for i, p in zip(rest, pairs):
                lists[i] = tuple(chain.from_iterable(map(known.__getitem__, p)))
        size = np.fromiter(map(len, lists), np.int32, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.start = np.concatenate([self.start, self.used + np.cumsum(size, dtype=np.int64) - size])
        self.size = np.concatenate([self.size, size])
        self.stop = np.concatenate([self.stop, np.fromiter((c.endswith(FULL_STOP) for c in chunks), bool, len(chunks))])
        self.used += len(ids)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """Each chunk's number. Forgets all chunks first when there are too many, so numbers hold until the next call."""
        found = list(map(self.number.get, chunks))
        if None in found:
            new = list(dict.fromkeys(c for c, i in zip(chunks, found) if i is None))
            if len(self.start) and len(self.start) + len(new) > self.kept:
                self.clear()
                new, found = list(dict.fromkeys(chunks)), [None] * len(chunks)
            n = len(self.start)
            self.learn(new)
            self.number.update(zip(new, range(n, n + len(new))))
            found = [self.number[c] if i is None else i for i, c in zip(found, chunks)]
        return np.array(found, np.int64)

    def numbers_of(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """numbers() of distinct spans of bytes by their hashes, which ascend; only new ones become strings."""
        at = np.searchsorted(self.seen, hashes)
        new = np.append(self.seen, np.uint64(0))[at] != hashes
        new[at == len(self.seen)] = True
        if new.any():
            if len(self.start) and len(self.start) + int(new.sum()) > self.kept:
                self.clear()
                at[:], new[:] = 0, True
            n, view = len(self.start), data.tobytes()
            self.learn([view[i:j].decode("utf-8") for i, j in zip(begin[new].tolist(), stop[new].tolist())])
            self.seen = np.insert(self.seen, at[new], hashes[new])
            self.seen_number = np.insert(self.seen_number, at[new], np.arange(n, len(self.start), dtype=np.int32))
            at += np.cumsum(new) - new
        return self.seen_number[at].astype(np.int64)

    def split(self, text: str) -> list[str]:
        if not self.fine:
            return [text] if text else []
        return [x for x in PLAIN.split(text) if x] if ODD.search(text) else text.split()

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers].astype(np.int64)
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.start[numbers] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers = self.numbers(self.split(text))
        return self.gather(numbers), np.cumsum(self.size[numbers], dtype=np.int64), self.stop[numbers]

    def _pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts of a column, the first piece of each text, and which pieces end a chunk.

        Pieces are the chunks between ASCII white space; those of ASCII only have A-Z lower-cased and punctuation behind
        a letter taken off, as the tokenizer does itself. (It composes accents before it lower-cases.) They are told apart by a 64-bit hash, here and
        as long as they are kept, so that only the column's distinct ones are looked up.
        """
        data, at = raw(column)
        starts, ends, first = words(data, at)
        high = np.maximum.reduceat(data, starts) >= 128 if len(starts) else np.zeros(0, bool)  # only white space lies between words
        as_is = np.zeros(len(data) + 1, np.int8)
        as_is[starts[high]] += 1
        as_is[ends[high]] -= 1
        data = np.where(np.cumsum(as_is[:-1], dtype=np.int8) > 0, data, LOWER[data])
        core = ends.copy()
        more = np.flatnonzero(_TAIL[data[core - 1]]) if len(core) else core
        while len(more):
            core[more] -= 1
            more = more[core[more] > starts[more]]
            more = more[_TAIL[data[core[more] - 1]]]
        two = (core > starts) & (core < ends)
        two &= _LETTER[data[np.maximum(core - 1, 0)]] & ~high
        core[~two] = ends[~two]
        at_ = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(two)[:-1]]) if len(starts) else np.zeros(0, np.int64)
        n = len(starts) + int(two.sum())
        begin, stop, last = np.empty(n, np.int64), np.empty(n, np.int64), np.ones(n, bool)
        begin[at_], stop[at_], last[at_] = starts, core, ~two
        begin[at_[two] + 1], stop[at_[two] + 1] = core[two], ends[two]
        hashes, where, which = np.unique(span_hashes(data, begin, stop), return_index=True, return_inverse=True)
        found = self.numbers_of(hashes, data, begin[where], stop[where])
        return found[which], np.append(at_, n)[first], last

    def encode_column(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """encode() of each text of a column, null being empty; ends and stops are those of chunks between ASCII white space."""
        if not self.fine:
            return [self.encode(t or "") for t in column.to_pylist()]
        numbers, first, last = self._pieces(column)
        ids = self.gather(numbers)
        end = np.concatenate([[0], np.cumsum(self.size[numbers], dtype=np.int64)])
        chunk = np.flatnonzero(last)
        ends, stops = end[chunk + 1], self.stop[numbers[chunk]]
        of = np.searchsorted(chunk, first)
        out = []
        for i, j, a, b in zip(end[first[:-1]].tolist(), end[first[1:]].tolist(), of[:-1].tolist(), of[1:].tolist()):
            out.append((ids[i:j], ends[a:b] - i, stops[a:b]))
        return out

    def count_column(self, column: pa.Array) -> np.ndarray:
        """How many ids each text of a column has, null being empty."""
        if not self.fine:
            return np.array([self.count(t or "") for t in column.to_pylist()], np.int64)
        numbers, first, _ = self._pieces(column)
        total = np.concatenate([[0], np.cumsum(self.size[numbers], dtype=np.int64)])
        return total[first[1:]] - total[first[:-1]]

    def count(self, text: str) -> int:
        numbers = self.numbers(self.split(text))
        return int(self.size[numbers].sum())


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and file; it is kept in sys, since this module's code may arrive anew with each task."""
    held = sys.__dict__.setdefault("_tributary_encoders", {})
    if path not in held:
        held[path] = ChunkEncoder(path)
    return held[path]
