"""Fast subword ids: each distinct blank-led chunk of a text is encoded once and looked up after that.

Both public vocabularies used here split text before any blank that follows a non-blank, and between a letter and
a mark, so the ids of a text are the ids of its chunks put together. Chunks are cut only before an ASCII blank
(never after a multi-byte sequence that may be a Unicode blank) or before an ASCII mark that follows a letter, so
the split is safe for any input.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from tidemark.llm.common import ranges, utf8

#: Distinct chunks kept in a worker; the frequent ones come first, and what comes later is encoded each time.
CACHE = 200_000


BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
#: First bytes of Unicode blanks.
LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: Marks that always start an id after a letter; none of them is in a special token or a contraction.
MARK = np.isin(np.arange(256), [ord(c) for c in '.,;:!?"()[]{}&%$#*=/+-@^~`\\_'])
_plain = re.compile(r"[ \t\n\v\f\r]+[!-;=?-~\xc0-\xff]+").fullmatch


def joinable(chunk: str) -> bool:
    """Whether a chunk starts with an ASCII blank and keeps its length under lower-casing and normalising."""
    return _plain(chunk) is not None


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Subwords:
    """Encoder of whole text columns with one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)  # of the kept chunks, put together
        self.start = np.zeros(CACHE, np.int64)
        self.size = np.zeros(CACHE, np.int64)
        self.used = 0
        self._sizes()

    def _sizes(self) -> None:
        """Bytes of text behind each id, and whether blanks have none."""
        model = json.loads(self.tok.to_str())["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.bytes = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), np.int64)
        for t, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = len(t) - (len(self.end) if self.end and t.endswith(self.end) else 0)

    def _singly(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.encode(chunks, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int64, len(got))

    def _jointly(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _singly, by one call for many plain chunks: their ends are found by the bytes behind the ids."""
        ids = np.array(self.encode(["".join(chunks)], add_special_tokens=False)[0].ids, np.int32)
        want = np.cumsum([len(c.strip(" \t\n\v\f\r").encode()) if self.end else len(c.encode()) for c in chunks])
        have = np.cumsum(self.bytes[ids])
        at = np.searchsorted(have, want)
        if not len(have) or have[-1] != want[-1] or (have[np.minimum(at, len(have) - 1)] != want).any():
            return self._singly(chunks)
        return ids, np.diff(at + 1, prepend=0)

    def _encoded(self, chunks: list[str], joined: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids put together, and how many each chunk has; the first `joined` chunks can be joined."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for part, call, k in ((chunks[:joined], self._jointly, 256), (chunks[joined:], self._singly, 8192)):
            for lo in range(0, len(part), k):
                got = call(part[lo : lo + k])
                ids.append(got[0])
                sizes.append(got[1])
        return np.concatenate(ids), np.concatenate(sizes)

    @staticmethod
    def chunk_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        blank = BLANK[data]
        cut = np.zeros(len(data), bool)
        if len(data) > 1:
            before = data[:-1]
            # the last character may be a Unicode blank if one of the two bytes before its last is one of these
            risky = np.zeros(len(before), bool)
            risky[1:] |= LEAD[before[:-1]]
            risky[2:] |= LEAD[before[:-2]]
            safe = (before > 0x20) & (before != 0x7F) & ~((before >= 0x80) & risky)
            cut[1:] = blank[1:] & ~blank[:-1] & safe
            letter = LETTER[before]
            letter[1:] |= (before[:-1] == 0xC3) & (before[1:] >= 0x80) & (before[1:] != 0x97) & (before[1:] != 0xB7)
            cut[1:] |= MARK[data[1:]] & letter
        cut[offs[:-1][offs[:-1] < offs[1:]]] = True
        return np.flatnonzero(cut)

    def column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows put together, and the offsets of the rows."""
        data, offs = utf8(col)
        ids, starts, total = self.encoded(data, offs)
        return ids, total[np.searchsorted(starts, offs)]

    def encoded(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of rows given as bytes, the starts of their chunks, and the ids before each chunk and in all."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64)
        starts = self.chunk_starts(data, offs)
        edge = np.append(starts, len(data)).astype(np.int64)
        d = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(edge), pa.py_buffer(data)]).dictionary_encode()
        codes = d.indices.to_numpy(zero_copy_only=False)
        start, size = self.looked_up(d.dictionary.to_pylist())
        n = size[codes]
        return self.ids[ranges(start[codes], n)], starts, np.concatenate([[0], np.cumsum(n)])

    def looked_up(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct chunks lie in `self.ids`, and how many they are; valid until the next call."""
        where = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(where < 0)
        new = [distinct[i] for i in missing]
        joins = np.fromiter(map(joinable, new), bool, len(new))
        missing = np.concatenate([missing[joins], missing[~joins]])
        flat, sizes = self._encoded([distinct[i] for i in missing], int(joins.sum()))
        first = self.used + np.cumsum(sizes) - sizes
        start, size = self.start[where], self.size[where]
        start[missing], size[missing] = first, sizes
        if (more := self.used + len(flat)) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(more, np.int32)])
        self.ids[self.used : more] = flat
        if (k := min(len(missing), CACHE - len(self.at))) > 0:  # what is past these is written over next time
            have = len(self.at)
            self.start[have : have + k], self.size[have : have + k] = first[:k], sizes[:k]
            self.at.update(zip((distinct[i] for i in missing[:k]), range(have, have + k), strict=True))
            self.used += int(sizes[:k].sum())
        return start, size


_open: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    """The encoder of this process for a vocabulary file."""
    if path not in _open:
        _open[path] = Subwords(path)
    return _open[path]
