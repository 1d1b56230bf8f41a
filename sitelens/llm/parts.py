"""Texts as parts between places where byte-level BPE's pre-tokeniser always splits, encoded once for each distinct part.

A part begins before a space that a character other than white space follows, before a newline after a printable ASCII
character, after a newline that stands alone, and where an ASCII letter is followed by other printable ASCII. No word of
the pre-tokeniser crosses such a place, and no word before it depends on what follows, so parts are encoded on their own.
Splitting, finding the distinct parts and joining their values run over whole Arrow chunks.

Memory: a chunk (a longer text is a chunk of its own) and two generations of values, ``kept`` bytes each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .words import chunks

#: Bytes of a chunk, unless an operator asks for others, and of a part and its value together; parts longer than LONG_PART are not kept.
CHUNK_BYTES, LONG_PART = 1 << 20, 1 << 8
ENTRY_BYTES = 240

_GRAPH = np.zeros(256, dtype=bool)
_GRAPH[0x21:0x7F] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
#: First bytes of characters that are certainly no white space: printable ASCII, U+00C0 to U+07FF, from U+4000.
_SOLID = _GRAPH.copy()
_SOLID[0xC3:0xE0] = _SOLID[0xE4:0xF5] = True


def starts(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Where parts begin in the bytes of rows; whole: rows that are one part each."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    graph, solid, newline = _GRAPH[data], _SOLID[data], data == 0x0A
    cut = np.zeros(n, dtype=bool)
    cut[:-1] = (data[:-1] == 0x20) & solid[1:]
    cut[1:] |= newline[1:] & graph[:-1]
    cut[1:] |= _LETTER[data[:-1]] & graph[1:] & ~_LETTER[data[1:]]
    cut[2:] |= solid[2:] & newline[1:-1] & graph[:-2]
    begins = offsets[:-1][np.diff(offsets) > 0]
    cut[begins[1:] - 1] &= data[begins[1:] - 1] != 0x20  # the space that ends a row is no space before the next row
    cut[begins] = True
    after = begins + 1
    after = after[after < n]
    cut[after] |= newline[after - 1] & solid[after]  # a row's first newline stands alone as well
    if whole is not None and whole.any():
        row = np.repeat(whole, np.diff(offsets))
        cut &= ~row
        cut[offsets[:-1][whole]] = True
    return np.flatnonzero(cut)


def joined(values: pa.Array, places: pa.Array, first: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """Values taken in the order of places, as one run of bytes, and where in it the rows begin whose first places are given."""
    taken = values.take(places)
    _, where, raw = taken.buffers()
    sizes = np.frombuffer(where, dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    return sizes[first], memoryview(raw) if raw is not None else memoryview(b"")


class Parts:
    """Values of parts, byte strings made once by ``make(list of new parts)``."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], special: list[bytes], kept: int, chunk: int = CHUNK_BYTES) -> None:
        self.kept, self.chunk = kept, chunk
        self.make, self.special = make, [s for s in special if s]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def values(self, parts: list[bytes]) -> list[bytes]:
        """Values of distinct parts, in order."""
        if self.held > self.kept:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        out = list(map(young.get, parts))
        missing = [i for i, v in enumerate(out) if v is None]
        if old and missing:
            for i in missing:
                out[i] = old.get(parts[i])
            missing = [i for i in missing if out[i] is None]
        if missing:
            for i, v in zip(missing, self.make([parts[i] for i in missing]), strict=True):
                out[i] = v
        size = len(young)
        young.update(zip(parts, out, strict=True))
        self.held += (len(young) - size) * ENTRY_BYTES
        if max(map(len, parts), default=0) > LONG_PART:
            for p in parts:
                if len(p) > LONG_PART:
                    young.pop(p, None)
        return out

    def rows(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, memoryview]]:
        """Yields (first row, byte offsets of the rows' joined values, the values) for runs of rows."""
        for lo, _, data, offsets in chunks(texts, self.chunk):
            at = starts(data, offsets, self._whole(data, offsets))
            first = np.searchsorted(at, offsets, side="left")
            ends = np.append(at, len(data)).astype(np.int64)
            array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
            coded = array.dictionary_encode()
            yield lo, *joined(pa.array(self.values(coded.dictionary.to_pylist()), pa.large_binary()), coded.indices, first)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray | None:
        """Rows with a special token's string."""
        raw, found = None, []
        for s in self.special:
            raw = data.tobytes() if raw is None else raw
            place = raw.find(s)
            while place >= 0:
                row = int(np.searchsorted(offsets, place, side="right")) - 1
                if place + len(s) <= offsets[row + 1]:
                    found.append(row)
                    place = raw.find(s, int(offsets[row + 1]))
                else:
                    place = raw.find(s, place + 1)
        if not found:
            return None
        mask = np.zeros(len(offsets) - 1, dtype=bool)
        mask[found] = True
        return mask
