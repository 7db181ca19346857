"""What several operators share: size-checked joins and vectorised word hashing.

Words are runs of bytes outside 0x20 and 0x09-0x0D. Hashing works on Arrow's own buffers:
a polynomial over a fixed 64-bit value for each byte, modulo 2**64, taken from prefix sums, so
no Python object is made for a word. Equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are hashed at once; longer texts are hashed in pieces and stay whole.
GROUP_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or len(_tables["p"]) < n:
        size = max(n, GROUP_BYTES + (1 << 16))
        _tables["p"], _tables["q"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables["p"], _tables["q"]


@dataclass
class TextGroup:
    """Some whole texts of a batch: rows first..first+n, their bytes, and each text's bounds in them."""

    first: int
    data: np.ndarray
    bounds: np.ndarray  # n + 1 byte offsets

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


@dataclass
class WordGroup:
    """The words of a TextGroup: row within the group, hash, byte offsets in the group's data."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray


def text_groups(column: pa.Array | pa.ChunkedArray, limit: int = GROUP_BYTES) -> Iterator[TextGroup]:
    """Cut a string column into groups of whole texts of about limit bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = min(to, n)
        yield TextGroup(at, raw[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


def words(g: TextGroup, lower: bool = False) -> WordGroup:
    """All words of the group's texts with their hashes."""
    size = len(g.data)
    if not size:
        e = np.zeros(0, np.int64)
        return WordGroup(e, np.zeros(0, np.uint64), e, e)
    if size <= GROUP_BYTES * 2:
        cuts = [0, size]
    else:  # one long text: pieces end at white space, so no word is cut
        cuts, at = [0], 0
        while at < size:
            to = min(size, at + GROUP_BYTES)
            while to < size and not SPACE[g.data[to]]:
                more = np.flatnonzero(SPACE[g.data[to : to + GROUP_BYTES]])
                to = to + int(more[0]) if len(more) else min(size, to + GROUP_BYTES)
            cuts.append(to)
            at = to
    parts = [_words(g.data[a:b], g.bounds - a, a, lower) for a, b in zip(cuts, cuts[1:], strict=False)]
    start, end, h = (np.concatenate([p[i] for p in parts]) if len(parts) > 1 else parts[0][i] for i in range(3))
    doc = np.searchsorted(g.bounds, start, "right") - 1
    return WordGroup(doc, h, start, end)


def _words(data: np.ndarray, bounds: np.ndarray, shift: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds[(bounds >= 0) & (bounds <= len(data))]] = True
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    h = span_hashes(LOWER[data] if lower else data, start, end)
    return start + shift, end + shift, h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans of data; equal spans have equal hashes."""
    p, q = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTE_VALUE[data] * p[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingles(w: WordGroup, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside one text, and the row of each; texts shorter than k words have none."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h = h * _BASE + w.hash[i : n - k + 1 + i]
    inside = w.doc[k - 1 :] == w.doc[: n - k + 1]
    return mix(h[inside]), w.doc[: n - k + 1][inside]


def bounded_broadcast(small: DataFrame, limit: int) -> DataFrame:
    """Mark small for broadcast if it has at most limit rows; beyond that Spark shuffles it as any table."""
    return F.broadcast(small) if small.count() <= limit else small


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column of taken clashes with, without regard to case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
