"""Words, windows and sorted streams as numpy and Arrow arrays, for operators whose work is in Python."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of a text whose words are Python objects at one time.
BLOCK = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Give back what Python has freed: workers are used again, and would else hold the most that any step needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text. ``bytes.split`` cuts at ASCII white space, as words are defined."""
    out, at = [], 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and not WHITE[data[end]]:
            end += 1
        words = data[at:end].split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` consecutive words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = h[:m].copy()
    for k in range(1, n):
        total *= _ODD
        total += h[k : k + m]
    return mixed(total)


def sliding_min(g: np.ndarray, n: int) -> np.ndarray:
    """Least of each ``n`` consecutive values, by doubling."""
    have, low = 1, g
    while have < n:
        step = min(have, n - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def keep_words(data: bytes, gone: np.ndarray) -> str:
    """The words that are not ``gone``, joined by one space."""
    raw = np.frombuffer(data, np.uint8)
    white = WHITE[raw]
    first = ~white
    first[1:] &= white[:-1]
    word = np.cumsum(first) - 1
    stop = white.copy()
    stop[:1] = False
    stop[1:] &= ~white[:-1]
    kept = ~white | stop
    kept &= word >= 0
    kept[kept] = ~gone[word[kept]]
    return np.where(white, np.uint8(32), raw)[kept].tobytes().removesuffix(b" ").decode()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of ``key`` from batches in which equal keys follow each other."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch[key].to_numpy()
        if pending and pending[-1][key][pending[-1].num_rows - 1].as_py() != k[0]:
            yield pa.Table.from_batches(pending)
            pending = []
        change = np.flatnonzero(k[1:] != k[:-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*pending, batch.slice(0, cut)])
            pending, batch = [], batch.slice(cut)
        pending.append(batch)
    if pending:
        yield pa.Table.from_batches(pending)


def groups(table: pa.Table, key: str) -> Iterator[pa.Table]:
    """The groups of a table in which equal keys follow each other."""
    k = table[key].to_numpy()
    edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield table.slice(a, b - a)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member reachable from each of ``n`` by the links a[i] - b[i]."""
    parent = list(range(n))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        parent[max(x, y)] = min(x, y)
    for x in range(n):
        parent[x] = parent[parent[x]]
    return np.array(parent)
