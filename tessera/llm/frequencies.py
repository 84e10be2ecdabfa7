"""Frequencies of strings in the rows of a batch, and their packed form for the shuffle by hash of the string."""

from __future__ import annotations

import zlib


import numpy as np
import pyarrow as pa


class Frequencies:
    """How often each distinct string occurs in each of `rows` rows. After close(): names; number, owner, freq by (name, row); spread: rows that have each name."""

    def __init__(self, rows: int):
        self.rows = rows
        self._index: dict[str, int] = {}
        self._numbers: list[np.ndarray] = []
        self._owners: list[np.ndarray] = []

    def add(self, strings: list[str], owners: np.ndarray) -> None:
        index = self._index
        for s in dict.fromkeys(strings):
            if s not in index:
                index[s] = len(index)
        self._numbers.append(np.fromiter(map(index.__getitem__, strings), np.int64, len(strings)))
        self._owners.append(owners)

    def close(self) -> None:
        self.names = list(self._index)
        key = np.concatenate([*self._numbers, np.zeros(0, np.int64)]) * self.rows + np.concatenate([*self._owners, np.zeros(0, np.int64)])
        self._index, self._numbers, self._owners = {}, [], []
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.freq = np.diff(np.append(first, len(key)))
        self.number, self.owner = np.divmod(key[first], max(1, self.rows))
        self.spread = np.bincount(self.number, minlength=len(self.names))

    def blobs(self, buckets: int, first_row: int, keep: np.ndarray, weights: np.ndarray | None = None) -> tuple[list[int], list[bytes]]:
        """The names that are kept, with their frequencies, packed by hash of the name. Rows are numbered from first_row."""
        weights = np.zeros(len(self.names), np.int64) if weights is None else weights
        names = np.flatnonzero(keep)
        bucket = np.full(len(self.names), -1)
        bucket[names] = [zlib.crc32(self.names[i].encode("utf-8", "surrogatepass")) % buckets for i in names]
        starts = np.concatenate(([0], np.cumsum(self.spread)))
        order = names[np.argsort(bucket[names], kind="stable")]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        used, out = [], []
        for b in range(buckets):
            own = order[cut[b] : cut[b + 1]]
            if len(own):
                length = self.spread[own]
                at = np.repeat(starts[own] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                used.append(b)
                out.append(pack(first_row, [self.names[i] for i in own], weights[own], length, self.owner[at], self.freq[at]))
        return used, out


def pack(first_row: int, names: list[str], weights: np.ndarray, spread: np.ndarray, owner: np.ndarray, freq: np.ndarray) -> bytes:
    texts = [x.encode("utf-8", "surrogatepass") for x in names]
    parts = [np.array([first_row, len(names), len(owner)], np.int64), np.array([len(x) for x in texts], np.int32), np.asarray(weights, np.int32), np.asarray(spread, np.int32), np.asarray(owner, np.int32), np.asarray(freq, np.int32)]
    # Planes of equal significance compress far better than whole integers.
    planes = b"".join(x.tobytes() if x.dtype == np.int64 else np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() for x in parts)
    raw = planes + b"".join(texts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[int, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first row, names, weights, and of each entry the number of its name, its row from the first on, its frequency."""
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    first, n, m = (int(x) for x in np.frombuffer(raw, np.int64, 3))
    at, out = 24, []
    for size in (n, n, n, m, m):
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view(np.int32).ravel().astype(np.int64))
        at += 4 * size
    lengths, weights, spread, owner, freq = out
    ends = np.cumsum(lengths) + at
    names = [raw[e - k : e].decode("utf-8", "surrogatepass") for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
    return first, names, weights, np.repeat(np.arange(n), spread), owner, freq


