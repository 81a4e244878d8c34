"""Kernel of the fuzzy name join: pairs of names within a block or between two, by signatures and then by the common subsequence."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from weft.functions.similarity import common_length
from weft.operators.lexical import pack, unpack


def name_blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(g, names): blocks of names (norm), each name in one of so many parts."""
    for b in batches:
        if b.num_rows:
            g = np.array([zlib.crc32(x.encode()) % parts for x in b["norm"].to_pylist()], np.int32)
            some = [(i, pa.table({"norm": b["norm"].filter(pa.array(g == i))})) for i in np.unique(g).tolist()]
            yield pa.RecordBatch.from_pydict({"g": pa.array([i for i, _ in some], pa.int32()), "names": [pack(x) for _, x in some]})


class Names:
    """Names by length, their letters as numbers, and signatures.

    A signature has a bit for each letter and how often it came so far, several sharing one by parity: an insertion or deletion turns one bit, so names differ
    in no more bits than they are insertions and deletions apart.
    """

    def __init__(self, names: list[str]) -> None:
        self.names = names = sorted(names, key=lambda x: (len(x), x))
        self.n = np.array([len(x) for x in names], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.letters = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        key = np.repeat(np.arange(len(names)), self.n) << 21 | self.letters
        key.sort()
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.arange(len(key)) - np.repeat(fresh, np.diff([*fresh, len(key)])) + 1
        bits = np.uint64(1) << ((key & 0x1FFFFF) + 27 * times & 63).astype(np.uint64)
        self.sign = np.bitwise_xor.reduceat(bits, self.start)

    def coded(self, known: np.ndarray, most: int) -> np.ndarray:
        """A row of places in known for each name of up to most letters; len(known) for letters that aren't there and behind the end."""
        at = np.minimum(np.searchsorted(known, self.letters), len(known) - 1)
        at = np.where(known[at] == self.letters, at, len(known)).astype(np.int32)
        out = np.full((len(self.n), min(most, int(self.n[-1]))), len(known), np.int32)
        place = np.arange(len(at)) - np.repeat(self.start, self.n)
        ok = place < out.shape[1]
        out[np.repeat(np.arange(len(self.n)), self.n)[ok], place[ok]] = at[ok]
        return out


def common_lengths(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, who: np.ndarray, other: np.ndarray, n_letters: int) -> np.ndarray:
    """common_length() of rows who of a, of up to 64 letters, and rows other of b."""
    place = np.zeros((len(a), n_letters + 1), np.uint64)
    for i in range(a.shape[1]):
        place[np.arange(len(a)), a[:, i]] |= np.uint64(1) << np.uint64(i)
    place[:, n_letters] = 0
    full = np.array([(1 << int(x)) - 1 for x in n_a], np.uint64)[who]
    row, letters = full.copy(), b[other]
    for i in range(b.shape[1]):
        hit = row & place[who, letters[:, i]]
        row = (row + hit | row - hit) & full
    return n_a[who] - np.bitwise_count(row).astype(np.int64)


def near_names(left: list[str], right: list[str] | None, least: float) -> pa.Table:
    """(x, y, ratio), x < y: pairs of left and right, or of left alone, whose common-subsequence ratio is at least that."""
    out: list[tuple[str, str, float]] = []
    if left and (right is None or right):
        a = Names(left)
        b = a if right is None else Names(right)
        known = np.unique(a.letters)
        words_a, words_b = a.coded(known, 64), b.coded(known, 1 << 20)
        step = max(1, min(1024, 4_000_000 // (len(known) + 1)))
        for lo in range(0, len(a.names), step):
            rows = range(lo, min(lo + step, len(a.names)))
            found: list[tuple[int, np.ndarray]] = []
            size = -1
            for i in rows:
                if a.n[i] != size:
                    size = int(a.n[i])
                    fits = np.flatnonzero(np.minimum(size, b.n) * 200.0 >= least * (size + b.n))  # lengths ascend, so these are neighbours
                    first, last = (int(fits[0]), int(fits[-1]) + 1) if len(fits) else (0, 0)
                    most = np.minimum(np.floor((size + b.n[first:last]) * (1 - least / 100) + 1e-9), 64).astype(np.uint8)
                skip = max(0, i + 1 - first) if right is None else 0
                near = np.flatnonzero(np.bitwise_count(b.sign[first + skip : last] ^ a.sign[i]) <= most[skip:])
                if len(near):
                    found.append((i, near + (first + skip)))
            if not found:
                continue
            who, other = np.repeat([i for i, _ in found], [len(x) for _, x in found]), np.concatenate([x for _, x in found])
            for at in range(0, len(who), 500_000):
                w, o = who[at : at + 500_000], other[at : at + 500_000]
                common = np.zeros(len(w), np.int64)
                short = a.n[w] <= 64
                end = lo + int(np.searchsorted(a.n[lo : rows.stop], 64, side="right"))
                if short.any():
                    common[short] = common_lengths(words_a[lo:end], a.n[lo:end], words_b[:, : int(b.n[o[short]].max())], w[short] - lo, o[short], len(known))
                for i in np.flatnonzero(~short).tolist():
                    common[i] = common_length(a.names[w[i]], b.names[o[i]])
                ratio = 200.0 * common / (a.n[w] + b.n[o])
                for i in np.flatnonzero(ratio >= least).tolist():
                    x, y = a.names[w[i]], b.names[o[i]]
                    out.append((min(x, y), max(x, y), float(ratio[i])))
    return pa.table({"x": pa.array([r[0] for r in out], pa.string()), "y": pa.array([r[1] for r in out], pa.string()), "ratio": pa.array([r[2] for r in out], pa.float64())})


def near_in_cell(rows: pa.Table, i: int, j: int, least: float) -> pa.Table:
    """near_names() of the parts i and j of name_blocks()."""
    g = rows["g"].to_numpy()
    part = lambda k: unpack(rows["names"].filter(pa.array(g == k)))["norm"].to_pylist() if (g == k).any() else []
    return near_names(part(i), None if i == j else part(j), least)
