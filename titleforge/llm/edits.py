"""Signatures for strings that differ by at most a few edits: rare disjoint shingles for
ordinary strings, deletion neighbourhoods for short ones. Both are exact."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa

from titleforge.llm.codepoints import from_codepoints, keep, letters_and_digits, lower_case, row_of, to_codepoints

MIX = np.uint64(0x9E3779B97F4A7C15)


def letter_keys(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits only, in lower case."""
    points, offsets = keep(points, offsets, letters_and_digits()[points])
    return lower_case()[points], offsets


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of integers."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64(seed + 1) * MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bucket_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bucket of each hash in a table of `size` buckets, a power of two."""
    return (hashes >> np.uint64(65 - size.bit_length())).astype(np.int64)


@lru_cache(None)
def _kept(n: int, gone: int) -> np.ndarray:
    """The places left of n when `gone` are deleted, one row per choice."""
    return np.array(list(combinations(range(n), n - gone)), np.int64).reshape(-1, n - gone)


def shingle_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q points from each position on; the last q - 1 values hold nothing."""
    with np.errstate(over="ignore"):
        out = np.full(len(points), np.uint64(q), np.uint64)
        for k in range(q):
            shifted = np.zeros(len(points), np.uint64)
            shifted[: len(points) - k] = points[k:].astype(np.uint64)
            out = out * np.uint64(1_000_003) + shifted
    return mixed(out, q)


def letter_bags(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit masks of the letters present; an edit changes at most two bits."""
    bits = np.left_shift(np.uint64(1), mixed(points) >> np.uint64(58))
    out = np.zeros(len(offsets) - 1, np.uint64)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = np.bitwise_or.reduceat(bits, offsets[:-1][full])
    return out.view(np.int64)


class EditSignatures:
    """Signatures by which every pair within `edits` insertions, deletions or replacements meets.

    A string of at least `short` letters is indexed by edits + 1 disjoint shingles, chosen for the
    least total frequency: at least one of them survives in any near string, at most `edits` places
    away. Shorter strings, and those that may be near one, meet by a common deletion variant."""

    def __init__(self, edits: int = 3, longest: int = 6, salt_rows: int = 50_000) -> None:
        self.edits, self.longest, self.salt_rows = edits, longest, salt_rows
        self.parts = edits + 1
        self.short = 2 * self.parts

    def q(self, n: int) -> int:
        return max(2, min(self.longest, (n - self.parts) // self.parts))

    def probe_sizes(self, n: int) -> list[int]:
        """The shingle sizes of the strings that may be near one of n letters."""
        return sorted({self.q(m) for m in range(max(self.short, n - self.edits), n + self.edits + 1)})

    def probes(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position, hash) of all shingles by which longer strings are probed."""
        sizes = np.diff(offsets)
        row = row_of(offsets)
        place = np.arange(len(points)) - offsets[:-1][row]
        asked = {n: self.probe_sizes(n) for n in np.unique(sizes).tolist()}
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for q in sorted({x for v in asked.values() for x in v}):
            wants = np.zeros(int(sizes.max(initial=0)) + 1, bool)
            wants[[n for n, v in asked.items() if q in v]] = True
            use = wants[sizes[row]] & (place + q <= sizes[row])
            out.append((row[use], place[use], shingle_hashes(points, q)[use]))
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]

    def index(self, points: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position, hash) of the edits + 1 disjoint shingles of least total cost; `counts` has the
        cost of each bucket of hashes. Costs steer only the work: any choice finds every pair."""
        sizes = np.diff(offsets)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        hashes: dict[int, np.ndarray] = {}
        for n in np.unique(sizes[sizes >= self.short]).tolist():
            q, rows = self.q(n), np.flatnonzero(sizes == n)
            if q not in hashes:
                hashes[q] = shingle_hashes(points, q)
            h = hashes[q][offsets[rows][:, None] + np.arange(n - q + 1)]
            cost = counts[bucket_of(h, len(counts))].astype(np.float64)
            # best[k][:, i]: least cost of k shingles that end before position i
            best = [np.zeros((len(rows), n + 1))]
            took: list[np.ndarray] = []
            for _ in range(self.parts):
                now, use = np.full((len(rows), n + 1), np.inf), np.zeros((len(rows), n + 1), bool)
                for end in range(q, n + 1):
                    price = best[-1][:, end - q] + cost[:, end - q]
                    use[:, end] = price < now[:, end - 1]
                    now[:, end] = np.where(use[:, end], price, now[:, end - 1])
                best.append(now)
                took.append(use)
            at = np.full(len(rows), n)
            every = np.arange(len(rows))
            for k in reversed(range(self.parts)):
                while (idle := ~took[k][every, at]).any():
                    at = at - idle
                at = at - q
                out.append((rows, at.copy(), h[every, at]))
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]

    def variants(self, points: np.ndarray, offsets: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of all strings left after up to `edits` deletions, for rows of fewer than `below` letters."""
        sizes = np.diff(offsets)
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for n in np.unique(sizes[sizes < below]).tolist():
            rows = np.flatnonzero(sizes == n)
            hashes = []
            for gone in range(min(self.edits, n) + 1):
                left = points[(offsets[rows][:, None] + _kept(n, gone).ravel()).ravel()].reshape(len(rows), -1, n - gone) if n > gone else np.zeros((len(rows), 1, 0), np.int64)
                x = np.full(left.shape[:2], np.uint64(7))
                with np.errstate(over="ignore"):
                    for k in range(n - gone):
                        x = x * np.uint64(1_000_003) + left[:, :, k].astype(np.uint64) + np.uint64(1)
                hashes.append(x)
            every = np.sort(np.concatenate(hashes, axis=1), axis=1)
            fresh = np.ones(every.shape, bool)
            fresh[:, 1:] = every[:, 1:] != every[:, :-1]
            out.append((np.repeat(rows, fresh.sum(axis=1)), mixed(every[fresh], 99)))
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def key_column(column: pa.Array) -> pa.Array:
    """The letters and digits of a string column in lower case; null stays null."""
    points, offsets, nulls = to_codepoints(column)
    return from_codepoints(*letter_keys(points, offsets), nulls)
