"""Array kernels for DNA: k-mers, seed spacings, shifted identity. They work on a batch of sequences or on one."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

_CODES = np.full(256, -1, np.int8)
for _i, _b in enumerate("ACGT"):
    _CODES[ord(_b)] = _CODES[ord(_b.lower())] = _i

#: Positions of a read that are compared for its identity with itself shifted by a period.
COMPARISONS = 1024
#: Seeds with most occurrences that take part in the refinement of a period.
SEED_GROUPS = 128


def encode(sequences: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base codes (A 0, C 1, G 2, T 3, others -1) of all sequences in one array, and where each begins. Null is empty."""
    raw = sequences.cast(pa.large_binary()).fill_null(b"")
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.combine_chunks()
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return _CODES[data], at - at[0]


def chunks(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of sequences with at most so many bases each (or one sequence)."""
    out, lo = [], 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def member(values: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Whether each value is among sorted targets."""
    if not len(targets):
        return np.zeros(len(values), bool)
    at = np.searchsorted(targets, values)
    return targets[np.minimum(at, len(targets) - 1)] == values


def kmers(codes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of k bases within one sequence: positions in `codes`, forward and reverse complement code."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.int64)
    bad = np.append(0, np.cumsum(codes < 0, dtype=np.int32))
    good = bad[k:] == bad[:-k]
    edge = (at[1:-1, None] - np.arange(1, k)).ravel()  # windows that would reach into the next sequence
    good[edge[(edge >= 0) & (edge < n)]] = False
    where = np.flatnonzero(good)
    kind = np.int32 if k <= 15 else np.int64
    c = np.maximum(codes, 0).astype(kind)
    forward, back = np.zeros(n, kind), np.zeros(n, kind)
    for j in range(k):
        np.left_shift(forward, 2, out=forward)
        np.bitwise_or(forward, c[j : j + n], out=forward)
    c = 3 - c
    for j in range(k - 1, -1, -1):
        np.left_shift(back, 2, out=back)
        np.bitwise_or(back, c[j : j + n], out=back)
    return where, forward[where].astype(np.int64), back[where].astype(np.int64)


def low_seed(codes: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    """Windows of k bases (at `where`) unfit as seeds: at most two different bases, or 80 % of one."""
    if not len(where):
        return np.zeros(0, bool)
    kinds, most = np.zeros(len(codes) - k + 1, np.int8), np.zeros(len(codes) - k + 1, np.int32)
    for b in range(4):
        total = np.append(np.int32(0), np.cumsum(codes == b, dtype=np.int32))
        n = total[k:] - total[:-k]
        kinds += n > 0
        np.maximum(most, n, out=most)
    return ((kinds <= 2) | (most >= math.ceil(0.8 * k)))[where]


def low_diagnostic(code: np.ndarray, k: int) -> np.ndarray:
    """k-mers unfit as diagnostic: 80 % of one base, or one pair of bases at all even offsets."""
    digits = np.stack([(code >> (2 * (k - 1 - j))) & 3 for j in range(k)]) if k else np.zeros((0, len(code)))
    counts = np.stack([(digits == b).sum(0) for b in range(4)])
    pairs = np.stack([digits[j] * 4 + digits[j + 1] for j in range(0, k - 1, 2)]) if k > 1 else np.zeros((1, len(code)))
    return (counts.max(0) / k >= 0.8) | (pairs == pairs[0]).all(0)


def decode(code: int, k: int) -> str:
    return "".join("ACGT"[(code >> (2 * (k - 1 - j))) & 3] for j in range(k))


def identities_at(codes: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Share of equal bases between sequences (start and length in `codes`) and themselves shifted by a period each.

    At most COMPARISONS positions count, spread by a whole step; those with an unknown base do not.
    """
    span = np.maximum(length - period, 0)
    step = np.maximum(1, span // COMPARISONS)
    n = -(-span // step)
    first = np.cumsum(n) - n
    own = np.repeat(np.arange(len(n)), n)
    left = start[own] + (np.arange(len(own)) - first[own]) * step[own]
    x, y = codes[left], codes[left + period[own]]
    known = (x >= 0) & (y >= 0)
    total = np.append(0, np.cumsum(known, dtype=np.int64))
    if len(n) and n.max() > COMPARISONS:
        known &= total[1:] - total[first[own]] <= COMPARISONS
        total = np.append(0, np.cumsum(known, dtype=np.int64))
    equal = np.append(0, np.cumsum(known & (x == y), dtype=np.int64))
    valid = total[first + n] - total[first]
    return np.where(valid > 0, (equal[first + n] - equal[first]) / np.maximum(valid, 1), 0.0)


def identities(codes: np.ndarray, at: np.ndarray, period: int) -> np.ndarray:
    """`identities_at` of each sequence of a batch for one period."""
    length = np.diff(at)
    usual = (length > period) & (length - period <= COMPARISONS)
    unknown = np.flatnonzero(codes < 0)
    usual[np.searchsorted(at, unknown, side="right") - 1] = False
    out = np.zeros(len(length))
    if usual.any():
        equal = np.append(np.int32(0), np.cumsum(codes[:-period] == codes[period:], dtype=np.int32))
        out[usual] = (equal[at[1:][usual] - period] - equal[at[:-1][usual]]) / (length[usual] - period)
    rest = (length > period) & ~usual
    if rest.any():
        out[rest] = identities_at(codes, at[:-1][rest], length[rest], np.full(rest.sum(), period))
    return out


def spacings(position: np.ndarray, first: np.ndarray, size: np.ndarray, owner: np.ndarray, low: int, high: np.ndarray, cap: int, bin_size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of binned distances between positions of the same seed: (owner, bin, count), in their order.

    Seeds are runs of `position` (first and size of each), each with an owner, whose distances lie from low to high. Of
    a seed at most `cap` distances in range count, of 20 cap at all: those of neighbours first, then two apart and so on.
    """
    keys, taken = [], np.zeros(len(first), np.int64)
    ends = first + size
    for gap in range(1, int(size.max(initial=1))):
        seen = (gap - 1) * size - gap * (gap - 1) // 2  # pairs closer than this gap
        some = np.flatnonzero((size > gap) & (taken < cap) & (seen < 20 * cap))
        if not len(some):
            continue
        n = np.minimum(ends[some] - gap - first[some], 20 * cap - seen[some])
        begin = np.cumsum(n) - n
        own = np.repeat(np.arange(len(some)), n)
        left = first[some][own] + np.arange(len(own)) - begin[own]
        d = position[left + gap] - position[left]
        group = some[own]
        fit = (d >= low) & (d <= high[group])
        rank = np.append(0, np.cumsum(fit))
        fit &= taken[group] + rank[1:] - rank[begin][own] <= cap
        taken += np.bincount(group[fit], minlength=len(first))
        d, group = d[fit], group[fit]
        keys.append(owner[group] * (1 << 32) + np.clip((d + bin_size // 2) // bin_size * bin_size, low, high[group]))
    key, count = np.unique(np.concatenate(keys) if keys else np.array([], np.int64), return_counts=True)
    return key >> 32, key & ((1 << 32) - 1), count


def phase_score(groups: list[np.ndarray], period: int, tolerance: int = 2) -> float:
    """Share of seed positions in their seed's largest neighbourhood on the circle of the period."""
    held = total = 0
    for positions in groups:
        total += len(positions)
        if 2 * tolerance >= period - 1:
            held += len(positions)
            continue
        r = np.sort(positions % period)
        twice = np.concatenate([r, r + period])
        held += int((np.searchsorted(twice, r + period + tolerance, side="right") - np.searchsorted(twice, r + period - tolerance)).max())
    return held / total if total else 0.0


def local_identity(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Best identity of two sequences (codes) without gaps over all offsets with enough overlap, and that overlap.

    Ties: the longer overlap, then the first offset. Unknown bases equal each other, as letters do.
    """
    least = min(50, len(a), len(b))
    if not least:
        return 0.0, 0
    matches = sum(np.correlate((a == c).astype(np.int64), (b == c).astype(np.int64), "full") for c in (-1, 0, 1, 2, 3))
    offset = np.arange(-len(b) + 1, len(a))
    overlap = np.minimum(len(a) - np.maximum(0, offset), len(b) - np.maximum(0, -offset))
    share = np.where(overlap >= least, matches / overlap, -1.0)
    best = np.lexsort((offset, -overlap, -share))[0]
    return (float(share[best]), int(overlap[best])) if share[best] > 0 else (0.0, 0)
