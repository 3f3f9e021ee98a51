"""Binary trie joins over bit strings with a Hamming error budget.

A trie over sorted bit strings is held as ranges of the sorted rows: a node is a range of rows that agree in their first bits. Pairs
of nodes are walked together, all groups of a batch at once and level by level: where the next bits of two nodes differ the pair's
errors grow by one, and a pair whose errors exceed every budget left in it is pruned. A leaf is one row; its pair is settled by the
bits that are left.
"""

from __future__ import annotations

import numpy as np

#: Node pairs that are walked at once; more wait their turn, so that memory is bounded.
AT_ONCE = 1 << 20
#: Row pairs of two leaves.
LEAF = 16

Pairs = tuple[np.ndarray, np.ndarray]


def _over(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, op: np.ufunc) -> np.ndarray:
    """op over values[start:end] of each range; ranges are not empty, in order and apart. values has one more element than rows."""
    return op.reduceat(values, np.stack([starts, ends], axis=1).ravel())[::2]


def _cross(lo: np.ndarray, hi: np.ndarray, p: np.ndarray, q: np.ndarray) -> Pairs:
    """All pairs of rows of the node pairs; of a node with itself each pair once."""
    rows = hi[p] - lo[p]
    of = np.repeat(np.arange(len(p)), rows)
    i = lo[p][of] + np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
    begin = np.where(p[of] == q[of], i + 1, lo[q][of])
    more = hi[q][of] - begin
    at = np.repeat(np.arange(len(of)), more)
    return i[at], begin[at] + np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)


def join(bits: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: np.ndarray, q: np.ndarray, errors: np.ndarray, size: np.ndarray, rate: float, behind: np.ndarray | None = None) -> Pairs:
    """Pairs of rows (i, j) with errors + differing bits <= rate * (size + size), each once.

    bits: n x w uint64, most significant bit first, sorted within each root; errors: what a row adds to any pair it is in; size: what
    it adds to a pair's budget; behind: how many things the bits stand for, whose difference is a least error too. Roots are the ranges [start, end), in order; p, q: the pairs of roots to be joined (p = q: a root
    with itself).
    """
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    end = bits.shape[1] * 64
    errors_, size_ = np.append(errors, 0), np.append(size, 0)

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        d = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        if behind is not None:
            d = np.maximum(d, np.abs(behind[i] - behind[j]))
        ok = d + errors[i] + errors[j] <= rate * (size[i] + size[j]) + 1e-9
        left.append(i[ok])
        right.append(j[ok])

    stack = [(0, starts, ends, p, q, np.zeros(len(p), dtype=np.int64))]
    while stack:
        depth, lo, hi, p, q, met = stack.pop()
        if len(p) > AT_ONCE:
            for s in range(0, len(p), AT_ONCE):
                stack.append((depth, lo, hi, p[s : s + AT_ONCE], q[s : s + AT_ONCE], met[s : s + AT_ONCE]))
            continue
        # Only nodes that are in a pair stay.
        used, at = np.unique(np.concatenate([p, q]), return_inverse=True)
        lo, hi, p, q = lo[used], hi[used], at[: len(p)], at[len(p) :]
        if not len(p):
            continue
        # The budget left: no pair of two nodes allows more errors than their greatest sizes do.
        least, most = _over(errors_, lo, hi, np.minimum), _over(size_, lo, hi, np.maximum)
        one = hi - lo == 1
        go = (met + least[p] + least[q] <= rate * (most[p] + most[q]) + 1e-9) & ~((p == q) & one[p])
        p, q, met = p[go], q[go], met[go]
        leaf = (hi - lo)[p] * (hi - lo)[q] <= LEAF
        settle(*_cross(lo, hi, p[leaf], q[leaf]))
        p, q, met = p[~leaf], q[~leaf], met[~leaf]
        if not len(p):
            continue
        if depth == end:
            # Rows of one node are alike in all bits.
            for s in range(0, len(p), 4096):
                settle(*_cross(lo, hi, p[s : s + 4096], q[s : s + 4096]))
            continue
        column = np.append((bits[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1), 0).astype(np.int64)
        middle = hi - _over(column, lo, hi, np.add)
        # Children of node i: 2 i and 2 i + 1; empty ones are in no pair.
        lo, hi = np.stack([lo, middle], axis=1).ravel(), np.stack([middle, hi], axis=1).ravel()
        same = p == q
        children = [(2 * p, 2 * q, met), (2 * p + 1, 2 * q + 1, met), (2 * p, 2 * q + 1, met + 1), (2 * p[~same] + 1, 2 * q[~same], met[~same] + 1)]
        p, q, met = (np.concatenate(x) for x in zip(*children, strict=True))
        full = (hi[p] > lo[p]) & (hi[q] > lo[q])
        stack.append((depth + 1, lo, hi, p[full], q[full], met[full]))
    return np.concatenate(left), np.concatenate(right)
