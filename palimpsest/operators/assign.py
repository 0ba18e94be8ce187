"""Assignments between two ordered lists. All are sequential by nature and run inside one group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher
from heapq import heapify, heappop, heappush


def greedy_global(pairs: list[tuple[float, int, int]], ties_descending: bool = False) -> dict[int, tuple[int, float]]:
    """Best pairs first, each side once: {left: (right, ratio)}. Equal ratios keep index order, or
    with ties_descending take the greater indices first."""
    ordered = sorted(pairs, reverse=True) if ties_descending else sorted(pairs, key=lambda p: -p[0])
    taken: set[int] = set()
    out: dict[int, tuple[int, float]] = {}
    for r, i, j in ordered:
        if i not in out and j not in taken:
            out[i] = (j, r)
            taken.add(j)
    return out


def greedy_bounded(left: Sequence[str], right: Sequence[str], least: float, ties_descending: bool = False) -> dict[int, tuple[int, float]]:
    """What greedy_global gives for all pairs of ratio `least` or more, with few ratios computed. Pairs
    wait in a heap under their length bound, then their multiset bound, then their ratio; a pair is
    taken only when no bound above it is left, and a pair of a taken side is never measured."""
    sign = -1 if ties_descending else 1
    heap = []
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            n = len(a) + len(b)
            if a and b and 2 * min(len(a), len(b)) >= least * n - 1e-12:
                heap.append((-2.0 * min(len(a), len(b)) / n, 0, sign * i, sign * j))
    heapify(heap)
    matchers: dict[int, SequenceMatcher] = {}
    taken: set[int] = set()
    out: dict[int, tuple[int, float]] = {}
    while heap:
        value, known, i, j = heappop(heap)
        i, j = sign * i, sign * j
        if i in out or j in taken:
            continue
        if known == 2:
            out[i] = (j, -value)
            taken.add(j)
            continue
        m = matchers.get(j) or matchers.setdefault(j, SequenceMatcher(None, "", right[j], autojunk=False))
        m.set_seq1(left[i])
        r = m.ratio() if known else m.quick_ratio()
        if r >= least:
            heappush(heap, (-r, known + 1, sign * i, sign * j))
    return out


def match_global(left: Sequence[str], right: Sequence[str], least: float, ties_descending: bool = False) -> dict[int, tuple[int, float]]:
    """Best pairs first over all pairs that reach `least`. Only equal texts have ratio 1 and they come
    first, so they are paired by value and only the rest is compared."""
    step = -1 if ties_descending else 1
    places: dict[str, list[int]] = {}
    for j in range(len(right))[::step]:
        if right[j]:
            places.setdefault(right[j], []).append(j)
    out: dict[int, tuple[int, float]] = {}
    for i in range(len(left))[::step]:
        if places.get(left[i]):
            out[i] = (places[left[i]].pop(0), 1.0)
    taken = {j for j, _ in out.values()}
    lefts = [i for i in range(len(left)) if i not in out]
    rights = [j for j in range(len(right)) if j not in taken]
    rest = greedy_bounded([left[i] for i in lefts], [right[j] for j in rights], least, ties_descending)
    return out | {lefts[i]: (rights[j], r) for i, (j, r) in rest.items()}


def greedy_in_order(n: int, m: int, score: Callable[[int, int], float | None]) -> dict[int, tuple[int, float]]:
    """Each left item in turn takes the best right item left over; the first of equals."""
    taken: set[int] = set()
    out: dict[int, tuple[int, float]] = {}
    for i in range(n):
        best, at = 0.0, -1
        for j in range(m):
            if j in taken:
                continue
            s = score(i, j)
            if s is not None and s > best:
                best, at = s, j
        if at >= 0:
            taken.add(at)
            out[i] = (at, best)
    return out


def argmax(a: str, pool: Sequence[str], least: float = 0.0) -> tuple[int, float]:
    """Index and ratio (a first) of the best of a pool, the first of equals; (-1, 0.0) if none is
    above zero or none reaches `least`."""
    if a and a in pool:
        return pool.index(a), 1.0
    best, at = 0.0, -1
    for j, b in enumerate(pool):
        if 2 * min(len(a), len(b)) <= best * (len(a) + len(b)):
            continue
        m = SequenceMatcher(None, a, b, autojunk=False)
        bound = m.real_quick_ratio()
        if bound < least or (best or least) and (m.quick_ratio() <= best or m.quick_ratio() < least):
            continue
        r = m.ratio()
        if r > best and r >= least:
            best, at = r, j
    return at, best
