"""Bin completion on a histogram of sizes.

The search always completes the largest item left.  It enumerates fillings of the rest of its bin, leaves out dominated
ones (a filling that ends in an item of exactly the space left beats all that fill that space otherwise), and takes them
by growing waste.  A branch is cut when its waste exceeds what the best packing so far allows.  Best-fit decreasing gives
the first packing; the search ends at the lower bound or after ``nodes`` nodes, and returns the best packing met.

Equal bins are made at once: a pattern carries how often it is used.  So the work depends on the number of distinct
sizes, at most the capacity, and not on the number of items.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

Pattern = tuple[tuple[int, ...], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: total size, and items that cannot share a bin with those larger than the rest."""
    total = sum(s * c for s, c in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for k in [0, *(s for s in sizes if 2 * s <= capacity)]:
        big = sum(c for s, c in counts.items() if s > capacity - k)
        mid = [(s, c) for s, c in counts.items() if capacity // 2 < s <= capacity - k]
        low = sum(s * c for s, c in counts.items() if k <= s <= capacity // 2)
        n, room = sum(c for _, c in mid), sum((capacity - s) * c for s, c in mid)
        best = max(best, big + n + max(0, -(-(low - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Fill one bin at a time, largest item first, then always the largest item that fits; equal bins together."""
    left, sizes, out = dict(counts), sorted(counts), []
    while sizes:
        bin_, room = [], capacity
        used: Counter = Counter()
        at = len(sizes) - 1
        while at >= 0:
            size = sizes[at]
            take = min(room // size, left[size] - used[size])
            if take > 0:
                if not bin_:
                    take = 1 if 2 * size > capacity else take
                bin_ += [size] * take
                used[size] += take
                room -= size * take
            at = min(at - 1, bisect_right(sizes, room) - 1)
        times = min(left[s] // n for s, n in used.items())
        out.append((tuple(bin_), times))
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
                sizes.pop(bisect_left(sizes, s))
    return out


def fillings(sizes: list[int], left: dict[int, int], room: int, allowed: int, most: int, steps: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` with waste up to ``allowed``, the least waste and larger items first."""
    found: list[tuple[int, tuple[int, ...]]] = []
    work = [steps]

    def grow(chosen: list[int], used: Counter, space: int, top: int) -> None:
        work[0] -= 1
        cap = min(space, top)
        if space <= top and left.get(space, 0) > used[space]:
            found.append((0, (*chosen, space)))
            return
        at, fitted = bisect_right(sizes, cap) - 1, False
        smallest = next((s for s in sizes if left[s] > used[s]), None)
        while at >= 0 and work[0] > 0 and len(found) < most:
            size = sizes[at]
            at -= 1
            if left[size] <= used[size]:
                continue
            fitted = True
            used[size] += 1
            chosen.append(size)
            grow(chosen, used, space - size, size)
            chosen.pop()
            used[size] -= 1
        if not fitted and space <= allowed and (smallest is None or smallest > space or cap < smallest):
            if not any(s <= space and left[s] > used[s] for s in sizes[: bisect_right(sizes, space)]):
                found.append((space, tuple(chosen)))

    grow([], Counter(), room, room)
    found.sort(key=lambda f: f[0])
    return [f for _, f in found]


def pack(counts: dict[int, int], capacity: int, nodes: int = 20_000, most: int = 12, steps: int = 400) -> list[Pattern]:
    """Patterns (sizes of one bin, times used) that pack ``counts`` of sizes from 1 to ``capacity``."""
    counts = {s: c for s, c in counts.items() if c}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("sizes must lie between 1 and the capacity")
    best = best_fit_decreasing(counts, capacity)
    best_bins = sum(t for _, t in best)
    low, total = lower_bound(counts, capacity), sum(s * c for s, c in counts.items())
    if best_bins == low:
        return best
    left, sizes = dict(counts), sorted(counts)
    path: list[Pattern] = []
    bins = waste = 0

    def apply(bin_: tuple[int, ...], times: int) -> None:
        for s, n in Counter(bin_).items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
                sizes.pop(bisect_left(sizes, s))

    def undo(bin_: tuple[int, ...], times: int) -> None:
        for s, n in Counter(bin_).items():
            if s not in left:
                insort(sizes, s)
            left[s] = left.get(s, 0) + n * times

    def options():
        allowed = (best_bins - 1) * capacity - total - waste
        if allowed < 0:
            return iter(())
        size = sizes[-1]
        left[size] -= 1
        rest = fillings(sizes, left, capacity - size, allowed, most, steps)
        left[size] += 1
        out = []
        for f in rest:
            bin_ = (size, *f)
            times = min(left[s] // n for s, n in Counter(bin_).items())
            lost = capacity - sum(bin_)
            if lost:
                times = min(times, allowed // lost)
            out += [(bin_, t) for t in dict.fromkeys((times, 1)) if t > 0]
        return iter(out)

    stack = [options()]
    while stack and nodes > 0:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                bin_, times = path.pop()
                undo(bin_, times)
                bins -= times
                waste -= times * (capacity - sum(bin_))
            continue
        nodes -= 1
        bin_, times = step
        apply(bin_, times)
        path.append(step)
        bins += times
        waste += times * (capacity - sum(bin_))
        if not sizes:
            if bins < best_bins:
                best, best_bins = list(path), bins
            if best_bins == low:
                break
            stack.append(iter(()))
        elif bins + lower_bound_quick(left, capacity) >= best_bins:
            stack.append(iter(()))
        else:
            stack.append(options())
    return best


def lower_bound_quick(left: dict[int, int], capacity: int) -> int:
    return -(-sum(s * c for s, c in left.items()) // capacity)
