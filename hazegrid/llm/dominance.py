"""Bin packing of whole-number sizes by dominance reduction and best fit, on counts of sizes.

Pieces of equal size are interchangeable, so an instance is a count for each size up to the capacity and a packing is a
list of patterns (the sizes in one bin) with their multiplicities. Both are bounded by the capacity, however many
pieces there are.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping

#: (how many bins, sizes in each of them)
Pattern = tuple[int, tuple[int, ...]]


def _reach(counts: list[int], room: int) -> int:
    """The largest sum up to ``room`` that the counted sizes can make."""
    sums, mask = 1, (1 << (room + 1)) - 1
    for size in range(1, room + 1):
        left = min(counts[size], room // size)
        copies = 1
        while left > 0:
            step = min(copies, left)
            sums |= (sums << (step * size)) & mask
            left -= step
            copies *= 2
        if sums >> room & 1:
            return room
    return sums.bit_length() - 1


def _smallest(counts: list[int], k: int, room: int) -> int | None:
    """Sum of the ``k`` smallest pieces, or None if there are fewer or it exceeds ``room``."""
    total = 0
    for size in range(1, room + 1):
        take = min(k, counts[size])
        total, k = total + take * size, k - take
        if total > room:
            return None
        if not k:
            return total
    return None


def _companions(counts: list[int], room: int) -> tuple[int, ...] | None:
    """Sizes whose bin dominates every other way to fill ``room``, or None if no such set of up to two is found.

    A set dominates another one if the other can be split into parts that are no larger than its members. One piece
    as large as the largest sum that fits dominates all sets. If at most two pieces fit, two of them do if no pair
    has a second piece that is larger than theirs.
    """
    largest = next((s for s in range(room, 0, -1) if counts[s]), 0)
    if not largest:
        return ()
    if largest == room or largest == _reach(counts, room):
        return (largest,)
    if _smallest(counts, 3, room) is not None:
        return None
    counts[largest] -= 1
    second = next((s for s in range(room - largest, 0, -1) if counts[s]), 0)
    counts[largest] += 1
    for y in range(room // 2, second, -1):
        if counts[y]:
            counts[y] -= 1
            partner = next((x for x in range(y, room - y + 1) if counts[x]), 0)
            counts[y] += 1
            if partner:
                return None
    return (largest, second) if second else (largest,)


def reduce(counts: list[int], capacity: int) -> list[Pattern]:
    """Bins that some optimal packing holds; their pieces are taken out of ``counts``."""
    fixed: list[Pattern] = []
    for size in range(capacity, 0, -1):
        while counts[size]:
            counts[size] -= 1
            mates = _companions(counts, capacity - size)
            counts[size] += 1
            if mates is None:
                break
            bin_ = (size, *mates)
            # taking pieces away leaves no new way to fill a bin, so the set goes on dominating while its pieces last
            times = min(counts[s] // bin_.count(s) for s in set(bin_))
            for s in bin_:
                counts[s] -= times
            fixed.append((times, bin_))
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing: each piece goes where least room is left."""
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(room: int, pattern: Pattern) -> None:
        if room == 0:
            done.append(pattern)
        elif room in open_:
            open_[room].append(pattern)
        else:
            open_[room] = [pattern]
            insort(rooms, room)

    for size in range(capacity, 0, -1):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                # new bins, filled one after the other
                per = capacity // size
                full, rest = divmod(left, per)
                if full:
                    put(capacity - per * size, (full, (size,) * per))
                if rest:
                    put(capacity - rest * size, (1, (size,) * rest))
                break
            room = rooms[at]
            bins, sizes = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            per = room // size
            full, rest = divmod(left, per)
            if full >= bins:
                put(room - per * size, (bins, sizes + (size,) * per))
                left -= bins * per
                continue
            if full:
                put(room - per * size, (full, sizes + (size,) * per))
            if rest:
                put(room - rest * size, (1, sizes + (size,) * rest))
            if unused := bins - full - bool(rest):
                put(room, (unused, sizes))
            break
    return done + [p for patterns in open_.values() for p in patterns]


def pack(sizes: Mapping[int, int], capacity: int) -> list[Pattern]:
    """Patterns for all pieces: reduction first, best fit for the rest."""
    counts = [0] * (capacity + 1)
    for size, n in sizes.items():
        if not 0 < size <= capacity:
            raise ValueError(f"a piece of {size} does not fit {capacity}")
        counts[size] += n
    return reduce(counts, capacity) + best_fit(counts, capacity)


def lower_bound(sizes: Mapping[int, int], capacity: int) -> int:
    """No packing has fewer bins (the bound of Martello and Toth over all thresholds)."""
    counts = [sizes.get(s, 0) for s in range(capacity + 1)]
    best = -(-sum(s * n for s, n in enumerate(counts)) // capacity)
    for k in range(1, capacity // 2 + 1):
        alone = sum(counts[capacity - k + 1 :])
        half = sum(counts[capacity // 2 + 1 : capacity - k + 1])
        room = half * capacity - sum(s * counts[s] for s in range(capacity // 2 + 1, capacity - k + 1))
        small = sum(s * counts[s] for s in range(k, capacity // 2 + 1))
        best = max(best, alone + half + max(0, -(-(small - room) // capacity)))
    return best
