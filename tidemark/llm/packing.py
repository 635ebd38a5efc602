"""Best-fit packing of documents into sequences by bin completion.

A document longer than the capacity is cut into full pieces, each a sequence of its own, and a rest.
Pieces are dealt by a hash of their document to groups of bounded total length, and each group is
packed on its own.  Within a group a branch and bound works on bins: the largest piece left opens a bin,
and the undominated ways to fill it are the branches.  One filling dominates another if the other's
pieces can be parted into sets that fit into the one's pieces.  A branch is cut when the waste it has made
leaves no room to beat the incumbent, which starts as the best-fit decreasing packing and is replaced
by any better one: at every node the rest is packed by best fit, too.  Pieces that fit with nothing, full ones
above all, stand alone from the start and cost no search.  A quick pass lists few fillings a node, a second one all of
them.  The search ends at the waste bound or when its work is
used up, with the incumbent, which is proven only if nothing was left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192
#: Sequences' worth of pieces that one group holds, about.
GROUP_BINS = 512
#: Work of the search on a group at most: fillings tried, and steps of listing them and of comparing them for dominance.
#: It is the only bound of the search.
WORK = 100_000
#: Steps of listing that a node of the first, quick pass takes; what it leaves out is for the second, which leaves out nothing.
QUICK = 3200
#: Close fillings that a node tries before it lists all.
CLOSE = 64


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into sizes, which fall; each goes where it leaves the least room, the earliest bin in ties."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i, s in enumerate(sizes):
        at = bisect_left(rooms, (s, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(rooms, (room - s, b))
    return bins


def waste_bound(sizes: list[int], capacity: int) -> int:
    """A number of bins that no packing can be below: the sum bound, and Martello and Toth's L2 over
    every threshold among the sizes.  sizes falls."""
    n = len(sizes)
    if not n:
        return 0
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    best = -(-prefix[-1] // capacity)
    half = next((i for i, s in enumerate(sizes) if 2 * s <= capacity), n)
    last = n
    # thresholds k rise: pieces above capacity - k stand alone, pieces below k don't count
    for k in sorted({s for s in sizes[half:]}):
        while last > half and sizes[last - 1] < k:
            last -= 1
        big = _above(sizes, capacity - k, half)
        room = (half - big) * capacity - (prefix[half] - prefix[big])
        small = prefix[last] - prefix[half]
        best = max(best, half + max(0, -(-(small - room) // capacity)))
    return max(best, half)


def _above(sizes: list[int], limit: int, hi: int) -> int:
    """How many of the first hi sizes, which fall, exceed limit."""
    lo = 0
    while lo < hi:
        mid = (lo + hi) // 2
        if sizes[mid] > limit:
            lo = mid + 1
        else:
            hi = mid
    return lo


def dominated(small: tuple[int, ...], big: tuple[int, ...], budget: list[int] | None = None) -> bool:
    """Whether the pieces of small can be parted into sets, each within a piece of big of its own.

    budget is one counter of steps left; without steps left the answer is no, which cuts no branch.
    """
    if sum(small) > sum(big):
        return False
    rooms = list(big)

    def place(i: int) -> bool:
        if i == len(small):
            return True
        if budget is not None:
            if budget[0] <= 0:
                return False
            budget[0] -= 1
        tried = set()
        for j, r in enumerate(rooms):
            if r >= small[i] and r not in tried:
                tried.add(r)
                rooms[j] -= small[i]
                if place(i + 1):
                    return True
                rooms[j] += small[i]
        return False

    return place(0)


def fillings(rest: list[int], room: int, budget: list[int] | None = None, most: int | None = None) -> tuple[list[tuple[int, ...]], bool]:
    """(undominated sets of sizes from rest (falling, with repeats) that fit into room, fullest first; whether
    these are all of them).

    Sets are tried by falling sizes; a set is feasible only if maximal: nothing left over would fit beside it.  budget is
    one counter of steps left, which this uses up; without steps left no more sets are listed, and sets that are listed
    are kept uncompared.  With most the fullest so many are compared, and no more are given.
    """
    budget = [WORK] if budget is None else budget
    values = sorted(set(rest), reverse=True)
    count = {v: 0 for v in values}
    for v in rest:
        count[v] += 1
    found: list[tuple[int, ...]] = []

    def maximal(left: int, taken: tuple[int, ...]) -> bool:
        used: dict[int, int] = {}
        for v in taken:
            used[v] = used.get(v, 0) + 1
        for v in reversed(values):
            if v > left:
                return True
            if used.get(v, 0) < count[v]:
                return False
        return True

    # (next value, room left, taken, taken of that value); the last is tried first
    open_ = [(0, room, (), 0)]
    while open_ and budget[0] > 0:
        budget[0] -= 1
        i, left, taken, own = open_.pop()
        if i < len(values) and values[i] > left:
            i, own = _above(values, left, len(values)), 0
        if i == len(values):
            if maximal(left, taken):
                found.append(taken)
            continue
        v = values[i]
        open_.append((i + 1, left, taken, 0))
        if own < count[v]:
            open_.append((i, left - v, (*taken, v), own + 1))
    kept: list[tuple[int, ...]] = []
    ranked = sorted(set(found), key=lambda x: (-sum(x), len(x), tuple(-y for y in x)))
    if most is not None:
        budget = [QUICK * most]
    for i, f in enumerate(ranked):
        if most is not None and (len(kept) == most or i == 4 * most):
            return kept, False
        if budget[0] > 0:
            budget[0] -= len(kept)
            if any(dominated(f, k, budget) for k in kept):
                continue
        kept.append(f)
    return kept or [()], not open_


def close_fillings(rest: list[int], room: int, width: int = CLOSE) -> list[tuple[int, ...]]:
    """Sets of sizes from rest (falling) that leave little room, fullest first: a first piece, the largest second one
    that fits, then more by falling sizes.  Cheap where rest is long; tried before all fillings are listed."""
    sizes = np.array(rest, dtype=np.int64)
    first = np.flatnonzero(np.append(True, sizes[1:] != sizes[:-1]) & (sizes <= room)) if rest else np.empty(0, np.int64)
    second = np.maximum(np.searchsorted(-sizes, sizes[first] - room), first + 1)  # the largest that fits, further on
    paired = np.append(sizes, 0)[second]
    found = set()
    for k in np.argsort(room - sizes[first] - paired, kind="stable")[:width].tolist():
        taken = [rest[first[k]]]
        left, at = room - taken[0], int(second[k])
        while at < len(rest):
            taken.append(rest[at])
            left -= rest[at]
            at = max(at + 1, _above(rest, left, len(rest)))
        found.add(tuple(taken))
    return sorted(found, key=lambda x: (-sum(x), len(x), tuple(-y for y in x)))


def complete_bins(sizes: list[int], capacity: int, work: int = WORK) -> tuple[list[list[int]], bool, int]:
    """(bins of indexes into sizes, whether proven optimal, work used).  sizes falls and none exceeds capacity."""
    # pieces with no room for the smallest stand alone in every packing
    alone = _above(sizes, capacity - sizes[-1], len(sizes) - 1) if sizes else 0
    lone, sizes = [[i] for i in range(alone)], sizes[alone:]
    best = best_fit_decreasing(sizes, capacity)
    bound = waste_bound(sizes, capacity)
    if len(best) <= bound:
        return lone + [[alone + i for i in b] for b in best], True, 0
    total, left, whole, quick_pass = sum(sizes), [work], True, True
    chosen: list[tuple[int, ...]] | None = None
    goal = len(best)

    def ways(rest: list[int], room: int):
        nonlocal whole
        close = close_fillings(rest, room)
        yield from close
        every, all_of_them = fillings(rest, room, [QUICK], CLOSE) if quick_pass else fillings(rest, room, left)
        whole = whole and all_of_them
        yield from (f for f in every if f not in close)

    def search(rest: list[int], done: list[tuple[int, ...]], waste: int) -> bool:
        """True once the bound is met or the work is used up."""
        nonlocal chosen, goal, whole
        if not rest:
            if len(done) < goal:
                goal, chosen = len(done), list(done)
            return goal <= bound
        quick = best_fit_decreasing(rest, capacity) if done else []
        if done and len(done) + len(quick) < goal:
            goal, chosen = len(done) + len(quick), [*done, *(tuple(rest[i] for i in b) for b in quick)]
            if goal <= bound:
                return True
        # what may be wasted in all without needing goal bins or more
        if waste > (goal - 1) * capacity - total or len(done) + waste_bound(rest, capacity) >= goal:
            return False
        head, others = rest[0], rest[1:]
        for filling in ways(others, capacity - head):
            if left[0] <= 0:
                whole = False
                return True
            left[0] -= 1
            after = list(others)
            for v in filling:
                del after[_above(after, v, len(after))]
            gap = capacity - head - sum(filling)
            if search(after, [*done, (head, *filling)], waste + gap):
                return True
        if left[0] <= 0:
            whole = False
        return False

    import sys

    old = sys.getrecursionlimit()
    sys.setrecursionlimit(max(old, 10 * len(sizes) + 10_000))
    try:
        for quick_pass in (True, False):
            whole = True
            search(list(sizes), [], 0)
            if goal <= bound or whole or left[0] <= 0:
                break
    finally:
        sys.setrecursionlimit(old)
    proven = goal <= bound or whole
    if chosen is None:
        return lone + [[alone + i for i in b] for b in best], proven, work - left[0]
    where: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        where.setdefault(sizes[i], []).append(alone + i)
    return lone + [[where[v].pop() for v in b] for b in chosen], proven, work - left[0]


def bin_completion(sizes: list[int], capacity: int, work: int = WORK) -> tuple[list[list[int]], bool]:
    """(bins of indexes into sizes, whether proven optimal).  sizes falls and none exceeds capacity."""
    return complete_bins(sizes, capacity, work)[:2]


def _pack(capacity: int, work: int):
    def run(key, rows):
        import pyarrow as pa

        doc, start, size = (rows.column(c).to_pylist() for c in ("doc_id", "start", "size"))
        order = sorted(range(len(doc)), key=lambda i: (-size[i], doc[i], start[i]))
        bins, _ = bin_completion([size[i] for i in order], capacity, work)
        group, out = key[0].as_py(), []
        for b, members in enumerate(bins):
            used = 0
            for p, m in enumerate(members):
                i = order[m]
                out.append((group, b, p, doc[i], start[i], size[i], used))
                used += size[i]
        cols = list(zip(*out))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=PACKED_NAMES)

    return run


PACKED = "group long, bin int, position int, doc_id long, start long, size long, offset long"
PACKED_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, size=None, group_bins: int = GROUP_BINS, work: int = WORK) -> DataFrame:
    """(group, bin, position, doc_id, start, size, offset): piece [start, start + size) of a document stands
    at offset of sequence (group, bin).

    size is a column of lengths, by default the text's bytes in UTF-8, the unit of a byte-level model.
    Documents of length 0 or null, or with a null id, take no room and are left out; rows that repeat
    are packed as often as they stand there.  An empty table gives no rows.  Other columns are ignored.
    The number of groups follows the total length, so a group's work doesn't grow with the table.
    """
    length = (F.octet_length("text") if size is None else size).cast("long")
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("length")).where("doc_id is not null and length > 0")
    total = lengths.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, round(total / (capacity * group_bins)))
    full = F.expr(f"length div {capacity}")
    pieces = lengths.select(
        "doc_id",
        "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("length") % capacity == 0, full - 1).otherwise(full))).alias("k"),
    ).select("doc_id", (F.col("k") * capacity).alias("start"), F.least(F.lit(capacity), F.col("length") - F.col("k") * capacity).cast("long").alias("size"))
    keyed = pieces.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("group"), "*")
    return keyed.groupBy("group").applyInArrow(_pack(capacity, work), PACKED)
