"""Greedy choices among intervals in numpy: what the folds of ``operators`` do to small groups, for groups of any size.

Kept intervals stand sorted by start, so a candidate meets only those near it; work follows the number of intervals that
overlap, not the size of the group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _iou(s1: float, e1: float, s2: float, e2: float) -> float:
    hull = max(e1, e2) - min(s1, s2)
    return max(0.0, min(e1, e2) - max(s1, s2)) / hull if hull > 0 else 0.0


def kept(starts: list[float], ends: list[float], parents: list, threshold: float) -> list[bool]:
    """Which intervals, in the order given, overlap no kept one by ``threshold`` unless both have one parent."""
    chosen: list[tuple[float, int]] = []
    widest, out = 0.0, []
    for i, (s, e, p) in enumerate(zip(starts, ends, parents)):
        near = chosen[bisect_left(chosen, (s - widest, -1)) : bisect_right(chosen, (e, len(starts)))] if threshold > 0 else chosen
        hit = any(_iou(starts[j], ends[j], s, e) >= threshold and (p is None or parents[j] != p) for _, j in near)
        out.append(not hit)
        if not hit:
            insort(chosen, (s, i))
            widest = max(widest, e - s)
    return out


def matched(left: list, right: list) -> list[bool]:
    """Which pairs, in the order given, have neither side in a pair taken before."""
    a, b, out = set(), set(), []
    for x, y in zip(left, right):
        free = x not in a and y not in b
        out.append(free)
        if free:
            a.add(x)
            b.add(y)
    return out


def parts(starts: list[float], window: float, longest: float) -> list[int]:
    """Numbers of the parts into which a run of windows is cut where it would exceed ``longest``."""
    out, first, part = [], None, 0
    for s in starts:
        if first is None or s + window - first > longest:
            part += first is not None
            first = s
        out.append(part)
    return out


def _groups(xs: pa.Array, make, kind: pa.DataType) -> pa.Array:
    """``make`` of the fields of each list of structs; a null list stays null."""
    out = []
    for x in xs:
        inner = x.values if x.is_valid else None
        out.append(None if inner is None else make(*(inner.field(i).to_pylist() for i in range(inner.type.num_fields))))
    return pa.array(out, pa.list_(kind))


def kept_flags(intervals: Column, threshold: float) -> Column:
    """Array of flags for an array of (start, end, parent)."""

    @F.arrow_udf("array<boolean>")
    def run(x: pa.Array) -> pa.Array:
        return _groups(x, lambda s, e, p: kept(s, e, p, threshold), pa.bool_())

    return run(intervals)


def matched_flags(pairs: Column) -> Column:
    """Array of flags for an array of (left, right)."""

    @F.arrow_udf("array<boolean>")
    def run(x: pa.Array) -> pa.Array:
        return _groups(x, matched, pa.bool_())

    return run(pairs)


def part_numbers(starts: Column, window: float, longest: float) -> Column:
    """Array of part numbers for an array of (start)."""

    @F.arrow_udf("array<int>")
    def run(x: pa.Array) -> pa.Array:
        return _groups(x, lambda s: parts(s, window, longest), pa.int32())

    return run(starts)
