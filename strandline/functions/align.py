"""Global alignment of two sequences with unit costs: edit distance, gaps and shift of an optimal path.

Myers' bit-vector recurrence computes one column of the dynamic programming matrix with a handful of
operations on big integers. Every k-th column is kept (k the root of their number), and the path is
traced back block by block through columns computed once more from the one kept before them, so the
memory is that of 2 k columns at every size. Common ends are stripped first.
Of several optimal paths the one is taken that, traced back from the end, prefers a diagonal, then a
base of the first sequence alone (I), then one of the second (D).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _masks(a: str) -> dict[str, int]:
    """For each letter the bits of its places in ``a``."""
    places: dict[str, bytearray] = {c: bytearray(len(a) // 8 + 1) for c in set(a)}
    for i, char in enumerate(a):
        places[char][i >> 3] |= 1 << (i & 7)
    return {c: int.from_bytes(x, "little") for c, x in places.items()}


def _columns(masks: dict[str, int], m: int, b: str, column: tuple[int, int]):
    """Vertical positive and negative differences over the rows 1..m: of ``column``, then of the one after each letter of ``b``."""
    full = (1 << m) - 1
    pv, mv = column
    yield pv, mv
    for char in b:
        eq = masks.get(char, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        yield pv, mv


def _path(a: str, b: str, block: int | None = None) -> list[str]:
    """The operations of the path; ``block`` is the number of columns between two that are kept."""
    i, j = len(a), len(b)
    out: list[str] = []
    if i and j:
        masks, m = _masks(a), i
        step = block or math.isqrt(j) + 1
        kept, pv, mv = [], 0, 0
        for at, (pv, mv) in enumerate(_columns(masks, m, b, ((1 << m) - 1, 0))):
            if at % step == 0:
                kept.append((pv, mv))
        depth = j + pv.bit_count() - mv.bit_count()  # D(i, j)
        held: list[tuple[int, int]] = []
        base = j + 1
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append("M")
                continue
            if j - 1 < base:  # the columns j-1 and j lie in the block that begins at or before j-1
                base = (j - 1) // step * step
                held = list(_columns(masks, m, b[base : base + step], kept[base // step]))
            (pl, ml), (pv, mv) = held[j - 1 - base], held[j - base]
            bit = i - 1
            up = depth - ((pv >> bit) & 1) + ((mv >> bit) & 1)  # D(i-1, j)
            low = (1 << bit) - 1
            diagonal = (j - 1) + (pl & low).bit_count() - (ml & low).bit_count()  # D(i-1, j-1)
            if diagonal + 1 == depth:
                out.append("M")
                i, j, depth = i - 1, j - 1, diagonal
            elif up + 1 == depth:
                out.append("I")
                i, depth = i - 1, up
            else:
                out.append("D")
                j, depth = j - 1, depth - 1
    out += "I" * i + "D" * j
    return out[::-1]


def common_begin(a: str, b: str) -> int:
    """How many characters both begin with."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(s[:n].encode("utf-32-le"), np.uint32) for s in (a, b))
    apart = np.flatnonzero(x != y)
    return int(apart[0]) if len(apart) else n


def align(a: str, b: str) -> dict:
    """``edit_distance, max_shift, subs, indels`` and ``cigar`` of two sequences.

    I consumes a base of ``a``, D one of ``b``; ``max_shift`` is the signed diagonal (I counts +, D -)
    that is farthest from the start, the first such one.
    """
    left = common_begin(a, b)
    most = min(len(a), len(b)) - left
    right = common_begin(a[len(a) - most :][::-1], b[len(b) - most :][::-1])
    x, y = a[left : len(a) - right], b[left : len(b) - right]
    path = _path(x, y)
    subs = indels = shift = best = 0
    i = j = 0
    for op in path:
        if op == "M":
            subs += x[i] != y[j]
            i, j = i + 1, j + 1
        else:
            indels += 1
            shift += 1 if op == "I" else -1
            i, j = i + (op == "I"), j + (op == "D")
            if abs(shift) > abs(best):
                best = shift
    runs: list[list] = [[left, "M"]] if left else []
    for op in [*path, *(["M"] if right else [])]:
        if runs and runs[-1][1] == op:
            runs[-1][0] += 1
        else:
            runs.append([1, op])
    if right:
        runs[-1][0] += right - 1
    return {"edit_distance": subs + indels, "max_shift": best, "subs": subs, "indels": indels, "cigar": "".join(f"{n}{op}" for n, op in runs)}


METRICS = T.StructType([*(T.StructField(n, T.LongType()) for n in ("edit_distance", "max_shift", "subs", "indels")), T.StructField("cigar", T.StringType())])


@F.pandas_udf(METRICS)
def align_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    names = ["edit_distance", "max_shift", "subs", "indels", "cigar"]
    for a, b in parts:
        rows = [align(x, y) if x is not None and y is not None else dict.fromkeys(names) for x, y in zip(a, b)]
        frame = pd.DataFrame(rows, columns=names)
        yield frame.astype({n: "Int64" for n in names[:4]})
