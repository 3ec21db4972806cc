"""Exact similarity self-join of texts under a true edit metric by metric-space partitioning.

The metric is the unrestricted edit distance with swaps (a swap of neighbours is one edit); it obeys the triangle
inequality.  A bounded number of pivots is drawn; every text has its distances to all pivots and lives in the cell of
the nearest.  For a radius r, two texts within r have distances to any pivot that differ by at most r, so a text is copied
to just those cells whose pivot is at most 2r farther than its own, and inside a cell a pair is compared only if all its
pivot distances agree within r.  A cell that holds too much for one task is cut into a grid of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.naming import damerau, within_one

#: Texts that one block of a cell compares: members at home, and members at home or visiting.
HOME_BLOCK, VISITOR_BLOCK = 4_000, 32_000
#: Pivots at least, and at most; between, an eighth of the square root of the number of texts.
LEAST_PIVOTS, MOST_PIVOTS = 16, 256


def pivot_distances(texts: list[str], pivots: list[str]) -> np.ndarray:
    """Distances of every text to every pivot (rows are texts), computed for all texts of a batch in step."""
    n = len(texts)
    raw = [t.encode("ascii", "replace") for t in texts]
    sizes = np.array([len(t) for t in raw], dtype=np.int64)
    width = int(sizes.max()) if n else 0
    chars = np.zeros((width, n), dtype=np.uint8)
    for k, t in enumerate(raw):
        chars[: len(t), k] = np.frombuffer(t, dtype=np.uint8)
    out = np.empty((n, len(pivots)), dtype=np.uint8)
    every = np.arange(n)
    for p, pivot in enumerate(pivots):
        a = pivot.encode("ascii", "replace")
        top = np.int16(len(a) + width + 1)
        d = np.zeros((len(a) + 2, width + 2, n), dtype=np.int16)
        d[0] = top
        d[:, 0] = top
        d[1:, 1] = np.arange(len(a) + 1, dtype=np.int16)[:, None]
        d[1, 1:] = np.arange(width + 1, dtype=np.int16)[:, None]
        row_of = np.zeros(256, dtype=np.int16)
        for i, x in enumerate(a, 1):
            last = np.zeros(n, dtype=np.int16)
            for j in range(1, width + 1):
                y = chars[j - 1]
                k, same = row_of[y], y == x
                swap = d[k, last, every] + (i - k - 1) + 1 + (j - last - 1)
                last = np.where(same, np.int16(j), last)
                best = np.minimum(d[i, j] + ~same, np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
                d[i + 1, j + 1] = np.minimum(best, swap)
            row_of[x] = i
        out[:, p] = np.minimum(d[len(a) + 1, sizes + 1, every], 255)
    return out


def runs(texts: list[str], pivot: int, cells: int = 12_000_000) -> list[list[str]]:
    """Texts sorted by length in runs whose distance tables hold at most ``cells`` numbers, so one long text costs no memory for the others."""
    out: list[list[str]] = []
    for t in sorted(texts, key=len):
        if not out or len(out[-1]) >= 4_096 or (len(out[-1]) + 1) * (len(t) + 2) * (pivot + 2) > cells:
            out.append([])
        out[-1].append(t)
    return out


def block_pairs(home: list[str], dh: np.ndarray, other: list[str], do: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs (home, other) within ``radius``, by pivot filter and then the metric itself."""
    found = []
    lh, lo = np.array([len(t) for t in home], dtype=np.int16), np.array([len(t) for t in other], dtype=np.int16)
    wide_h, wide_o = dh.astype(np.int16), do.astype(np.int16)
    step = max(1, 4_000_000 // max(1, len(other)))
    dense = min(4, dh.shape[1])
    for low in range(0, len(home), step):
        part = slice(low, low + step)
        near = np.abs(lh[part, None] - lo[None]) <= radius
        for k in range(dense):
            near &= np.abs(wide_h[part, k, None] - wide_o[None, :, k]) <= radius
        i, j = np.nonzero(near)
        i = i + low
        for k in range(dense, dh.shape[1]):
            if not len(i):
                break
            keep = np.abs(wide_h[i, k] - wide_o[j, k]) <= radius
            i, j = i[keep], j[keep]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if home[x] != other[y] and (within_one(home[x], other[y]) if radius == 1 else damerau(home[x], other[y], radius) <= radius):
                found.append((x, y))
    return found


def near_pairs(texts: DataFrame, radius: int = 1) -> DataFrame:
    """(a, b) with a < b: all pairs of different texts of the single column ``text`` within ``radius`` edits.

    NULL texts are near nothing, repeated ones count once, characters beyond ASCII are compared as one and the same sign
    in the filter (which only widens it) and exactly at the end.  Exact at every size: the pivots only steer the work.
    """
    spark = texts.sparkSession
    distinct = texts.where("text IS NOT NULL").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    total = distinct.count()
    if total < 2:
        return spark.createDataFrame([], "a string, b string")
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(total) // 8), total)
    pivots = [r[0] for r in distinct.orderBy(F.xxhash64("text"), "text").limit(count).collect()]

    longest = max(map(len, pivots))

    def place(batches):
        for batch in batches:
            for part in runs(batch.column(0).to_pylist(), longest):
                d = pivot_distances(part, pivots)
                home = d.argmin(axis=1)
                least = d.min(axis=1).astype(np.int16)
                # a pair is emitted in the cell of the smaller home, so a text visits only cells before its own
                visits = (d.astype(np.int16) <= (least + 2 * radius)[:, None]) & (np.arange(len(pivots))[None] < home[:, None])
                row, cell = np.nonzero(visits)
                rows = np.concatenate([np.arange(len(part)), row])
                cells = np.concatenate([home, cell])
                at_home = np.concatenate([np.ones(len(part), dtype=bool), np.zeros(len(row), dtype=bool)])
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(at_home), pa.array([part[r] for r in rows], pa.string()), pa.array([d[r].tobytes() for r in rows], pa.binary())], names=["cell", "home", "text", "d"])

    members = distinct.mapInArrow(place, "cell int, home boolean, text string, d binary").persist(StorageLevel.MEMORY_AND_DISK)
    sizes = members.groupBy("cell").agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("n")).collect()
    blocks = spark.createDataFrame([(c, max(1, -(-h // HOME_BLOCK)), max(1, -(-n // VISITOR_BLOCK))) for c, h, n in sizes], "cell int, hb int, vb int")
    dealt = members.join(F.broadcast(blocks), "cell")
    part = lambda n: F.pmod(F.xxhash64("text"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("home").withColumn("v", every("vb")).select("cell", part("hb").alias("h"), "v", F.lit(True).alias("left"), "home", "text", "d")
    right = dealt.withColumn("h", every("hb")).select("cell", "h", part("vb").alias("v"), F.lit(False).alias("left"), "home", "text", "d")
    width = len(pivots)

    def compare(block: pa.Table) -> pa.Table:
        side = np.array(block.column("left").to_pylist(), dtype=bool)
        text = np.array(block.column("text").to_pylist(), dtype=object)
        at_home = np.array(block.column("home").to_pylist(), dtype=bool)
        d = np.frombuffer(b"".join(block.column("d").to_pylist()), dtype=np.uint8).reshape(-1, width)
        h, v = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = [], []
        for x, y in block_pairs(text[h].tolist(), d[h], text[v].tolist(), d[v], radius):
            s, t = text[h[x]], text[v[y]]
            if not at_home[v[y]] or s < t:
                a.append(min(s, t))
                b.append(max(s, t))
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return left.unionByName(right).groupBy("cell", "h", "v").applyInArrow(compare, "a string, b string")
