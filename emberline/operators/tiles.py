"""Pairs of two sets of vectors, in tiles: a task meets one block of rows of either side.

Inside a tile a matrix product gives squared distances and a bound on their error. They only say
which pairs can matter; distances that are returned or compared come from differences, added
component by component in order, as SQL adds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs whose squared distances a task holds at once.
HELD = 1_000_000


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between row i of ``x`` and row i of ``y``."""
    total = np.zeros(len(x))
    with np.errstate(all="ignore"):
        for i in range(x.shape[1]):
            apart = x[:, i] - y[:, i]
            total += apart * apart
        return np.sqrt(total)


def squares(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
    """(first row, squared distances of the next rows of ``x`` to all of ``y``, their largest error).

    Where the product overflows or meets a missing component, differences are taken at once and
    undefined distances are infinite.
    """
    if not len(x) or not len(y):
        return
    step = max(1, HELD // len(y))
    with np.errstate(all="ignore"):
        centre = y.mean(axis=0)
        a, b = x - centre, y - centre
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        error = float(8 * (x.shape[1] + 8) * np.finfo(float).eps * (aa.max() + bb.max()))
        if np.isfinite(error):
            a, b = np.column_stack([-2 * a, aa, np.ones(len(a))]), np.column_stack([b, np.ones(len(b)), bb]).T.copy()
            held = np.empty((min(step, len(a)), len(y)))
            for at in range(0, len(a), step):
                part = a[at : at + step]
                yield at, np.matmul(part, b, out=held[: len(part)]), error
            return
        for at in range(0, len(x), step):
            total = np.zeros((len(x[at : at + step]), len(y)))
            for i in range(x.shape[1]):
                apart = x[at : at + step, i, None] - y[None, :, i]
                total += apart * apart
            total[np.isnan(total)] = np.inf
            yield at, total, 0.0


def copy_number(y: np.ndarray) -> np.ndarray:
    """0, 1, ... for equal rows, in the order of the rows."""
    n = len(y)
    if not n or not y.shape[1]:
        return np.arange(n)
    whole = np.ascontiguousarray(y + 0.0).view(np.dtype((np.void, 8 * y.shape[1]))).ravel()
    code = np.unique(whole, return_inverse=True)[1].ravel()
    order = np.argsort(code, kind="stable")
    return run_position(code[order])[np.argsort(order, kind="stable")]


def run_position(sorted_values: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of equal values."""
    n = len(sorted_values)
    first = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if n else np.empty(0, int)
    return np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))


def edge(sq: np.ndarray, n: int) -> np.ndarray:
    """For each row a number that at least ``n`` of its values do not exceed, close to the n-th smallest."""
    if sq.shape[1] < n:
        return np.full(len(sq), np.inf)
    while sq.shape[1] >= 16 * n:  # least values of ever larger groups of columns
        half = sq.shape[1] // 2
        sq = np.minimum(sq[:, :half], sq[:, half : 2 * half])
    return np.partition(sq, n - 1, axis=1)[:, n - 1]


def has_whole(vector: str) -> Column:
    """Whether a row's vector is there without a null in it. Others are near no row."""
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull()), F.lit(False))


def whole(df: DataFrame, vector: str) -> DataFrame:
    return df.where(has_whole(vector))


Kernel = Callable[..., "object"]


def tiled(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str, key: str = "id", vector: str = "features", extra: str | None = None, rows: int = 20_000, mirrored: bool = False) -> DataFrame:
    """What ``kernel(keys, vectors, extras, keys, vectors, extras)`` returns for each tile.

    Both sides are dealt into blocks of about ``rows`` rows by a hash; a tile has a partition of
    its own. ``mirrored``: both sides are the same rows, and each two blocks meet once. Rows
    whose vector is null or holds a null take no part.
    """
    left, right = whole(left, vector), whole(right, vector)
    parts, blocks = (max(4, -(-d.count() // rows)) for d in (left, right))
    pick = lambda d: d.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), (F.col(extra).cast("double") if extra else F.lit(0.0)).alias("c"))
    deal = lambda salt, n: F.pmod(F.xxhash64("k", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda first, last: F.explode(F.sequence(first, last))
    part, block = F.col("part"), F.col("block")
    if mirrored:
        l = pick(left).withColumn("part", deal(0, blocks)).withColumn("block", every(part, F.lit(blocks - 1)))
        r = pick(right).withColumn("block", deal(0, blocks)).withColumn("part", every(F.lit(0), block))
        tile, n = block * (block + 1) / 2 + part, blocks * (blocks + 1) // 2
    else:
        l = pick(left).withColumn("part", deal(1, parts)).withColumn("block", every(F.lit(0), F.lit(blocks - 1)))
        r = pick(right).withColumn("block", deal(0, blocks)).withColumn("part", every(F.lit(0), F.lit(parts - 1)))
        tile, n = part * blocks + block, parts * blocks
    both = l.withColumn("side", F.lit(0)).unionByName(r.withColumn("side", F.lit(1))).select(tile.cast("int").alias("tile"), "side", "k", "v", "c")

    return meet(both, n, kernel, schema)


def meet(both: DataFrame, tiles: int, kernel: Kernel, schema: str) -> DataFrame:
    """The kernel's rows for each ``tile`` of rows (tile, side, k, v, c); a tile has a partition of its own."""
    def task(frames):
        held: dict[tuple[int, int], list] = {}
        for f in frames:  # vectors are kept as one matrix a frame, not as an object a row
            for at, part in f.groupby(["tile", "side"]):
                held.setdefault(at, []).append((part["k"].to_numpy(), np.stack(part["v"].to_numpy()).astype(float), part["c"].to_numpy()))
        for t in sorted({t for t, _ in held}):
            sides = [held.pop((t, s), None) for s in (0, 1)]
            if all(sides):
                met = [np.concatenate(x) for s in sides for x in zip(*s, strict=True)]
                del sides
                yield kernel(*met)

    return both.repartitionById(tiles, F.col("tile")).mapInPandas(task, schema)


def _near_kernel(k: int, exclude_self: bool) -> Kernel:
    """Kernel of a tile: the k nearest rows of the right side for each of the left."""
    import pandas as pd

    def kernel(ak, x, _, bk, y, __):
        most = k + exclude_self
        order = np.argsort(bk, kind="stable")
        order = order[copy_number(y[order]) < most]  # of more copies of a vector none can be among the k nearest
        bk, y = bk[order], y[order]
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for at, sq, error in squares(x, y):
            r, c = np.nonzero(sq <= edge(sq, most)[:, None] + 2 * error)
            d = exact(x[at + r], y[c])
            keep = np.isfinite(d)
            if exclude_self:
                keep &= ak[at + r] != bk[c]
            r, c, d = r[keep], c[keep], d[keep]
            order = np.lexsort((c, d, r))
            r, c, d = r[order], c[order], d[order]
            keep = run_position(r) < k
            found.append((at + r[keep], c[keep], d[keep]))
        r, c, d = (np.concatenate(t) for t in zip(*found, strict=True))
        first = np.flatnonzero(run_position(r) == 0)
        near, far = (np.split(t, first[1:]) if len(first) else [] for t in (bk[c], d))
        return pd.DataFrame({"k": ak[r[first]], "near": pd.Series(near, dtype=object), "d": pd.Series(far, dtype=object)})

    return kernel


def _best(found: DataFrame, k: int, key: str) -> DataFrame:
    """(key, near, d) from partial lists (k, near, d)."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("d", "near")))), 1, k)
    return found.groupBy("k").agg(best.alias("_best")).select(F.col("k").alias(key), F.col("_best.near").alias("near"), F.col("_best.d").alias("d"))


def near_lists(left: DataFrame, right: DataFrame, k: int, key: str = "id", vector: str = "features", exclude_self: bool = False, rows: int = 20_000) -> DataFrame:
    """(key, near, d): keys and distances of the k nearest rows of ``right``, ties by smaller key; rows with none are left out.

    Up to ``2 * rows`` rows of ``right`` meet all rows of ``left`` in tiles. More are cut into balls
    (``balls.near_lists``), which gives the same lists and leaves out what cannot be near.
    """
    if whole(right, vector).limit(2 * rows + 1).count() > 2 * rows:
        from . import balls

        return balls.near_lists(left, right, k, key, vector, exclude_self, rows)
    return all_pairs(left, right, k, key, vector, exclude_self, rows)


def all_pairs(left: DataFrame, right: DataFrame, k: int, key: str = "id", vector: str = "features", exclude_self: bool = False, rows: int = 20_000) -> DataFrame:
    """``near_lists`` from all pairs."""
    kind = left.select(key).schema[0].dataType.simpleString()
    found = tiled(left, right, _near_kernel(k, exclude_self), f"k {kind}, near array<{kind}>, d array<double>", key, vector, rows=rows)
    return _best(found, k, key)


#: Squared distances below this many times the error of their product are taken again from differences.
CLOSE = 1e6


def _distances(x: np.ndarray, y: np.ndarray, aa: np.ndarray, bb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of some rows to some others by a product, the close ones and those that overflow from differences."""
    error = float(8 * (x.shape[1] + 8) * np.finfo(float).eps * (aa.max() + bb.max()))
    if not np.isfinite(error):
        return exact(np.repeat(x, len(y), axis=0), np.tile(y, (len(x), 1))).reshape(len(x), len(y))
    sq = a @ b
    if sq.min() < CLOSE * error:
        r, c = np.nonzero(sq < CLOSE * error)
        sq[r, c] = exact(x[r], y[c]) ** 2
    return np.sqrt(sq, out=sq)


def _runs(code: np.ndarray, at: int, to: int) -> list[tuple[int, int, int]]:
    """(code, first, end) of the runs of equal codes in a stretch, counted from its start."""
    first = np.flatnonzero(np.r_[True, code[at + 1 : to] != code[at : to - 1]])
    return list(zip(code[at + first].tolist(), first.tolist(), [*first[1:].tolist(), to - at], strict=True))


def cluster_sums(x: np.ndarray, cx: np.ndarray, wx: np.ndarray, y: np.ndarray, cy: np.ndarray, wy: np.ndarray, both: bool, step: tuple[int, int] = (128, 2048)) -> Iterator[tuple[bool, np.ndarray, int, np.ndarray]]:
    """(of the left, rows, cluster, sums): weighted sums of distances from rows of one side to a cluster of the other.

    Rows come in the order of their clusters ``cx`` and ``cy``. ``both``: sums of the right side's rows come as well.
    """
    with np.errstate(all="ignore"):
        fine = np.isfinite(y).all(axis=1)
        centre = y[fine].mean(axis=0) if fine.any() else np.zeros(y.shape[1])
        p, q = x - centre, y - centre
        aa, bb = (p * p).sum(axis=1), (q * q).sum(axis=1)
        p, q = np.column_stack([-2 * p, aa, np.ones(len(p))]), np.column_stack([q, np.ones(len(q)), bb]).T.copy()
        waiting: dict[int, np.ndarray] = {}
        stretches = [(s, min(s + step[1], len(y)), _runs(cy, s, min(s + step[1], len(y)))) for s in range(0, len(y), step[1])]
        for at in range(0, len(x), step[0]):
            to = min(at + step[0], len(x))
            mine, left = _runs(cx, at, to), {}
            for s, e, theirs in stretches:
                d = _distances(x[at:to], y[s:e], aa[at:to], bb[s:e], p[at:to], q[:, s:e])
                for c, i, j in theirs:
                    got = d[:, i:j] @ wy[s + i : s + j]
                    left[c] = left[c] + got if c in left else got
                if both:
                    for c, i, j in mine:
                        if c not in waiting:
                            waiting[c] = np.zeros(len(y))
                        waiting[c][s:e] += wx[at + i : at + j] @ d[i:j]
            rows = np.arange(at, to)
            for c, sums in left.items():
                yield True, rows, c, sums
            for c in [c for c in waiting if to == len(x) or c != cx[to]]:
                yield False, np.arange(len(y)), c, waiting.pop(c)


def distance_sums(points: DataFrame, kind: str, blocks: int = 8, rows: int = 50_000) -> DataFrame:
    """(k, c, w, other, total): for points (k, c, v, w), the sum over the points of each cluster of w times the distance.

    Points are dealt into blocks of about ``rows`` by a hash, at least ``blocks``; each two blocks meet once, in a
    partition of their own. A point comes with one row for each block and cluster in it.
    """
    import pyarrow as pa

    blocks = max(blocks, -(-points.count() // rows))
    mine, other = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    dealt = points.withColumn("mine", mine).withColumn("other", other).select((high * (high + 1) / 2 + low).cast("int").alias("tile"), side.alias("side"), "k", "c", "w", "v")

    def task(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                where = batch.column("side").to_numpy()
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                k, c, w = batch.column("k").to_numpy(), batch.column("c"), batch.column("w").to_numpy()
                for s in np.unique(where):
                    at = np.flatnonzero(where == s)
                    parts.setdefault(int(s), []).append((k[at], c.take(pa.array(at)), w[at], v[at]))

        def joined(s):
            k, c, w, v = zip(*parts.pop(s), strict=True)
            c = pa.chunked_array(c).combine_chunks().dictionary_encode()
            code = c.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            return np.concatenate(k)[order], c.dictionary, code[order], np.concatenate(w)[order].astype(float), np.concatenate(v)[order]

        if 2 in parts:
            l = r = joined(2)
            both = False
        elif 0 in parts and 1 in parts:
            l, r, both = joined(0), joined(1), True
        else:
            return
        held, n = [], 0

        def frame():
            k, c, w, o, t = zip(*held, strict=True)
            columns = [pa.array(np.concatenate(k)), pa.concat_arrays(c), pa.array(np.concatenate(w).astype(np.int64)), pa.concat_arrays(o), pa.array(np.concatenate(t))]
            return pa.RecordBatch.from_arrays(columns, ["k", "c", "w", "other", "total"])

        for of_left, at, c, sums in cluster_sums(l[4], l[2], l[3], r[4], r[2], r[3], both):
            (k, names, code, w, _), (_, others, _, _, _) = (l, r) if of_left else (r, l)
            held.append((k[at], names.take(pa.array(code[at])), w[at], others.take(pa.array(np.full(len(at), c))), sums))
            n += len(at)
            if n >= 50_000:
                yield frame()
                held.clear()
                n = 0
        if held:
            yield frame()

    return dealt.repartitionById(blocks * (blocks + 1) // 2, F.col("tile")).drop("tile").mapInArrow(task, f"k long, c {kind}, w long, other {kind}, total double")
