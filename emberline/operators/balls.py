"""Exact nearest rows with pruning: rows are cut into balls, and a row visits those that can hold one of its nearest.

1. Rows of a seeded hash order serve as centres; a row belongs to the ball of its nearest centre, whose
   radius is the farthest of its rows. Balls of more than ``rows`` rows fall into parts.
2. Each row meets its own ball. Its k-th distance there bounds the final one from above.
3. It then visits every other ball whose centre is no farther than that bound and the ball's radius
   together, by the triangle inequality (with a margin for rounding). Partial lists are merged.

On rows in clusters a row visits a few balls. On rows without any it would visit most; where one
row in ``SHARE``, taken by a hash, says so, all pairs meet in the larger tiles of ``tiles``, which are cheaper then. The
lists are the same either way. Centres and a radius a ball are all that the driver holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .tiles import _best, _near_kernel, all_pairs, exact, meet, squares, whole

#: Most centres; more rows make larger balls, in parts.
CENTRES = 4096
#: Rows of which one is asked how many balls it would visit, and the share of balls from which all pairs are cheaper.
SHARE, DENSE = 16, 0.5
#: Places of a matrix of rows and balls, and rows that a task gives at once.
PIECE, GIVEN = 1_000_000, 10_000


def _met(lefts: DataFrame, rights: DataFrame, parts: dict[int, int], rows: int, k: int, exclude_self: bool, kind: str) -> DataFrame:
    """Partial lists of rows (k, v, ball) with the rows (k, v, ball, part) of the balls that they name."""
    spark = lefts.sparkSession
    visitors = {r["ball"]: r["n"] for r in lefts.groupBy("ball").agg(F.count("*").alias("n")).collect()}  # a row a ball
    plan, tiles = [], 0
    for ball in sorted(visitors):
        if ball in parts:
            chunks = -(-visitors[ball] // rows)
            plan.append((ball, parts[ball], chunks, tiles))
            tiles += parts[ball] * chunks
    schema = f"k {kind}, near array<{kind}>, d array<double>"
    if not plan:
        return spark.createDataFrame([], schema)
    sizes = F.broadcast(spark.createDataFrame(plan, "ball int, parts int, chunks int, first int"))
    tile = (F.col("first") + F.col("part") * F.col("chunks") + F.col("chunk")).cast("int")
    l = lefts.join(sizes, "ball").withColumn("chunk", F.pmod(F.xxhash64("k", F.lit(1)), F.col("chunks"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    r = rights.join(sizes, "ball").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = lambda d, i: d.select(tile.alias("tile"), F.lit(i).alias("side"), "k", "v", F.lit(0.0).alias("c"))
    return meet(side(l, 0).unionByName(side(r, 1)), tiles, _near_kernel(k, exclude_self), schema)


def near_lists(left: DataFrame, right: DataFrame, k: int, key: str = "id", vector: str = "features", exclude_self: bool = False, rows: int = 20_000) -> DataFrame:
    """``tiles.near_lists`` by balls: (key, near, d), ties by smaller key."""
    kind = left.select(key).schema[0].dataType.simpleString()
    pick = lambda d: whole(d, vector).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    wanted = pick(right)
    number = min(CENTRES, -(-4 * wanted.count() // rows))
    centres = np.array([r["v"] for r in wanted.orderBy(F.xxhash64(F.lit(7), "k"), "k").limit(number).collect()], float)
    if not len(centres):
        return _best(left.sparkSession.createDataFrame([], f"k {kind}, near array<{kind}>, d array<double>"), k, key)

    def belong(frames):
        for f in frames:
            x = np.stack(f["v"].to_numpy()).astype(float) if len(f) else np.empty((0, centres.shape[1]))
            ball = np.zeros(len(x), np.int32)
            for at, sq, _ in squares(x, centres):
                ball[at : at + len(sq)] = sq.argmin(axis=1)
            yield f.assign(ball=ball, far=exact(x, centres[ball]))

    schema = f"k {kind}, v array<double>, ball int, far double"
    held = staged(wanted.mapInPandas(belong, schema), "balls")
    asking = held if left is right else staged(pick(left).mapInPandas(belong, schema), "asking")
    stats = held.groupBy("ball").agg(F.max("far").alias("radius"), F.max(F.isnan("far")).alias("odd"), F.count("*").alias("n")).collect()  # a row a ball
    radius = np.full(len(centres), -1.0)
    radius[[r["ball"] for r in stats]] = [np.inf if r["odd"] else r["radius"] for r in stats]
    parts = {r["ball"]: -(-r["n"] // rows) for r in stats}
    sizes = F.broadcast(left.sparkSession.createDataFrame(list(parts.items()), "ball int, parts int"))
    rights = held.join(sizes, "ball").select("k", "v", "ball", F.pmod(F.xxhash64("k", F.lit(2)), F.col("parts")).cast("int").alias("part"))
    own = staged(_met(asking.select("k", "v", "ball"), rights, parts, rows, k, exclude_self, kind), "own")
    best = _best(own, k, "k").select(F.col("k").alias("_k"), F.when(F.size("d") >= k, F.element_at("d", -1)).alias("bound"))

    def near_balls(f):
        """(first row, balls to visit) of some rows of a frame at a time: a matrix of at most ``PIECE`` places."""
        x, ball = np.stack(f["v"].to_numpy()).astype(float), f["ball"].to_numpy()
        bound = f["bound"].fillna(np.inf).to_numpy()
        piece = max(1, PIECE // len(radius))
        for start in range(0, len(x), piece):
            for at, sq, error in squares(x[start : start + piece], centres):
                mine = slice(start + at, start + at + len(sq))
                near = np.sqrt(np.maximum(sq - error, 0)) <= (bound[mine, None] + radius[None, :]) * (1 + 1e-9)
                near |= np.isinf(sq) | np.isinf(radius)[None, :]
                near &= radius[None, :] >= 0
                near[np.arange(len(sq)), ball[mine]] = False
                yield start + at, near

    def visits(frames):
        for f in frames:
            for at, near in near_balls(f) if len(f) else ():
                r, b = np.nonzero(near)
                for s in range(0, len(r), GIVEN):
                    part = f.iloc[at + r[s : s + GIVEN]]
                    yield pd.DataFrame({"k": part["k"].to_numpy(), "v": part["v"].to_numpy(), "ball": b[s : s + GIVEN].astype(np.int32)})

    def counted(frames):
        for f in frames:
            yield pd.DataFrame({"n": [sum(int(near.sum()) for _, near in near_balls(f))] if len(f) else []}, dtype="int64")

    bounded = asking.join(best, F.col("k") == F.col("_k"), "left").select("k", "v", "ball", "bound")
    some = bounded.where(F.pmod(F.xxhash64("k", F.lit(3)), F.lit(SHARE)) == 0)
    seen = some.mapInPandas(counted, "n long").agg(F.sum("n")).first()[0] or 0
    if seen > DENSE * some.count() * len(stats):
        return all_pairs(left, right, k, key, vector, exclude_self, rows)
    more = staged(bounded.mapInPandas(visits, f"k {kind}, v array<double>, ball int"), "visits")
    return _best(own.unionByName(_met(more, rights, parts, rows, k, exclude_self, kind)), k, key)
