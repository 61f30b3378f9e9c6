"""Rows that no other row dominates, by local fronts and grid cells.

Each partition first leaves out the rows that one of its own dominates. What stays is placed in
a grid of at most CELLS cells; a cell whose corner another cell beats goes whole, and a row is
compared with the rows of those cells only that can hold one that dominates it. Only cells and
pairs of cells reach the driver or are broadcast, whatever the number of rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged

#: Cells of the grid, bins of a metric, and metrics that the grid uses, at most.
CELLS, BINS, SIDES = 256, 16, 8
_EXACT = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)
_CHUNK = 512
#: Rows of a front that are broadcast as a whole, at most; more go by cells.
SMALL = 20_000


def _better(mine: Column, other: Column, way: str) -> Column:
    return other > mine if way == "max" else other < mine


def beaten(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which ``rows`` one of ``by`` dominates; larger is better."""
    out = np.zeros(len(rows), bool)
    for at in range(0, len(by), 4096):
        todo = np.flatnonzero(~out)
        mine, other = rows[todo, None, :], by[None, at : at + 4096, :]
        out[todo] = ((other >= mine).all(2) & (other > mine).any(2)).any(1)
    return out


def _local(ways: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    signs = np.array([1.0 if w == "max" else -1.0 for w in ways])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front, kept = np.empty((0, len(ways))), None
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) * signs
            number = ~np.isnan(x).any(1)
            if not number.all():
                yield b.filter(pa.array(~number))
            order = np.flatnonzero(number)
            order = order[np.argsort(-x[order, 0], kind="stable")]
            for at in range(0, len(order), _CHUNK):
                pick = order[at : at + _CHUNK]
                pick = pick[~beaten(x[pick], front)]
                pick = pick[~beaten(x[pick], x[pick])]
                if not len(pick):
                    continue
                stay, more = ~beaten(front, x[pick]), pa.Table.from_batches([b.take(pa.array(pick))])
                front = np.concatenate([front[stay], x[pick]])
                kept = more if kept is None else pa.concat_tables([kept.filter(pa.array(stay)), more])
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return work


def local_front(values: DataFrame, ways: dict[str, str]) -> DataFrame:
    """``values`` without rows that one of their own partition dominates, where doubles hold the metrics exactly."""
    if not all(isinstance(f.dataType, _EXACT) for f in values.schema.fields):
        return values
    return values.mapInArrow(_local([ways[c] for c in values.columns]), values.schema)


def _placed(values: DataFrame, cuts: dict[str, list[float]], ways: dict[str, str]) -> DataFrame:
    side = F.lit(0)
    for name, at in cuts.items():
        v = F.col(name).cast("double")
        side = side * (BINS + 1) + sum(((v >= c) if ways[name] == "max" else (v <= c)).cast("long") for c in at)
    return values.withColumn("_cell", F.lit(side).cast("long") if cuts else F.lit(0).cast("long"))


def _bins(cell: int, n: int) -> tuple[int, ...]:
    out = []
    for _ in range(n):
        cell, low = divmod(cell, BINS + 1)
        out.append(low)
    return tuple(reversed(out))


def undominated(targets: DataFrame, others: DataFrame, ways: dict[str, str], small: int = SMALL) -> DataFrame:
    """Distinct rows of ``targets`` that no row of ``others`` dominates; both hold the metrics ``ways`` alone, without nulls."""
    names = list(ways)
    same = targets is others
    others = staged(local_front(others.distinct(), ways), "pareto_front")
    targets = others if same else targets.distinct()
    rival = others.select(*[F.col(c).alias(f"_o_{c}") for c in names])
    not_worse, better = F.lit(True), F.lit(False)
    for c, way in ways.items():
        not_worse = not_worse & ~_better(F.col(f"_o_{c}"), F.col(c), way)
        better = better | _better(F.col(c), F.col(f"_o_{c}"), way)
    if others.count() <= small:
        return targets.join(F.broadcast(rival), not_worse & better, "left_anti")
    numeric = [f.name for f in targets.schema.fields if isinstance(f.dataType, T.NumericType)][:SIDES]
    targets = others if same else staged(targets, "pareto_rows")
    cuts: dict[str, list[float]] = {}
    if numeric:
        bins = max(2, min(BINS, int(CELLS ** (1 / len(numeric)) + 1e-9)))
        at = [i / bins for i in range(1, bins)]
        row = others.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 1000).alias(c) for c in numeric]).first()
        cuts = {c: sorted({x for x in row[c] or [] if x == x}) for c in numeric}
    mine, theirs = _placed(targets, cuts, ways), _placed(others, cuts, ways)
    # At most CELLS numbers each.
    cells, rivals = ({r[0]: _bins(r[0], len(cuts)) for r in d.select("_cell").distinct().collect()} for d in (mine, theirs))
    whole = len(cuts) == len(names)
    dead = {c for c, x in cells.items() if whole and any(all(b > a for a, b in zip(x, y, strict=True)) for y in rivals.values())}
    near = [(c, o) for (c, x), (o, y) in itertools.product(cells.items(), rivals.items()) if c not in dead and all(b >= a for a, b in zip(x, y, strict=True))]
    spark = targets.sparkSession
    alive = spark.createDataFrame([(c,) for c in cells if c not in dead], "_cell long")
    pairs = spark.createDataFrame(near, "_cell long, _near long")
    mine = mine.join(F.broadcast(alive), "_cell", "left_semi")
    rival = theirs.select(F.col("_cell").alias("_at"), *[F.col(c).alias(f"_o_{c}") for c in names])
    lost = mine.join(F.broadcast(pairs), "_cell").join(rival, (F.col("_near") == F.col("_at")) & not_worse & better, "left_semi").select(*names)
    return mine.select(*names).join(lost.distinct(), names, "left_anti")
