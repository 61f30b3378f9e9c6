"""Embedding near-duplicates: exact threshold links by cover trees and dual traversal.

1. Vectors with the same label and components form one weighted class, so copies weigh one row.
2. The top of the cover trees is a net of centres for each large label, drawn by a hash and bounded
   in bytes. Every vector joins the cell of its nearest centre. A vector visits another cell only
   if a vector within the threshold could lie there: it must be close enough to the plane between
   both centres, and to the cell's covering radius. Of two cells one visits the other.
3. A task holds a block of one cell's members with another block or with a block of visitors,
   builds a cover tree over each and walks both at once. A pair of nodes is dropped as soon as the
   distance of their centres exceeds the threshold distance plus both covering radii, and counted
   as a whole, without its pairs, as soon as that distance with both radii is under it.
4. Tasks return a link count for each vector and the edges of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lean, pick, staged, tune
from .components import components

_LEAF = 48
#: Larger than any rounding error of a distance of unit vectors (1.2e-7 near zero, from a dot product).
_SLACK = 1e-6
#: Most bytes of centres that are broadcast.
CENTRES = 8 << 20


def _units(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class CoverTree:
    """Nested nets over unit vectors: the radius halves from level to level.

    ``centre``: row of the node's centre; ``reach``: largest distance from it to a row below;
    ``children``: nodes under it; ``order[low:high]``: the rows under a node; ``leaf``: has no children.
    Distances come from one matrix of dot products, whose error near zero the slack of all bounds
    covers; it takes 8 bytes a pair of rows while the tree grows.
    """

    def __init__(self, unit: np.ndarray) -> None:
        self.unit = unit
        self._far = np.sqrt(np.maximum(2 - 2 * (unit @ unit.T), 0))
        self.centre: list[int] = []
        self.reach: list[float] = []
        self.children: list[np.ndarray] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.leaf: list[bool] = []
        self._placed: list[np.ndarray] = []
        self._n = 0
        self.root = self._grow(np.arange(len(unit)), 0, 1.0)
        self.order = np.concatenate(self._placed)
        del self._far

    def _grow(self, rows: np.ndarray, centre: int, radius: float) -> int:
        reach = float(self._far[centre, rows].max())
        here = len(self.centre)
        self.centre.append(centre)
        self.reach.append(reach)
        self.children.append(np.array([here]))
        self.low.append(self._n)
        parts = []
        if len(rows) > _LEAF and reach >= _SLACK:
            while radius >= reach:
                radius /= 2
            left, head = rows, centre
            while len(left):
                near = self._far[head, left] <= radius
                near[left == head] = True
                parts.append((head, left[near]))
                left = left[~near]
                if len(left):
                    head = int(left[0])
        # Where most rows stand alone at the next level, a net prunes nothing: they stay together.
        self.leaf.append(2 * len(parts) > len(rows) or not parts)
        self.high.append(0)
        if self.leaf[here]:
            self._placed.append(rows)
            self._n += len(rows)
        else:
            self.children[here] = np.array([self._grow(part, head, radius / 2) for head, part in parts])
        self.high[here] = self._n
        return here

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.low[node] : self.high[node]]


def links_between(a: CoverTree, b: CoverTree, raw_a: np.ndarray, raw_b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights linked to each row of a and of b (cosine >= threshold), and edges (of a, of b) that
    connect all linked rows, from a dual traversal of both trees.

    With a and b the same tree, links of a row with itself count too.
    """
    limit = math.sqrt(max(2 - 2 * threshold, 0))
    norm_a, norm_b = (np.sqrt((x * x).sum(axis=1)) for x in (raw_a, raw_b))
    ca, cb = np.array(a.centre), np.array(b.centre)
    ra, rb = np.array(a.reach), np.array(b.reach)
    links_a, links_b = np.zeros(len(raw_a), np.int64), np.zeros(len(raw_b), np.int64)
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    todo = [(a.root, b.root, 0.0)]
    if len(a.centre) and len(b.centre):
        apart = a.unit[a.centre[a.root]] - b.unit[b.centre[b.root]]
        todo = [(a.root, b.root, float(np.sqrt((apart * apart).sum())))]
    while todo:
        x, y, far = todo.pop()
        if far + ra[x] + rb[y] <= limit - _SLACK:
            i, j = a.rows(x), b.rows(y)
            links_a[i] += weight_b[j].sum()
            links_b[j] += weight_a[i].sum()
            out_a += [i, np.full(len(j), i[0])]
            out_b += [np.full(len(i), j[0]), j]
        elif a.leaf[x] and b.leaf[y]:
            i, j = a.rows(x), b.rows(y)
            hit = (raw_a[i] @ raw_b[j].T) / np.outer(norm_a[i], norm_b[j]) >= threshold
            links_a[i] += hit @ weight_b[j]
            links_b[j] += weight_a[i] @ hit
            p, q = np.nonzero(hit)
            out_a.append(i[p])
            out_b.append(j[q])
        else:
            px, py = a.children[x], b.children[y]
            d = np.sqrt(np.maximum(2 - 2 * (a.unit[ca[px]] @ b.unit[cb[py]].T), 0))
            p, q = np.nonzero(d <= limit + _SLACK + ra[px][:, None] + rb[py][None, :])
            todo.extend(zip(px[p].tolist(), py[q].tolist(), d[p, q].tolist(), strict=True))
    return links_a, links_b, np.concatenate(out_a), np.concatenate(out_b)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of n nodes under links a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _task(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        own = rows["kind"].iloc[0] == 0 and rows["a"].iloc[0] == rows["b"].iloc[0]
        if left.empty or right.empty and not own:
            return rows[["rep"]].iloc[:0].assign(links=np.empty(0, np.int64), root=rows["rep"].iloc[:0])
        sides = [left] if own else [left, right]
        raw = [np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in sides]
        tree = [CoverTree(_units(x)) for x in raw]
        weight = [x["n"].to_numpy() for x in sides]
        near_a, near_b, p, q = links_between(tree[0], tree[-1], raw[0], raw[-1], weight[0], weight[-1], threshold)
        links = np.zeros(len(rows), np.int64)
        at = [x.index.to_numpy() for x in sides]
        links[at[0]] += near_a
        if own:
            links[at[0]] -= weight[0]
        else:
            links[at[1]] += near_b
        root, some = _roots(len(rows), at[0][p], at[-1][q]), links > 0
        rep = rows["rep"]
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": rep.to_numpy()[root[some]]})

    return run


def _deal(shared, limit: float):
    """Cell, distance to its centre, and visits (cell, distance to its centre) of each vector."""
    visit = pa.list_(pa.struct([("cell", pa.int32()), ("far", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = shared.value
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            cell, far, visits = np.zeros(len(keys), np.int32), np.full(len(keys), 2.0), [[] for _ in keys]
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                if key in nets:
                    rows.setdefault(key, []).append(i)
            for key, some in rows.items():
                net = nets[key]
                apart = np.sqrt(np.maximum(2 - 2 * (net @ net.T), 0))
                for at in range(0, len(some), 1000):
                    part = some[at : at + 1000]
                    unit = _units(np.array(batch.column(4).take(pa.array(part)).to_pylist(), np.float64))
                    cosine = unit @ net.T
                    own = cosine.argmax(axis=1)
                    best = cosine[np.arange(len(part)), own]
                    over = (best[:, None] - cosine <= limit * apart[own] + _SLACK) & (np.arange(len(net))[None, :] > own[:, None])
                    cell[part], far[part] = own, np.sqrt(np.maximum(2 - 2 * best, 0))
                    for p, j in zip(*np.nonzero(over), strict=True):
                        visits[part[p]].append({"cell": int(j), "far": float(np.sqrt(max(2 - 2 * cosine[p, j], 0)))})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far), pa.array(visits, visit)], ["label", "dim", "rep", "n", "embedding", "cell", "far", "visits"])

    return run


def _nets(classes: DataFrame, shard: int) -> dict[tuple, np.ndarray]:
    """Centres of each (label, dim) with more than ``shard`` classes, CENTRES bytes in all about."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size")).where(F.col("size") > shard)
    want = sizes.withColumn("want", 2 * F.col("size") / shard)
    total = want.agg(F.sum("want").alias("n"), F.max("dim").alias("dim")).first()
    if not total["n"]:
        return {}
    most = max(CENTRES // (8 * total["dim"]), 2)
    # A group whose share of the centres would be under two has none: its vectors meet block by block.
    drawn = want.withColumn("want", F.col("want") * min(1.0, most / total["n"])).where("want >= 2").select("label", "dim", (F.col("want") / F.col("size")).alias("share"))
    place = F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(1 << 30)) / float(1 << 30)
    picked = classes.join(drawn, ["label", "dim"]).where(place < F.col("share")).select("label", "dim", "rep", "embedding").limit(4 * most)
    nets: dict[tuple, list] = {}
    for r in sorted(picked.collect(), key=lambda r: (str(r["label"]), r["dim"], r["rep"])):  # `most` rows about
        nets.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    return {k: _units(np.array(x, np.float64)) for k, x in nets.items()}


def _spread(rows: DataFrame, blocks: str) -> DataFrame:
    """``rows`` with the block of each, by a hash of its id."""
    return rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int"))


def _meetings(classes: DataFrame, shard: int, threshold: float) -> DataFrame:
    """Rows of every task: (label, dim, cell, kind, a, b) with the vectors of both sides.

    Kind 0: blocks a and b of a cell's members; kind 1: block a of the members, block b of the visitors.
    """
    spark = classes.sparkSession
    limit = math.sqrt(max(2 - 2 * threshold, 0))
    shared = spark.sparkContext.broadcast(_nets(classes, shard))
    names = ["label", "dim", "rep", "n", "embedding"]
    schema = ", ".join(f"`{c}` {classes.schema[c].dataType.simpleString()}" for c in names) + ", cell int, far double, visits array<struct<cell:int,far:double>>"
    dealt = staged(classes.select(*names).mapInArrow(lean(_deal(shared, limit)), schema), "cells")
    cell = ["label", "dim", "cell"]
    stats = dealt.groupBy(*cell).agg(F.max("far").alias("radius"), F.ceil(F.count("*") / shard).cast("int").alias("blocks"))
    stats = staged(stats, "stats")
    members = _spread(dealt.drop("visits").join(stats, cell), "blocks")
    data = ["rep", "n", "embedding"]
    other = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = other.select(
        *cell, F.lit(0).alias("kind"), F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") > F.col("other")).cast("int").alias("side"), *data
    )
    guests = dealt.select("label", "dim", F.explode("visits").alias("v"), *data).select("label", "dim", F.col("v.cell").alias("cell"), F.col("v.far").alias("far"), *data)
    guests = guests.join(stats, cell).where(F.col("far") <= F.col("radius") + limit + _SLACK)
    crowd = guests.groupBy(*cell).agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    crowd = staged(crowd, "guests")
    coming = _spread(guests.join(crowd, cell), "parts").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hosts = members.join(crowd, cell).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one = F.lit(1)
    return own.union(coming.select(*cell, one.alias("kind"), "a", F.col("block").alias("b"), one.alias("side"), *data)).union(
        hosts.select(*cell, one.alias("kind"), F.col("block").alias("a"), "b", F.lit(0).alias("side"), *data)
    )


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.98, shard: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Two vectors are linked when their labels are equal and not null and their cosine, in double
    precision, is ``threshold`` or more. Null or zero vectors, and those that hold a null or
    non-finite component, link with nothing: n_links 0, their own component. Vectors of
    different lengths are never linked. Equal vectors link as any others; rows that repeat a
    vec_id share its links and count as separate vectors. A null vec_id: n_links 0, component_id
    null, not kept. Ids and labels may be of any type that can be compared. An empty table gives no
    rows; other columns are ignored. ``shard`` bounds the vectors of one side of a task.
    """
    tune(vectors.sparkSession, 10_000)
    v = pick(vectors, "vec_id", "embedding", "label")
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = v.where(sound)
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = staged(classes.withColumn("dim", F.size("embedding")), "vectors")
    kind = v.schema["vec_id"].dataType.simpleString()
    tasks = _meetings(classes, shard, threshold).groupBy("label", "dim", "cell", "kind", "a", "b")
    found = staged(tasks.applyInPandas(_task(threshold), f"rep {kind}, links long, root {kind}"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("root").alias("a"), F.col("rep").alias("b")))
    per_class = staged(
        classes.join(links, "rep", "left")
        .join(label, F.col("rep") == F.col("id"), "left")
        .select("label", "embedding", "rep", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "classes",
    )
    # Classes of over a thousandth of all rows number a thousand at most: they are broadcast, so no task gets all copies.
    heavy = F.col("n") > F.lit(max((classes.agg(F.sum("n")).first()[0] or 0) // 1000, 1))
    same = lambda c: (good["label"] == c["label"]) & (good["embedding"] == c["embedding"])
    often, seldom = per_class.where(heavy), per_class.where(~heavy)
    out = ["vec_id", "n_links", "component_id"]
    common = good.join(F.broadcast(often), same(often)).select(*out)
    rare = good.join(F.broadcast(often), same(often), "left_anti").join(seldom.drop("rep", "n"), ["label", "embedding"]).select(*out)
    rest = v.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return common.union(rare).union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: DuckDB SQL for ``embedding_near_duplicates(embeddings)``: every pair of a label.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda t: t * t))) AS norm FROM v
    WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda t: t IS NULL OR NOT isfinite(t))) = 0 AND list_sum(list_transform(x, lambda t: t * t)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM v JOIN r ON id = vec_id LEFT JOIN n ON a = vec_id GROUP BY vec_id
"""
