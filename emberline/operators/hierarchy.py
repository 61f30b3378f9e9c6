"""The density hierarchy: spanning tree, condensed tree and excess of mass, kept in tables.

Rows are numbered 0, 1, ... and a component is named by its smallest row.

1. Edges are ranked by weight and cut into ranges of ranks. What joins inside a range depends on
   earlier ranges only through the components that they leave, so halving the ranks again and again, and
   contracting the components of each lower half for the upper one, makes all ranges independent.
   A range has a bounded number of edges; its merges are found in one task, all ranges side by side.
2. A merge of components p < q is a row with both sizes; q ends there. Merges of large components
   (``min_cluster_size`` rows at least) carry the condensed tree: two large sides split a cluster, a
   large and a small side let rows fall out of one, two small sides that are large together begin one.
3. Pointers from each merge to the one before it in its component lead to the merge that began its
   cluster; pointers of small components lead each row to the merge at which it falls out. Both are
   followed by doubling.
4. Stabilities are sums over merges. The tree of clusters, which has one row a cluster and a stated bound,
   is the only thing that the driver sees.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .tiles import copy_number, exact, run_position, squares, tiled

#: Rows up to which a table of pointers is followed in one task.
SMALL = 100_000
_NODE = 40  # bits of a row's number in a code of range and row


def positions(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """``df`` with 0, 1, ... in the order of some columns (distinct together), by ranges and their counts."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    held = staged(ranged, "positions")
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = {r["p"]: r["n"] for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    first, rows = 0, []
    for p in sorted(counts):
        rows.append((p, first))
        first += counts[p]
    starts = df.sparkSession.createDataFrame(rows, "_p long, _first long")
    return held.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(out, F.col("_first") + inside).drop("_m", "_p", "_first")


def spread(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n, l): the smallest node that links (a, b) join with each node n.

    Minimum labels spread along links with pointer jumping until nothing changes.
    """
    links = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = nodes.select("n", F.col("n").alias("l"))
    while True:
        near = links.join(label, F.col("b") == F.col("n")).groupBy("a").agg(F.min("l").alias("m"))
        new = label.join(near, F.col("n") == F.col("a"), "left").select("n", F.col("l").alias("old"), F.least("l", F.coalesce("m", "l")).alias("l"))
        top = label.select(F.col("n").alias("t"), F.col("l").alias("u"))
        new = new.join(top, F.col("l") == F.col("t"), "left").select("n", "old", F.least("l", F.coalesce("u", "l")).alias("l"))
        new = staged(new, "components")
        label = new.select("n", "l")
        if new.where("l <> old").isEmpty():
            return label


def chase(pointers: DataFrame, small: int | None = None) -> DataFrame:
    """(k, t): where the pointers k -> t end up. A pointer to itself, or to a node without one, is an end.

    Rounds of doubling; only pointers that have not arrived meet the table. A small table is
    followed in one task.
    """
    small = SMALL if small is None else small
    table = staged(pointers.select("k", "t"), "pointers")
    if table.count() <= small:

        def follow(frames):
            f = pd.concat(list(frames), ignore_index=True).sort_values("k")
            k, t = f["k"].to_numpy(), f["t"].to_numpy()
            while len(k):
                at = np.minimum(np.searchsorted(k, t), len(k) - 1)
                new = np.where(k[at] == t, t[at], t)
                if (new == t).all():
                    break
                t = new
            yield pd.DataFrame({"k": k, "t": t})

        return table.coalesce(1).mapInPandas(follow, "k long, t long") if table.take(1) else table
    ends = table.select(F.col("k").alias("e"), F.col("t").alias("u"))
    table = table.join(ends, F.col("t") == F.col("e"), "left").select("k", "t", (F.col("u").isNull() | (F.col("u") == F.col("t"))).alias("done"))
    table = staged(table, "pointers")
    while not table.where("not done").isEmpty():
        target = table.select(F.col("k").alias("e"), F.col("t").alias("u"), F.col("done").alias("arrived"))
        moved = table.where("not done").join(target, F.col("t") == F.col("e")).select("k", F.col("u").alias("t"), F.col("arrived").alias("done"))
        table = staged(table.where("done").unionByName(moved), "pointers")
    return table.select("k", "t")


def _cheapest(c: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    """The first edge of each component by (w, lo, hi)."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo, w, c))
    order = order[run_position(c[order]) == 0]
    return pd.DataFrame({"c": c[order], "w": w[order], "lo": lo[order], "hi": hi[order]})


def _outgoing(a, xs, _, b, ys, __):
    """Kernel of a tile: the cheapest edge out of each component of rows that have (core, component, limit) behind their vector."""
    (x, core, comp, limit), (y, bc, bcomp, _) = ((t[:, :-3], t[:, -3], t[:, -2], t[:, -1]) for t in (xs, ys))
    order = np.argsort(b, kind="stable")
    order = order[copy_number(np.column_stack([y, bcomp, bc])[order]) == 0]  # of copies in one component the first will do
    b, y, bc, bcomp = b[order], y[order], bc[order], bcomp[order]
    most = np.maximum(limit, 0)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at, sq, error in squares(x, y):
        mine = slice(at, at + len(sq))
        np.maximum(sq, (bc * bc)[None, :], out=sq)
        np.copyto(sq, np.inf, where=comp[mine][:, None] == bcomp[None, :])
        error += 4 * np.finfo(float).eps * float(max((bc * bc).max(), (core[mine] ** 2).max()))
        least = np.minimum(np.maximum(sq.min(axis=1), core[mine] ** 2), most[mine] ** 2 * (1 + 1e-12))
        r, c = np.nonzero((sq <= least[:, None] + 2 * error) & np.isfinite(sq))
        r = at + r
        found.append((r, c, np.maximum(np.maximum(exact(x[r], y[c]), core[r]), bc[c])))
    r, c, w = (np.concatenate(t) for t in zip(*found, strict=True))
    return _cheapest(comp[r].astype(np.int64), a[r], b[c], w)


def spanning_tree(rows: DataFrame, lists: DataFrame, k: int, small: int | None = None) -> DataFrame:
    """(a, b, w) with a < b: the spanning tree that is least by mutual reachability, then by rows, in Boruvka rounds.

    ``rows`` has i (0, 1, ...), v and core; ``lists`` the ``k`` nearest rows of each (i, near, d). Both are read often:
    give written tables.

    Each round takes the cheapest outgoing edge of components, exactly. It is looked for in the
    lists: what they leave out is no closer than their last row, so a component whose listed edge
    is cheaper than that is settled. Where too few are, the rows in doubt of all components but the
    largest meet all rows, in tiles that return one candidate a component. Components are a table.
    """
    n = rows.count()
    empty = rows.select(F.col("i").alias("a"), F.col("i").alias("b"), F.col("core").alias("w")).limit(0)
    if n < 2:
        return empty
    core = rows.select("i", "core")
    of = lambda c, out: core.select(F.col("i").alias(c), F.col("core").alias(out))
    edges = lists.select("i", F.explode(F.arrays_zip("near", "d")).alias("e")).select("i", F.col("e.near").alias("j"), "e.d").join(of("i", "ci"), "i").join(of("j", "cj"), "j")
    edges = staged(edges.select("i", "j", F.greatest("d", "ci", "cj").alias("w")), "edges")
    last, size = F.element_at("d", -1), F.size("d")
    bounds = lists.join(core, "i").select(
        "i", F.when((size < min(k, n - 1)) | (size >= n - 1), float("inf")).otherwise(F.greatest(last, "core")).alias("bound"), ((F.col("d")[0] == last) & (F.col("core") <= last)).alias("copies")
    )
    bounds = staged(core.select("i").join(bounds, "i", "left").select("i", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), F.coalesce("copies", F.lit(False)).alias("copies")), "bounds")
    comp, left, done = rows.select("i", F.col("i").alias("c")), n, []
    named = lambda c, out: comp.select(F.col("i").alias(c), F.col("c").alias(out))
    first = F.min(F.struct("w", "lo", "hi")).alias("e")
    while left > 1:
        edges = staged(edges.select("i", "j", "w").join(named("i", "c"), "i").join(named("j", "other"), "j").where("c <> other"), "edges")
        listed = edges.groupBy("c").agg(F.min(F.struct("w", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))).alias("e"))
        nearest = edges.groupBy("i").agg(F.min("w").alias("w"))
        # A list of copies only: what it leaves out at the same distance has larger numbers.
        bound = F.when(F.col("copies") & F.coalesce(F.col("w") == F.col("bound"), F.lit(False)), float("inf")).otherwise(F.col("bound"))
        doubt = staged(bounds.join(nearest, "i", "left").join(named("i", "c"), "i").select("i", "c", bound.alias("bound")), "doubt")
        state = doubt.groupBy("c").agg(F.min("bound").alias("bound"), F.count("*").alias("rows")).join(listed, "c", "left")
        state = staged(state.select("c", "bound", "rows", "e", (F.col("e").isNotNull() & (F.col("e.w") < F.col("bound"))).alias("sure")), "components")
        sure = state.where("sure")
        if sure.count() * 4 < left:
            largest = state.orderBy(F.desc("rows"), "c").select("c").first()["c"]
            asked = state.where(~F.col("sure") & (F.col("c") != largest)).select("c", F.coalesce("e.w", F.lit(float("inf"))).alias("limit"))
            wide = lambda d, limit: d.select("i", F.concat("v", F.array("core", F.col("c").cast("double"), limit)).alias("v"))
            near = doubt.join(asked, "c").where(F.col("bound") <= F.col("limit")).select("i", "c", "limit").join(rows, "i")
            met = tiled(staged(wide(near, F.col("limit")), "doubtful"), staged(wide(rows.join(comp, "i"), F.lit(0.0)), "others"), _outgoing, "c long, w double, lo long, hi long", "i", "v")
            met = met.groupBy("c").agg(first)
            listed = asked.join(state.select("c", "e"), "c").select("c", "e").where("e is not null").unionByName(met).groupBy("c").agg(F.min("e").alias("e"))
            sure = sure.select("c", "e").unionByName(listed.select("c", "e"))
        chosen = sure.select("c", "e.*").join(named("lo", "one"), "lo").join(named("hi", "two"), "hi")
        chosen = staged(chosen.select("c", "w", "lo", "hi", F.when(F.col("one") == F.col("c"), F.col("two")).otherwise(F.col("one")).alias("t")), "chosen")
        done.append(staged(chosen.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "w").distinct(), "tree"))
        joined = done[-1].count()
        if not joined:
            raise ValueError("some rows have no finite distance to the others")
        # Components point to where their edge leads; of two that point at each other the smaller is the end.
        back = chosen.select(F.col("c").alias("t"), F.col("t").alias("back"))
        pointers = chosen.select("c", "t").join(back, "t", "left").select(F.col("c").alias("k"), F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("t")), F.col("c")).otherwise(F.col("t")).alias("t"))
        ends = staged(chase(pointers, small), "ends")
        moved = comp.join(F.broadcast(ends) if left <= SMALL else ends, F.col("c") == F.col("k"), "left")
        comp = staged(moved.select("i", F.coalesce("t", "c").alias("c")), "component")
        left -= joined
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def contracted(edges: DataFrame, total: int, leaf: int) -> DataFrame:
    """Edges (k, w, a, b), ranked 0 to total - 1, with their range ``sub`` and ends (a, b, sa, sb): the
    component, and its rows, that all edges of earlier ranges make of an end."""
    depth = max(0, math.ceil(math.log2(total / leaf))) if total > leaf else 0
    width = max(1, -(-total // (1 << depth)))
    e = edges.withColumn("r", (F.col("k") - F.col("k") % width) / width).withColumn("r", F.col("r").cast("long"))
    e = staged(e.select("r", "k", "w", "a", "b", F.lit(1).cast("long").alias("sa"), F.lit(1).cast("long").alias("sb")), "edges")
    for level in range(1, depth + 1):
        sub, upper = F.shiftright("r", depth - level + 1), F.shiftright("r", depth - level) % 2 == 1
        code = lambda c, sub=sub: F.shiftleft(sub, _NODE) + F.col(c)
        low, high = e.where(~upper), e.where(upper)
        ends = staged(low.select(code("a").alias("a"), code("b").alias("b"), "sa", "sb"), "ends")
        sizes = ends.select(F.col("a").alias("n"), F.col("sa").alias("s")).union(ends.select("b", "sb")).distinct()
        label = spread(ends, sizes)
        rows = sizes.join(label, "n").groupBy("l").agg(F.sum("s").alias("rows"))
        known = staged(label.join(rows, "l").select("n", F.col("l").bitwiseAND((1 << _NODE) - 1).alias("l"), "rows"), "contracted")
        for c, s in (("a", "sa"), ("b", "sb")):
            high = high.withColumn("_n", code(c)).join(known, F.col("_n") == F.col("n"), "left")
            high = high.withColumn(c, F.coalesce("l", c)).withColumn(s, F.coalesce("rows", s)).drop("_n", "n", "l", "rows")
        e = staged(low.unionByName(high), "edges")
    return e.withColumnRenamed("r", "sub")


def merges(edges: DataFrame, leaf: int = 1_000_000) -> DataFrame:
    """(k, w, p, q, sp, sq) of the edges (a, b, w) of a spanning tree over rows 0, 1, ...: the k-th merge, by
    (w, a, b), joins the component of row q, which ends, with that of p < q."""
    ranked = positions(edges.select("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["w", "a", "b"], "k")
    total = edges.count()

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k")
        nodes, code = np.unique(np.concatenate([f["a"], f["b"]]), return_inverse=True)
        n = len(f)
        size = np.zeros(len(nodes), np.int64)
        size[code[:n]], size[code[n:]] = f["sa"], f["sb"]
        size, root, out = size.tolist(), list(range(len(nodes))), []
        for i, j in zip(code[:n].tolist(), code[n:].tolist(), strict=True):
            while root[i] != i:
                root[i] = i = root[root[i]]
            while root[j] != j:
                root[j] = j = root[root[j]]
            i, j = min(i, j), max(i, j)
            out.append((i, j, size[i], size[j]))
            root[j] = i
            size[i] += size[j]
        p, q, sp, sq = np.array(out, np.int64).T
        return pd.DataFrame({"k": f["k"], "w": f["w"], "p": nodes[p], "q": nodes[q], "sp": sp, "sq": sq})

    return contracted(ranked, total, leaf).groupBy("sub").applyInPandas(join, "k long, w double, p long, q long, sp long, sq long")


def excess_of_mass(clusters: list[tuple[int, int | None, float, int | None]]) -> dict[int, int]:
    """Labels of clusters (id, parent, stability, smallest row), by smallest row; -1 for those in none that is kept.

    A cluster is kept where it is at least as stable as the kept ones below it; the root never is. A
    parent's id is larger than its children's.
    """
    below: dict[int | None, list[int]] = {}
    for c, parent, *_ in clusters:
        below.setdefault(parent, []).append(c)
    total, keeps = {}, set()
    for c, parent, stability, _ in sorted(clusters):
        under = sum(total[x] for x in below.get(c, []))
        if below.get(c) and (parent is None or under > stability):
            total[c] = under
        else:
            total[c] = stability
            if parent is not None:
                keeps.add(c)
    top: dict[int, int] = {}
    for c, parent, *_ in sorted(clusters, reverse=True):
        top[c] = top[parent] if parent is not None and top[parent] >= 0 else c if c in keeps else -1
    first = {c: row for c, _, _, row in clusters}
    name = {c: i for i, c in enumerate(sorted({t for t in top.values() if t >= 0}, key=lambda c: first[c]))}
    return {c: name.get(t, -1) for c, t in top.items()}


def condensed_labels(edges: DataFrame, rows: int, min_cluster_size: int, leaf: int = 1_000_000, most_clusters: int = 1_000_000, small: int | None = None) -> DataFrame:
    """(i, cluster) of rows 0 to rows - 1 from the edges (a, b, w) of their spanning tree; -1 is noise.

    Clusters are named by their smallest row. A split counts only if both sides have ``min_cluster_size`` rows;
    rows of a smaller side fall out at 1 / w. More than ``most_clusters`` clusters are refused.
    """
    spark, m = edges.sparkSession, min_cluster_size
    every = spark.range(rows).select(F.col("id").alias("i"))
    made = staged(merges(edges, leaf), "merges")
    kind = F.expr(f"CASE WHEN sp >= {m} AND sq >= {m} THEN 'split' WHEN sp >= {m} THEN 'q falls' WHEN sq >= {m} THEN 'p falls' WHEN sp + sq >= {m} THEN 'begins' ELSE 'small' END")
    made = made.withColumn("kind", kind).withColumn("level", F.when(F.col("w") > 0, F.least(1 / F.col("w"), F.lit(1e12))).otherwise(1e12))
    big = staged(positions(made.where("kind <> 'small'"), ["p", "k"]), "events")
    # The large merge before one in the component of p is the row before it; in that of q, the last one of q.
    earlier = big.select((F.col("pos") + 1).alias("pos"), F.col("p").alias("_p"), F.col("k").alias("of_p"))
    last = big.groupBy(F.col("p").alias("_q")).agg(F.max("k").alias("of_q"))
    linked = big.join(earlier, "pos", "left").withColumn("of_p", F.when(F.col("p") == F.col("_p"), F.col("of_p"))).join(last, F.col("q") == F.col("_q"), "left")
    linked = staged(linked.drop("_p", "_q", "pos"), "linked")
    pointer = F.when(F.col("kind") == "q falls", F.col("of_p")).when(F.col("kind") == "p falls", F.col("of_q")).otherwise(F.col("k"))
    cluster_of = staged(chase(linked.select("k", pointer.alias("t")), small), "cluster").select(F.col("k").alias("event"), F.col("t").alias("c"))
    splits = linked.where("kind = 'split'").select(F.col("k").alias("parent"), F.col("level").alias("birth"), F.inline(F.array(F.struct(F.col("of_p").alias("side"), F.col("p").alias("row")), F.struct(F.col("of_q").alias("side"), F.col("q").alias("row")))))
    children = staged(splits.join(cluster_of, F.col("side") == F.col("event")).select("c", "parent", "birth", "row"), "children")
    fallen = F.when(F.col("kind") == "q falls", F.col("sq")).when(F.col("kind") == "p falls", F.col("sp")).otherwise(F.col("sp") + F.col("sq"))
    parts = linked.select("k", fallen.alias("n"), "level").join(cluster_of, F.col("k") == F.col("event")).join(children, "c", "left")
    gain = F.sum(F.col("n") * (F.col("level") - F.coalesce("birth", F.lit(0.0))))
    clusters = parts.groupBy("c").agg(F.first("parent").alias("parent"), gain.alias("stability"), F.first("row").alias("row")).limit(most_clusters + 1).collect()
    if len(clusters) > most_clusters:
        raise ValueError(f"more than {most_clusters} clusters; take a larger min_cluster_size")
    names = excess_of_mass([tuple(r) for r in clusters])
    named = spark.createDataFrame(list(names.items()), "c long, cluster int")
    # A row follows its component while that is small, up to the merge at which its rows fall out.
    deaths = made.where("kind = 'small'").select(F.col("q").alias("k"), F.col("p").alias("t"))
    ends = chase(deaths, small).select(F.col("k").alias("i"), F.col("t").alias("end"))
    out_q = big.where("kind IN ('q falls', 'begins')").select(F.col("q").alias("end"), F.col("k").alias("event"))
    out_p = big.where("kind IN ('p falls', 'begins')").select(F.col("p").alias("end"), F.col("k").alias("event"))
    exits = out_q.union(out_p).join(cluster_of, "event").join(named, "c").select("end", "cluster")
    at = every.join(ends, "i", "left").withColumn("end", F.coalesce("end", "i"))
    return at.join(exits, "end", "left").select("i", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
