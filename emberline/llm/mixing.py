"""Mixing sources to target weights by min-cost flow, then selection of seeded documents.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow
network routes words from patterns to source quotas; the first pass over a pattern's words is
free and every further repetition costs more, so capacity is repeated only where it must be.
Only pattern totals reach the driver. A pattern's quota then becomes whole passes plus a
prefix of its documents in seeded order, found from sums over hash buckets.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import pick, staged

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, cap: float) -> dict[str | None, float]:
    """Words wanted from each source: ``share`` of all words dealt by weight, none above cap times its size.

    Sources take the weights in turn, ordered by code point, null last. The excess of capped
    sources is dealt again by weight among the others until none is above its cap.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        deal = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if deal[s] > cap * sizes[s]]
        if not above:
            return out | deal
        for s in above:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def route(capacity: dict[str, int], member: dict[str, list], quota: dict, passes: int) -> dict[str, int]:
    """Words to take from each pattern: a min-cost flow with convex repetition costs.

    Pass r over a pattern's words costs r a word, the same for all patterns, so a flow that is
    maximal pass by pass (augmented along shortest residual paths) has the least total cost.
    """
    flow: dict[tuple, int] = {}
    used = dict.fromkeys(capacity, 0)
    left = dict(quota)
    holders: dict = {}
    for p, sources in member.items():
        for s in sources:
            holders.setdefault(s, []).append(p)
    for r in range(1, passes + 1):
        while True:
            seen: dict = {}
            queue = deque()
            for p in capacity:
                if used[p] < r * capacity[p]:
                    seen["p", p] = None
                    queue.append(("p", p))
            end = None
            while queue and end is None:
                kind, at = node = queue.popleft()
                if kind == "p":
                    for s in member[at]:
                        if ("s", s) not in seen:
                            seen["s", s] = node
                            if left.get(s, 0) > 0:
                                end = ("s", s)
                                break
                            queue.append(("s", s))
                else:
                    for p in holders[at]:
                        if ("p", p) not in seen and flow.get((p, at), 0) > 0:
                            seen["p", p] = node
                            queue.append(("p", p))
            if end is None:
                break
            path = [end]
            while seen[path[-1]] is not None:
                path.append(seen[path[-1]])
            path.reverse()
            room = min(left[end[1]], r * capacity[path[0][1]] - used[path[0][1]])
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "s":
                    room = min(room, flow[b[1], a[1]])
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "p":
                    flow[a[1], b[1]] = flow.get((a[1], b[1]), 0) + room
                else:
                    flow[b[1], a[1]] -= room
            used[path[0][1]] += room
            left[end[1]] -= room
    return used


def _sized(docs: DataFrame, keep: list[str], sources: str, seed: int) -> DataFrame:
    """``keep`` columns with pattern, its key, size in words, and the seeded order (h, bucket) of each row."""
    listed = docs.schema[sources].dataType.typeName() == "array"
    source = docs[sources]
    pattern = F.array_sort(F.array_distinct(source)) if listed else F.array(source)
    if listed:
        pattern = F.when(F.coalesce(F.size(pattern), F.lit(0)) > 0, pattern).otherwise(F.array(F.lit(None).cast("string")))
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(*[docs[c].alias(f"_{c}") for c in keep], pattern.alias("pattern"), size.alias("size"), docs["doc_id"].alias("doc"))
    d = d.withColumn("key", F.to_json(F.struct("pattern"))).withColumn("h", F.xxhash64(F.lit(seed), "doc", "size"))
    return d.withColumn("bucket", F.shiftrightunsigned("h", 52))


def _quotas(sized: DataFrame, weights: tuple[float, ...], share: float, cap: int, max_patterns: int) -> DataFrame:
    """One row a pattern: source_size, target, whole passes, words beyond them, and the hash bucket
    (edge) in which a further pass ends, with the words left for it (room)."""
    totals = sized.groupBy("key").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(totals) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    member = {r["key"]: list(r["pattern"]) for r in totals}
    capacity = {r["key"]: r["size"] for r in totals}
    sizes: dict[str | None, int] = {}
    for key, names in member.items():
        for s in names:
            sizes[s] = sizes.get(s, 0) + capacity[key]
    goal = targets(sizes, weights, share, cap)
    take = route(capacity, member, {s: round(t) for s, t in goal.items()}, cap)
    rows = {}
    for key, names in member.items():
        whole, rest = divmod(take[key], capacity[key]) if capacity[key] else (0, 0)
        rows[key] = (key, sizes[names[0]], float(goal[names[0]]), whole, rest)
    spark = sized.sparkSession
    schema = "key string, source_size long, target double, whole long, rest long"
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        sized.groupBy("key", "bucket")
        .agg(F.sum("size").alias("sum"))
        .withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
        .join(spark.createDataFrame(list(rows.values()), schema).select("key", "rest"), "key")
        .where("before <= rest and rest < before + sum")
        .select("key", "bucket", F.col("rest") - F.col("before"))
        .collect()  # one row a pattern at most
    )
    edge = {r[0]: (r[1], r[2]) for r in edges}
    return spark.createDataFrame([(*r, *edge.get(k, (None, None))) for k, r in rows.items()], schema + ", edge long, room long")


def _taken(sized: DataFrame, quotas: DataFrame, cut: bool) -> DataFrame:
    """Adds source_size, target and taken. Only rows of a pattern's edge bucket are put in order."""
    d = sized.join(F.broadcast(quotas), "key")  # a row a pattern, max_patterns at most
    plain = d.where("edge is null or bucket <> edge").withColumn("extra", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0))
    at = Window.partitionBy("key").orderBy("h", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = d.where("bucket = edge").withColumn("done", F.coalesce(F.sum("size").over(at), F.lit(0)))
    spare = F.greatest(F.lit(0), F.col("room") - F.col("done"))
    part = F.least("size", spare) if cut else F.when(2 * spare >= F.col("size"), F.col("size")).otherwise(0)
    out = plain.unionByName(last.withColumn("extra", part).drop("done"))
    return out.withColumn("taken", (F.col("whole") * F.col("size") + F.col("extra")).cast("long"))


def mix(
    docs: DataFrame, sources: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 7, cut: bool = True, max_patterns: int = 100_000
) -> DataFrame:
    """Words to take from every document: (doc_id, size, source_size, target, taken).

    ``docs`` holds doc_id, text and ``sources``, a string or an array of strings where a
    document belongs to several. ``source_size`` and ``target`` are those of the source (of the
    first by code point where there are several). With ``cut`` the last document of a
    pattern's seeded order is taken in part, so each source meets its target to a word; without
    it that document is taken whole or not, whichever comes nearer. A null text has size 0 and
    gives nothing; a null source (or an empty array) is a source of its own, last in order.
    Repeated rows are documents of their own. An empty table gives no rows; extra columns are
    ignored. More than ``max_patterns`` membership patterns are refused, since the
    flow network is solved on the driver.
    """
    sized = staged(_sized(pick(docs, "doc_id", "text", sources), [], sources, seed), "sized")
    out = _taken(sized, _quotas(sized, weights, share, cap, max_patterns), cut)
    return out.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, sources: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 7, max_patterns: int = 100_000) -> DataFrame:
    """The rows of the mix, all columns of ``docs``: a document taken twice is there twice, one not taken isn't.

    As ``mix`` without ``cut``; texts stay in place but for those of the edge buckets.
    """
    sized = staged(_sized(pick(docs, "doc_id", "text", sources), [], sources, seed), "sized")
    out = _taken(_sized(docs, docs.columns, sources, seed), _quotas(sized, weights, share, cap, max_patterns), False)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    copies = out.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select(*[F.col(f"_{c}").alias(c) for c in docs.columns])
