"""Exact quantiles of many columns and groups, by brackets that are narrowed round by round.

An aggregate of bounded size estimates where a quantile lies and gives a bracket of values around it. One
pass counts, for all columns, groups and probabilities, the rows below and inside their brackets;
a bracket that holds too many different rows is narrowed again. What is left inside is counted by
value, and ranks choose the two values between which the quantile lies. No state grows with the table:
it is a bracket for each column, group and probability, and at most ``INSIDE`` values in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which values are counted in one map, which then has a bound.
MAPPED = 1_000_000
#: Rows of a bracket that are counted by value.
INSIDE = 20_000
#: Rounds of narrowing; each divides a bracket's rows by hundreds, so that ties alone reach the last.
ROUNDS = 12
_ACCURACY = 2_000


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float], by: list[str] | None = None, mapped: int | None = None, inside: int | None = None) -> DataFrame:
    """(by..., column_name, q): ``q`` has the quantiles, between ranks by proportion; nulls don't count, and a column
    or group without values has a null ``q``. Null group keys are a group."""
    by = by or []
    mapped, inside = MAPPED if mapped is None else mapped, INSIDE if inside is None else inside
    number = lambda c: F.col(c).cast("double")
    if df.limit(mapped + 1).count() <= mapped:
        row = df.groupBy(*by).agg(*[F.percentile(number(c), F.array(*map(F.lit, probabilities))).alias(f"_q{i}") for i, c in enumerate(columns)])
        return row.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_q{i}").alias("q")) for i, c in enumerate(columns)])))
    spark = df.sparkSession
    tall = df.select(F.struct(*by).alias("g") if by else F.lit(0).alias("g"), F.inline(F.array(*[F.struct(F.lit(c).alias("c"), number(c).alias("v")) for c in columns])))
    groups = tall.groupBy("g", "c").agg(F.count("v").alias("n"))
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(probabilities)], "i int, p double")
    # Ranks from 0: the quantile lies between rank and rank + 1; a bracket holds both.
    place = F.col("p") * (F.col("n") - 1)
    state = groups.where("n > 0").crossJoin(F.broadcast(asked)).select("g", "c", "i", place.alias("place"), F.floor(place).alias("rank"), "n", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("held"), F.lit(False).alias("done"))
    width = 3 / _ACCURACY
    kind = state.schema
    rows = state.collect()  # a row a group, column and probability
    same = lambda a, b: a["g"].eqNullSafe(b["g"]) & (a["c"] == b["c"])
    for _ in range(ROUNDS):
        if not any(r["held"] > inside and not r["done"] for r in rows):
            break
        state = spark.createDataFrame(rows, kind)
        wide = F.broadcast(state.where((F.col("held") > inside) & ~F.col("done")))
        part = tall.alias("t").join(wide.alias("s"), same(tall, wide) & tall["v"].between(F.col("s.lo"), F.col("s.hi"))).select("s.*", "t.v")
        share = [i / 200 for i in range(201)]
        cuts = part.groupBy("g", "c", "i").agg(F.percentile_approx("v", F.array(*map(F.lit, share)), F.lit(_ACCURACY)).alias("cuts"), F.min("v").alias("least"), F.max("v").alias("greatest"))
        to = (F.col("rank") - F.col("below")) / F.col("held")
        low, high = F.floor((to - width) * 200).cast("int") - 1, F.ceil((to + width) * 200).cast("int") + 1
        found = state.alias("s").join(cuts.withColumnsRenamed({"g": "_g", "c": "_c", "i": "_i"}), F.col("g").eqNullSafe(F.col("_g")) & (F.col("c") == F.col("_c")) & (F.col("i") == F.col("_i")))
        new = F.broadcast(found.select("g", "c", "i", F.when(low >= 0, F.get("cuts", low)).otherwise(F.col("least")).alias("a"), F.when(high <= 200, F.get("cuts", high)).otherwise(F.col("greatest")).alias("b")))
        count = tall.alias("t").join(new.alias("s"), same(tall, new)).groupBy("s.g", "s.c", "s.i").agg(
            F.first("a").alias("a"), F.first("b").alias("b"), F.sum((F.col("v") < F.col("a")).cast("long")).alias("below"), F.sum(F.col("v").between(F.col("a"), F.col("b")).cast("long")).alias("held")
        )
        got = {(r["g"], r["c"], r["i"]): r for r in count.collect()}
        moved = []
        for r in rows:
            g = got.get((r["g"], r["c"], r["i"]))
            d = r.asDict(recursive=False)
            if g is not None:
                fits = g["below"] <= r["rank"] and min(r["rank"] + 2, r["n"]) <= g["below"] + g["held"]
                d |= {"lo": g["a"], "hi": g["b"], "below": g["below"], "held": g["held"], "done": g["a"] == g["b"] or g["held"] == r["held"]} if fits else {"done": True}
            moved.append(tuple(d[f.name] for f in kind.fields))
        rows = [dict(zip(kind.fieldNames(), m, strict=True)) for m in moved]
        rows = spark.createDataFrame([tuple(r.values()) for r in rows], kind).collect()
    state = F.broadcast(spark.createDataFrame(rows, kind))
    left = tall.alias("t").join(state.alias("s"), same(tall, state) & tall["v"].between(F.col("s.lo"), F.col("s.hi"))).groupBy("s.g", "s.c", "s.i", "place", "rank", "below", "t.v").agg(F.count("*").alias("m"))
    order = Window.partitionBy("g", "c", "i").orderBy("v")
    ranked = left.withColumn("to", F.col("below") + F.sum("m").over(order)).withColumn("from", F.col("to") - F.col("m"))
    at = lambda r: F.max(F.when((F.col("from") <= r) & (r < F.col("to")), F.col("v")))
    ends = ranked.groupBy("g", "c", "i", "place", "rank").agg(at(F.col("rank")).alias("one"), at(F.col("rank") + 1).alias("two"))
    value = F.when(F.col("two").isNull() | (F.col("place") == F.col("rank")) | (F.col("one") == F.col("two")), F.col("one"))
    value = value.otherwise((F.col("rank") + 1 - F.col("place")) * F.col("one") + (F.col("place") - F.col("rank")) * F.col("two"))
    q = ends.groupBy("g", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", value.alias("x")))), lambda s: s["x"]).alias("q")).withColumnsRenamed({"g": "_g", "c": "_c"})
    out = groups.join(q, F.col("g").eqNullSafe(F.col("_g")) & (F.col("c") == F.col("_c")), "left")
    return out.select(*[F.col("g")[b].alias(b) for b in by], F.col("c").alias("column_name"), "q")
