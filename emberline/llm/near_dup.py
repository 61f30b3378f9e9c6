"""Near-duplicate documents by SuperMinHash, banding, exact verification and union-find.

Plan, in the order of the data:

1. One Arrow pass hashes each whole text into its set of word shingles, and the set into a
   SuperMinHash signature. Only a digest of the set and one hash a band leave the pass.
2. Documents with equal sets form a class; only class representatives go on, so a group of
   exact copies of any size weighs one row.
3. Representatives that share a band's hash share a bucket. Each bucket is a star around its
   most central member (the pivot), so a bucket of n members makes n - 1 pairs.
4. Pairs are verified on their full sets. Two members that are not both linked to their pivot
   can still be linked to each other; those pairs are found exactly by a prefix filter on the
   shingles that the pivot lacks, and verified on their full sets as well.
5. Links become components; every document takes the smallest id of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import lean, pick, staged, tune
from ._text import _GOLD, hash_batch, mix, shingles
from .components import components


#: Offsets that tell the random draws of the steps apart.
_STEP = (np.arange(1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * _GOLD


def superminhash(sets: list[np.ndarray], k: int, seed: int = 1) -> np.ndarray:
    """SuperMinHash signatures of sets of 64-bit hashes, as a (len(sets), k) uint64 array.

    Every element draws a random permutation of the k positions and, at step j, competes at
    its j-th position with rank j plus a random fraction; the smallest rank wins. A set is
    done as soon as all its positions hold ranks under j + 1, which for sets much larger than
    k is after one or two steps. An empty set keeps the largest rank everywhere.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), k), top, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(owner):
        return out
    x = mix(np.concatenate(sets) ^ _STEP[seed])
    order: np.ndarray | None = None
    for j in range(k):
        r = mix(x + _STEP[j])
        swap = (j + (mix(r ^ _GOLD) >> np.uint64(32)) % np.uint64(k - j)).astype(np.int64)
        if order is None:
            at = swap
        else:
            rows = np.arange(len(x))
            at, own = order[rows, swap].astype(np.int64), order[rows, j].copy()
            order[rows, swap] = own
            order[rows, j] = at
        np.minimum.at(flat, owner * k + at, (np.uint64(j) << np.uint64(48)) | (r >> np.uint64(16)))
        open_ = (out >> np.uint64(48)).max(axis=1) > j
        keep = open_[owner]
        if not keep.any():
            break
        if order is None:
            owner, x, swap = owner[keep], x[keep], swap[keep]
            order = np.tile(np.arange(k, dtype=np.uint8 if k < 256 else np.uint16), (len(x), 1))
            rows = np.arange(len(x))
            order[rows, swap] = order[rows, 0]
            order[:, 0] = swap
        elif not keep.all():
            owner, x, order = owner[keep], x[keep], order[keep]
    return out


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each run of ``rows`` positions, different between bands."""
    n = signatures.shape[1] // rows
    acc = np.zeros((len(signatures), n), np.uint64) + np.arange(1, n + 1, dtype=np.uint64) * _GOLD
    for i in range(rows):
        acc = mix(acc ^ signatures[:, i : n * rows : rows])
    return acc


def _sketch(k: int, rows: int):
    block = 50_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(w) for w in hash_batch(batch.column(1).to_pylist())]
            at = 0
            while at < len(sets):
                end, size = at, 0
                while end < len(sets) and (end == at or size + len(sets[end]) <= block):
                    size += len(sets[end])
                    end += 1
                part = sets[at:end]
                b = bands(superminhash(part, k), rows)
                one = [int(mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in part]
                two = [int(np.bitwise_xor.reduce(mix(s ^ _GOLD))) if len(s) else 0 for s in part]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * b.shape[1], pa.int32()), pa.array(b.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array([len(s) for s in part], pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), listed],
                    ["doc_id", "n_shingles", "set_1", "set_2", "bands"],
                )
                at = end

    return run


def _compare(own: bool):
    """Rows (p, x, text of p, text of x) to exact overlaps; own: also the shingles of x that p lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            ps = batch.column(2).to_pylist()
            xs = [shingles(w) for w in hash_batch(batch.column(3).to_pylist())]
            n_p, n_x, both, rest = [], [], [], []
            for p, x in zip(ps, xs, strict=True):
                if p != last[0]:
                    last = (p, shingles(hash_batch([p])[0]))
                s = last[1]
                at = np.searchsorted(s, x)
                hit = s[np.minimum(at, len(s) - 1)] == x if len(s) else np.zeros(len(x), bool)
                n_p.append(len(s))
                n_x.append(len(x))
                both.append(int(hit.sum()))
                if own:
                    rest.append(x[~hit].view(np.int64))
            cols = [batch.column(0), batch.column(1), pa.array(n_p, pa.int64()), pa.array(n_x, pa.int64()), pa.array(both, pa.int64())]
            names = ["p", "x", "n_p", "n_x", "both"]
            if own:
                cols.append(pa.array(rest, pa.list_(pa.int64())))
                names.append("own")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


#: Pairs of one pivot that are verified together; a pivot with more is sent to several tasks.
FAN = 64


def _verified(pairs: DataFrame, texts: DataFrame, num: int, den: int, own: bool) -> DataFrame:
    """Exact overlap of each pair (p, x), from the whole texts.

    The pairs of one pivot are dealt over as many salts as keep them to about FAN each, so the
    texts of a large star do not meet in one task; the pivot's text goes to each salt.
    """
    t = texts.select(F.col("doc_id").alias("id"), "text")
    fans = pairs.groupBy("p").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"))
    salted = pairs.join(fans, "p").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("fan")).cast("int"))
    with_x = salted.join(t, F.col("x") == F.col("id")).select("p", "salt", "x", F.col("text").alias("text_x"))
    pivots = fans.join(t, F.col("p") == F.col("id")).select("p", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), F.col("text").alias("text_p"))
    rows = with_x.join(pivots, ["p", "salt"]).select("p", "x", "text_p", "text_x")
    schema = "p long, x long, n_p long, n_x long, both long" + ", own array<long>" * own
    return rows.mapInArrow(lean(_compare(own)), schema).withColumn("linked", F.expr(f"{den} * both >= {num} * (n_p + n_x - both)"))


def sieve(rows: DataFrame, column: str, wanted: DataFrame, key: str, most_bits: int = 1 << 27, inside: bool = True) -> DataFrame:
    """Rows whose ``column`` may occur among ``wanted``'s keys: a bitmap filter before a shuffle.

    Without ``inside``: the other rows, which surely don't occur there, nulls included.

    The bitmap has 32 bits a key and ``most_bits`` at most (2 million rows of 64 bits), so what
    is broadcast is bounded whatever the number of keys; a full bitmap only filters less.
    """
    bits = min(most_bits, 1 << max(10, (32 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = wanted.select(place(F.col(key)).alias("place")).groupBy(F.floor(F.col("place") / 64).alias("word"))
    bitmap = words.agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("set"))
    at = place(rows[column])
    placed = rows.withColumn("__sieve_word", F.floor(at / 64)).withColumn("__sieve_bit", F.pmod(at, F.lit(64)).cast("int"))
    hit = placed.join(F.broadcast(bitmap), F.col("__sieve_word") == F.col("word"), "inner" if inside else "left").withColumn("__sieve_hit", F.expr("coalesce(shiftright(set, __sieve_bit) & 1 = 1, false)"))
    return hit.where("__sieve_hit" if inside else "not __sieve_hit").select(*rows.columns)


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, k: int = 125, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Documents are linked when their sets of distinct 5-word shingles have a Jaccard similarity
    of num / den or more. Every reported link is confirmed on full sets. With 25 bands of 5 rows
    a pair at 0.85 is missed with probability 4e-7, at 0.8 with 5e-5.

    Texts that are null, empty or without words: n_shingles 0, linked with nothing, kept.
    Texts under five words: one shingle, the whole sequence. Rows that repeat a doc_id count as
    one document. A null doc_id: component_id null, not kept, linked with nothing. An empty
    table gives no rows. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = pick(docs, "doc_id", "text")
    sketch = staged(docs.mapInArrow(lean(_sketch(k, rows)), "doc_id long, n_shingles long, set_1 long, set_2 long, bands array<long>"), "sketch")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = staged(full.groupBy("n_shingles", "set_1", "set_2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")

    placed = staged(classes.select("rep", F.explode("bands").alias("bucket")).distinct(), "placed")
    crowded = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    placed = staged(placed.join(crowded, "bucket"), "crowded")
    central = placed.groupBy("rep").agg(F.sum("size").alias("weight"))
    ranked = placed.join(central, "rep").select("bucket", "rep", F.struct(F.col("weight"), (-F.col("rep")).alias("neg")).alias("rank"))
    pivots = ranked.groupBy("bucket").agg((-F.max("rank")["neg"]).alias("p"))
    stars = staged(placed.join(pivots, "bucket").where("p <> rep").select("p", F.col("rep").alias("x")).distinct(), "stars")

    wanted = stars.select(F.col("x").alias("id")).union(stars.select("p")).distinct()
    wanted = staged(wanted, "wanted")
    texts = staged(sieve(docs, "doc_id", wanted, "id").join(wanted, F.col("doc_id") == F.col("id"), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    checked = staged(_verified(stars, texts, num, den, True), "checked")
    first = checked.where("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))

    label = components(first)
    links = first.union(_rest(checked, label, texts, num, den))
    twins = full.join(classes.select("n_shingles", "set_1", "set_2", "rep"), ["n_shingles", "set_1", "set_2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    label = components(links)
    member = twins.join(label, F.col("a") == F.col("id"), "left").select(F.col("b").alias("member"), F.coalesce("component", "a").alias("component"))
    found = staged(label.select(F.col("id").alias("member"), "component").union(member).groupBy("member").agg(F.min("component").alias("component")), "found")
    return (
        sketch.join(found, F.col("doc_id") == F.col("member"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def _rest(checked: DataFrame, label: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Links between members of one star of which one at least is not linked to the pivot.

    Take members x and y of the star of p with |x & y| >= t * max(|x|, |y|), t the threshold.
    Either they share a shingle that p lacks: then at least t * |x| - |x & p| of them, so they
    meet within the prefixes of their own shingles, the ones rarest in the star first, that
    leave out one less than that many. Shingles of one member only fill prefixes, but can't
    meet, so they are counted and not kept. Or all they share is in p: then both have t of their
    size in p, and the smaller of the two overlaps with p bounds theirs.
    """
    open_ = checked.where("not linked").select("p").distinct()
    crowd = checked.groupBy("p").agg(F.count("*").alias("n")).where("n > 1")
    stars = checked.join(open_, "p", "left_semi").join(crowd, "p", "left_semi")
    stars = staged(stars.join(label, F.col("x") == F.col("id"), "left").select("p", "x", "n_x", "both", "linked", "own", F.coalesce("component", "x").alias("c")), "open")
    own = stars.select("p", "x", F.explode("own").alias("s"))
    often = own.groupBy("p", "s").agg(F.count("*").alias("n")).where("n > 1")
    member = Window.partitionBy("p", "x")
    met = own.join(often, ["p", "s"]).withColumn("turn", F.row_number().over(member.orderBy("n", "s"))).withColumn("shared", F.count("*").over(member))
    rare = (
        met.join(stars.drop("own"), ["p", "x"])
        .where(f"turn <= shared + 1 - greatest(1, ceil({num} * n_x / {den}) - both)")
        .select("p", "x", "n_x", "both", "linked", "c", "s")
    )
    left, right = rare.where("not linked").alias("l"), rare.alias("r")
    size = f"{den} * least(l.n_x, r.n_x) >= {num} * greatest(l.n_x, r.n_x)"
    shared = left.join(right, F.expr(f"l.p = r.p and l.s = r.s and l.c <> r.c and {size} and {num + den} * (least(l.both, r.both) + least(l.n_x - l.both, r.n_x - r.both)) >= {num} * (l.n_x + r.n_x)"))
    inside = stars.where(f"{den} * both >= {num} * n_x").drop("own")
    under = inside.where("not linked").alias("l").join(
        inside.alias("r"), F.expr(f"l.p = r.p and l.c <> r.c and {size} and {num + den} * least(l.both, r.both) >= {num} * (l.n_x + r.n_x)")
    )
    pairs = shared.select("l.x", "r.x").union(under.select("l.x", "r.x")).toDF("u", "v")
    pairs = staged(pairs.select(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("x")).distinct(), "rest")
    return _verified(pairs, texts, num, den, False).where("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))


def deduplicated(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of ``docs`` (all columns) without near-duplicates: of each group the smallest doc_id stays.

    Rows with a null doc_id or without words stay. Of rows that repeat a doc_id one stays (the
    smallest text). Texts are shuffled only for ids that may go: the bitmap of ``sieve`` lets
    the others pass in place.
    """
    found = staged(near_duplicates(docs, num, den).where("doc_id is not null").select("doc_id", "kept"), "kept")
    gone = found.where("not kept").select("doc_id").union(found.groupBy("doc_id").count().where("count > 1").select("doc_id")).distinct().withColumnRenamed("doc_id", "gone")
    gone = staged(gone, "gone")
    if gone.isEmpty():
        return docs
    # Of the rows that the bitmap holds back, only those whose id is not gone at all move their texts.
    stay = sieve(docs, "doc_id", gone, "gone", inside=False)
    spare = staged(sieve(docs.select("doc_id"), "doc_id", gone, "gone").distinct().join(gone, F.col("doc_id") == F.col("gone"), "left_anti").withColumnRenamed("doc_id", "spare"), "spare")
    again = staged(found.where("kept").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")), "again")
    nameless = sieve(docs, "doc_id", gone, "gone").where("doc_id is null")
    single = sieve(docs, "doc_id", spare, "spare").join(spare, F.col("doc_id") == F.col("spare"), "left_semi")
    out = stay.unionByName(nameless).unionByName(single)
    if again.isEmpty():
        return out
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = sieve(docs, "doc_id", again, "again").join(again, F.col("doc_id") == F.col("again"), "left_semi")
    first = rows.groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("row"))
    return out.unionByName(first.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"row.{c}").alias(c) for c in docs.columns]))


#: DuckDB SQL for ``near_duplicates(documents, 85, 100)``: shingles as texts, every pair that shares one.
ORACLE_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT doc_id, any_value(n) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM n JOIN r ON id = doc_id GROUP BY doc_id
"""
