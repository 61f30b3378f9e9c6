"""Fill-in-the-middle rewriting: documents cut at unit boundaries and put in another order, as joins and windows.

A unit is a run of ASCII letters or one other character. Exploding all units of all texts would
move a multiple of the input, so lengths are added up in two steps, both relational:

1. A text is matched into blocks of ``BLOCK`` units, left to right; ``posexplode`` gives one row a
   block with its length only. A window adds up the lengths of the blocks before each.
2. Cut requests, (document, unit ordinal), join the blocks by the block of their ordinal. Only
   those blocks (two a document at most) are exploded into units; a second window adds up the
   unit lengths, and the row of the requested ordinal gives the cut's place.
3. Places are aggregated a document and join the texts, which ``substring`` cuts.

Texts that are cut are shuffled once, others not at all. Whatever a text's length, a window's rows are small and can spill, and
nothing but the text itself has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import pick

#: Units of a block.
BLOCK = 64
#: Fixed values of the format: the marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_UNIT = "[A-Za-z]++|[^A-Za-z]"
#: Two independent 64-bit hashes of id and text; rows that agree in both are repeats of one row.
_KEY = ["_a", "_b"]


def n_units(text: Column) -> Column:
    """Number of units: the characters left when each run of letters becomes one."""
    return F.length(F.regexp_replace(text, "[A-Za-z]++", "a")).cast("long")


def draw(doc_id: Column, seed: str, i: int) -> Column:
    """The i-th (from 0) group of eight hex digits of the sha256 of seed:doc_id, as a number; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def unit_places(texts: DataFrame) -> DataFrame:
    """(key, cut, chars): the characters of a text up to the end of the unit of each cut request.

    ``texts`` has the key columns, ``text`` and ``ordinals``, a map from the name of a cut to the
    ordinal of a unit. Rows that repeat a key have equal texts and count once.
    """
    matched = F.regexp_extract_all("text", F.lit(f"(?:{_UNIT}){{1,{BLOCK}}}+"), F.lit(0))
    named = F.array_distinct(F.transform(F.map_values("ordinals"), lambda o: (o / BLOCK).cast("int")))
    # Rows are numbered before blocks are exploded: a row of repeats has sums of its own.
    cut = texts.withColumn("_row", F.monotonically_increasing_id()).withColumn("blocks", matched).withColumn("named", named)
    parts = F.transform("named", lambda b: F.struct(b.alias("block"), F.get("blocks", b).alias("part")))
    asked = cut.select(*_KEY, "ordinals", F.inline(parts)).groupBy(*_KEY, "block").agg(F.first("part").alias("part"), F.first("ordinals").alias("ordinals"))
    rows = cut.select(*_KEY, "_row", "named", F.posexplode(F.transform("blocks", F.length)).alias("block", "size"))
    rows = rows.select(*_KEY, "_row", "block", "size", F.array_contains("named", F.col("block")).alias("named"))
    before = Window.partitionBy(*_KEY, "_row").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where("named").groupBy(*_KEY, "block").agg(F.max("before").alias("before"))
    hit = asked.join(placed, [*_KEY, "block"]).select(*_KEY, "block", "part", "before", F.explode("ordinals").alias("cut", "ordinal"))
    hit = hit.withColumn("at", (F.col("ordinal") - F.col("block") * BLOCK).cast("int")).where(F.col("at").between(0, BLOCK - 1))
    units = hit.select(*_KEY, "block", "before", "cut", F.col("at").alias("asked"), F.posexplode(F.regexp_extract_all("part", F.lit(_UNIT), F.lit(0))).alias("at", "unit"))
    inside = Window.partitionBy(*_KEY, "block", "cut").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = units.select(*_KEY, "block", "before", "cut", "asked", "at", F.length("unit").alias("size")).withColumn("ends", F.col("before") + F.sum("size").over(inside))
    return summed.where("at = asked").select(*_KEY, "cut", F.col("ends").alias("chars"))


def fill_in_middle(docs: DataFrame, plain_from: int = 90, spm_below: int = 20, seed: str = "1") -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output): one row a row of ``docs``.

    Two places among the n units, drawn from the hash of the id, cut a text into prefix, middle and
    suffix. ``form`` is plain (``plain_from`` to 99 of 100 draws, and texts that are empty or hold a
    mark), spm (below ``spm_below`` of 100 second draws) or psm. Prefix, middle and suffix are null
    where plain; the output is the text then.

    A null text counts as empty, a null id as an empty one; repeated rows give equal results; long
    texts are cut like others, since no step holds their units at once; an empty table gives no
    rows; other columns are ignored.
    """
    base = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    base = base.withColumn("_a", F.xxhash64("doc_id", "text")).withColumn("_b", F.xxhash64(F.lit(1), F.col("doc_id"), F.col("text"))).withColumn("n", n_units(F.col("text")))
    h1, h2, h3, h4 = (draw(F.col("doc_id"), seed, i) for i in range(4))
    marked = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when(marked | (h3 % 100 >= plain_from), "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    lo, hi = F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)), F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))
    base = base.select("doc_id", "_a", "_b", "text", "n", form.alias("form"), lo.alias("lo"), hi.alias("hi"))
    # A cut after k > 0 units lies where unit k - 1 ends; one after none lies at 0 and asks for nothing.
    ordinals = F.map_filter(F.create_map(F.lit("lo"), F.col("lo") - 1, F.lit("hi"), F.col("hi") - 1), lambda _, ordinal: ordinal >= 0)
    places = unit_places(base.where("form <> 'plain'").select(*_KEY, "text", ordinals.alias("ordinals")))
    wide = places.groupBy(*[F.col(k).alias(f"{k}_") for k in _KEY]).agg(*[F.max(F.when(F.col("cut") == c, F.col("chars"))).alias(f"at_{c}") for c in ("lo", "hi")])
    # Only texts that are cut are shuffled.
    joined = base.where("form <> 'plain'").join(wide.hint("shuffle_hash"), [F.col(k) == F.col(f"{k}_") for k in _KEY], "left")
    joined = joined.unionByName(base.where("form = 'plain'"), allowMissingColumns=True)
    whole, first, second = F.col("text"), F.coalesce("at_lo", F.lit(0)).cast("int"), F.coalesce("at_hi", F.lit(0)).cast("int")
    held = lambda c: F.when(F.col("form") != "plain", c)
    parts = joined.select(
        "doc_id", "n", "form", whole, held(F.substring(whole, F.lit(1), first)).alias("prefix"), held(F.substring(whole, first + 1, second - first)).alias("middle"), held(F.substring(whole, second + 1, F.length(whole))).alias("suffix")
    )
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(whole).alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    cut = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(cut[1], cut[3], cut[2])).when(form == "spm", F.concat(cut[2], cut[3], cut[1])).otherwise(output)


def infill(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of ``fill_in_middle``."""
    hexed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    d = fill_in_middle(docs)
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return d.select("doc_id", "n", "form", *chars, hexed(F.col("output")).alias("output_sha256"), hexed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, h, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u FROM d),
c AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""
