"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASONS = ("Winter", "Spring", "Summer", "Autumn/Fall")
#: Spellings of a missing text.
MISSING_TEXT = ("", " ", "NaN", "nan", "NULL", "null")


def season(month: Column) -> Column:
    """Meteorological season of a month number; anything else is Unknown."""
    return F.when(month.isin(12, 1, 2), SEASONS[0]).when(month.isin(3, 4, 5), SEASONS[1]).when(month.isin(6, 7, 8), SEASONS[2]).when(month.isin(9, 10, 11), SEASONS[3]).otherwise("Unknown")


def season_order(name: Column) -> Column:
    return reduce(lambda c, i: c.when(name == SEASONS[i], i), range(1, 4), F.when(name == SEASONS[0], 0)).otherwise(4)


def parse_date(text: Column) -> Column:
    """Timestamp of a text; NULL where it is none."""
    return F.try_to_timestamp(text.cast("string"))


def percent_text(share: Column, places: int = 2) -> Column:
    """25.0 -> '25.0%', rounded half to even."""
    return F.concat(F.bround(share, places).cast("string"), F.lit("%"))


def sentinel_to_null(c: Column, *sentinels) -> Column:
    return F.when(~c.isin(*sentinels), c)


def to_number(c: Column) -> Column:
    """Double, or NULL where the text is no number."""
    return c.cast("string").try_cast("double")


def fill_int(c: Column, default: int) -> Column:
    return F.coalesce(c, F.lit(default)).cast("int")


def any_negative(*cols: Column) -> Column:
    """True where at least one value is under zero; NULL counts as not negative."""
    return reduce(lambda a, b: a | b, [F.coalesce(c < 0, F.lit(False)) for c in cols])


def constant_row(*cols: Column, stand_in: float = -9999999.0) -> Column:
    """True where all values equal the first (NULL replaced by ``stand_in``) and not all are NULL."""
    filled = [F.coalesce(c.cast("double"), F.lit(stand_in)) for c in cols]
    same = reduce(lambda a, b: a & b, [f == filled[0] for f in filled])
    return same & reduce(lambda a, b: a | b, [c.isNotNull() for c in cols])


def row_median(*cols: Column) -> Column:
    """Median over the columns of a row, NULLs left out; NULL if all are."""
    a = F.array_sort(F.array_compact(F.array(*[c.cast("double") for c in cols])))
    n = F.size(a)
    low, high = F.get(a, F.floor((n - 1) / 2).cast("int")), F.get(a, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def row_mean(*cols: Column) -> Column:
    """Mean over the columns of a row, NULLs left out; NULL if all are."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols]) / F.when(n > 0, n)


def entropy(counts: Column) -> Column:
    """-sum p log2(p + 1e-9) of an array of counts; 0 for an empty total."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.aggregate(counts, F.lit(0.0), lambda a, x: a - x / total * F.log2(x / total + F.lit(1e-9)))).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0") for c in (red, green, blue)])


def seeded(seed: int, *key: Column) -> Column:
    """Order-free pseudo-random text: md5 of seed and key, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *[k.cast("string") for k in key])))


def seeded_unit(seed: int, *key: Column) -> Column:
    """Pseudo-random number in [0, 1), from the first 13 hex digits of ``seeded``."""
    return F.conv(F.substring(seeded(seed, *key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def year_of(path: Column) -> Column:
    """The first run of four digits in a path, as a number."""
    found = F.regexp_extract(path, r"(\d{4})", 1)
    return F.when(found != "", found.cast("int"))
