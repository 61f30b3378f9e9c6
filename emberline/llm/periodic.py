"""Periodic runs of words: a harmonic grid of (period, place) pairs, extended all at once by prefix hashes.

A run of period p is a stretch whose words equal those p places on. Where a run must have
``least`` words and ``times`` periods, the places i with word i = word i + p lie in a stretch of
at least g(p) = max(least - p, (times - 1) * p) places, so places 0, g(p), 2 g(p), ... meet every
run; all periods together have about n ln(n) / 2 such pairs. Pairs with equal words are probed
half of g(p) either way by one comparison of prefix hashes; for those that pass, binary searches
over the hashes find how far the stretch reaches, both ways, for all pairs at once.
Runs found from several places, or at multiples of their period, are merged, and words
themselves confirm each run; where a hash misled, words alone decide.

A task sees whole texts one by one; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import lean, pick, shielded, tune
from ._text import mix

#: Pairs that are worked on at once.
HELD = 1 << 18
_BASE = 0xD1342543DE82EF95
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class PrefixHashes:
    """Polynomial hashes modulo 2**64 of all prefixes of a sequence of word numbers."""

    def __init__(self, words: np.ndarray) -> None:
        base = np.full(len(words) + 1, _BASE, np.uint64)
        base[0] = 1
        self.power = np.cumprod(base)
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix((words.astype(np.uint64) + np.uint64(1)) * _GOLD) * self.power[:-1], out=self.total[1:])

    def equal(self, i: np.ndarray, p: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether words i to i + k - 1 seem equal to those p places on; never denies it where they are."""
        t = self.total
        return (t[i + k] - t[i]) * self.power[p] == t[i + p + k] - t[i + p]


def _reach(h: PrefixHashes, i: np.ndarray, p: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """The most places k <= room, from i on (or up to and with i), that equal those p on: one binary search for all pairs."""
    found = np.zeros(len(i), np.int64)
    for bit in range(int(room.max(initial=0)).bit_length() - 1, -1, -1):
        k = found + (1 << bit)
        ok = np.flatnonzero(k <= room)
        first = i[ok] - k[ok] + 1 if back else i[ok]
        ok = ok[h.equal(first, p[ok], k[ok])]
        found[ok] = k[ok]
    return found


def _grid(n: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, step) of all grid points of n words, a bounded number at once."""
    periods = np.arange(1, n // times + 1)
    steps = np.maximum(np.maximum(least - periods, (times - 1) * periods), 1)
    counts = -(-(n - periods) // steps)
    ends = np.cumsum(counts)
    at = 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
        c = counts[at:to]
        place = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        step = np.repeat(steps[at:to], c)
        yield place * step, np.repeat(periods[at:to], c), step
        at = to


def runs_of(words: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least ``least`` words and ``times`` smallest periods, by start, then period."""
    n = len(words)
    if n < max(least, times):
        return []
    h = PrefixHashes(words)
    seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, p, step in _grid(n, least, times):
        hit = np.flatnonzero(words[i] == words[i + p])
        i, p, half = i[hit], p[hit], (step[hit] + 1) // 2
        ahead, behind = i + p + half <= n, i + 1 >= half
        near = np.zeros(len(i), bool)
        for inside, first in ((ahead, i), (behind, i - half + 1)):
            at = np.flatnonzero(inside & ~near)
            near[at] = h.equal(first[at], p[at], half[at])
        i, p, step = i[near], p[near], step[hit][near]
        if not len(i):
            continue
        first = i + 1 - _reach(h, i, p, i + 1, True)
        last = i + _reach(h, i, p, n - p - i, False)
        long = last - first >= step
        rows = np.unique(np.column_stack([first, last + p, p, i])[long], axis=0)
        if len(rows):
            # of the pairs of one run and period one is enough
            rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]]
            for s, e, q, at in rows.tolist():
                seen.setdefault((s, e), []).append((q, at))
    out = {}
    for (s, e), found in seen.items():
        for q, at in sorted(found):
            if (words[s : e - q] == words[s + q : e]).all():
                run = (s, e, q)
            else:  # a hash misled: the words around the place decide
                apart = np.flatnonzero(words[: n - q] != words[q:])
                k = int(np.searchsorted(apart, at))
                run = (int(apart[k - 1]) + 1 if k else 0, (int(apart[k]) if k < len(apart) else n - q) + q, q)
                if run[1] - run[0] < max(least, times * q):
                    continue
            out[run[:2]] = min(q, out.get(run[:2], q))
            if run[:2] == (s, e):
                break
    return sorted((s, e - s, q) for (s, e), q in out.items())


def _repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        change[s + q] += 1
        change[s + length] -= 1
    return np.cumsum(change[:-1]) > 0


def _search(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, firsts, found, kept = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                runs: list[tuple[int, int, int]] = []
                if len(words) >= least:
                    number: dict[bytes, int] = {}
                    runs = runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64), least, times)
                if runs:
                    found += runs
                    words = list(compress(words, ~_repeats(len(words), runs)))
                sizes.append(len((text or b"").split()) if runs else len(words))
                firsts.append(len(found))
                kept.append(b" ".join(words))
            s, length, q = (pa.array([r[i] for r in found], pa.int64()) for i in range(3))
            lists = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.StructArray.from_arrays([s, length, q], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the periodic runs of each text, and the text without their repeats.

    Words are what spaces and U+0009 to U+000D separate. ``runs`` holds (start, length, period)
    of every stretch of words with smallest period q, at least ``least`` words and ``times * q``,
    that no neighbour extends, by start, then period. ``collapsed`` joins by a space all words but
    those that a run holds behind its first q words; runs may overlap.

    A null or empty text has no words, no runs and an empty collapsed text. Every row of the table
    gives one row, repeated or without an id as well; texts of any length are searched whole, in memory
    of a few times their words; an empty table gives no rows; other columns are ignored.
    """
    tune(docs.sparkSession)
    d = pick(docs, "doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lean(_search(least, times)), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` where a tenth of the texts (by the crc32 of the id) repeat a stretch of words from a place to the end.

    With h that number, g = h div 10 and n words, word i >= a becomes word a + (i - a) % p, where
    a = g % n and p = 1 + (n - a) div (3 + g % 8). Texts without words and rows without an id stay.
    """

    def work(d: DataFrame) -> DataFrame:
        h = F.crc32(F.col("doc_id").cast("string"))
        d = d.withColumn("_g", F.floor(h / 10)).withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))))
        n = F.greatest(F.size("_w"), F.lit(1))
        d = d.withColumn("_from", (F.col("_g") % n).cast("int")).withColumn("_p", (1 + F.floor((n - F.col("_g") % n) / (3 + F.col("_g") % 8))).cast("int"))
        times = F.ceil((n - F.col("_from")) / F.col("_p")).cast("int")
        again = F.flatten(F.array_repeat(F.slice("_w", F.col("_from") + 1, F.col("_p")), times))
        planted = F.array_join(F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_from")), again), F.lit(1), n), " ")
        return d.withColumn("text", F.when(F.size("_w") > 0, planted).otherwise(F.col("text"))).select(*docs.columns)

    return shielded(docs, tuple(docs.columns), work)


def _strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first on ties; null where there is none."""
    better = lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a)
    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``find_runs`` on texts with planted runs."""
    d = find_runs(with_planted_runs(pick(docs, "doc_id", "text"))).withColumn("best", _strongest(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    hexed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        hexed(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), hexed(F.col("collapsed")).alias("collapsed_sha256"),
    )
