"""Best-fit packing by a grouping genetic algorithm: whole documents into as few windows as possible.

1. Texts are tokenised; those longer than the window are cut at its multiples. A piece is a row
   of place, length and checksum, not of ids.
2. A hash of a piece's row deals the pieces into blocks of about ``block`` pieces, so no length, source or
   id makes a block large. Each block is bred on several islands, a row and task of its own: a
   packing is the bin of each piece, an island a few packings.
3. A crossover puts some well-filled bins of one parent, whole, into a copy of the other, removes
   the bins that now hold a piece twice (and the emptiest one), and puts the pieces that lost
   their place into the bin that they fill best, longest first. A child replaces the island's worst
   packing if it is fitter: fewer bins, then more of the fill in full bins.
4. After each round an island's best packing migrates to the next island of its block.
5. The best packing of a block stands where its bins are full to a few tokens. Pieces of the other
   bins of all blocks form the next, much smaller level, and are bred again.

Blocks have a bounded size, so work and memory of a task do not depend on the table; lengths and
packings travel as two bytes a piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import lean, pick, staged, tune
from .packing import _cut

#: Bits of a bin's number; a block has fewer pieces than that allows.
_BITS = 15
_BIN = (1 << _BITS) - 1


def best_fit(lengths: np.ndarray, order: np.ndarray, window: int, bins: np.ndarray, room: list[int], first: int) -> int:
    """Put pieces, in order, into the fullest bin that holds them, opening bins from number ``first``; the number after the last.

    ``bins`` takes each piece's bin; ``room`` is a sorted list of (tokens left << 15 | bin).
    """
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        k = bisect_left(room, size << _BITS)
        if k < len(room):
            v = room.pop(k)
            left, b = (v >> _BITS) - size, v & _BIN
        else:
            left, b = window - size, first
            first += 1
        bins[i] = b
        if left:
            insort(room, left << _BITS | b)
    return first


def fitness(lengths: np.ndarray, bins: np.ndarray, window: int) -> tuple[int, float]:
    """The smaller, the fitter: the number of bins, then how evenly the fill is spread."""
    fill = np.bincount(bins, lengths)
    return len(fill), -float((fill / window) @ (fill / window))


def cross(lengths: np.ndarray, one: np.ndarray, other: np.ndarray, window: int, rng: np.random.Generator) -> np.ndarray:
    """A child of two packings: ``one`` with some well-filled bins of ``other``."""
    fill, theirs = np.bincount(one, lengths), np.bincount(other, lengths)
    best = np.argsort(-theirs, kind="stable")[: max(1, (len(theirs) + 1) // 2)]
    given = np.full(len(theirs), -1)
    chosen = rng.choice(best, max(1, len(theirs) // 32), replace=False) if len(best) > 1 else best
    given[chosen] = np.arange(len(chosen))
    put = given[other]
    lost = np.zeros(len(fill), bool)
    lost[one[put >= 0]] = True
    lost[np.where(lost, window + 1, fill).argmin()] = True
    number = np.cumsum(~lost) - 1
    kept = int((~lost).sum())
    child = np.where(put >= 0, kept + put, number[one]).astype(np.int16)
    room = np.concatenate([window - fill[~lost], window - theirs[chosen]]).astype(np.int64)
    open_bins = np.flatnonzero(room > 0)
    homeless = np.flatnonzero((put < 0) & lost[one])
    order = homeless[np.argsort(-lengths[homeless], kind="stable")]
    best_fit(lengths, order, window, child, np.sort(room[open_bins] << _BITS | open_bins).tolist(), len(room))
    return child


def evolve(lengths: np.ndarray, population: list[np.ndarray], window: int, size: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """An island's packings, fittest first, after some generations; an empty population is founded.

    Founders are best-fit packings of pieces in falling length, all but the first with lengths
    blurred. Breeding ends early where the sum of lengths allows no fewer bins.
    """
    least = -(-int(lengths.sum()) // window)
    made = [(fitness(lengths, p, window), p) for p in population]
    while len(made) < size and not (made and min(m[0] for m in made)[0] == least):
        blur = rng.uniform(0.8, 1.0, len(lengths)) if made or rng.random() < 0.5 else 1.0
        bins = np.zeros(len(lengths), np.int16)
        best_fit(lengths, np.argsort(-lengths * blur, kind="stable"), window, bins, [], 0)
        made.append((fitness(lengths, bins, window), bins))
    made.sort(key=lambda m: m[0])
    for _ in range(generations):
        if made[0][0][0] == least or len(made) < 2:
            break
        a, b = rng.choice(len(made), 2, replace=False)
        child = cross(lengths, made[a][1], made[b][1], window, rng)
        got = fitness(lengths, child, window)
        if got < made[-1][0] and got not in [m[0] for m in made]:
            made[-1] = (got, child)
            made.sort(key=lambda m: m[0])
    return [p for _, p in made[:size]]


_STATE = "block long, island int, lengths binary, packings array<binary>, bins int, spread double"


def _round(window: int, size: int, generations: int, number: int):
    """One round of all islands; rows come with the packing of a migrant or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.to_pydict()
            packings, bins, spread = [], [], []
            for block, island, raw, old, migrant in zip(*(rows[c] for c in ("block", "island", "lengths", "packings", "migrant")), strict=True):
                lengths = np.frombuffer(raw, "<u2").astype(np.int64)
                population = [np.frombuffer(p, "<i2") for p in dict.fromkeys([*(old or []), *([migrant] if migrant else [])])]
                got = evolve(lengths, population, window, size, generations, np.random.default_rng([block, island, number]))
                packings.append([p.astype("<i2").tobytes() for p in got])
                n, even = fitness(lengths, got[0], window)
                bins.append(n)
                spread.append(even)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("block", "island", "lengths")), pa.array(packings, pa.list_(pa.binary())), pa.array(bins, pa.int32()), pa.array(spread, pa.float64())],
                ["block", "island", "lengths", "packings", "bins", "spread"],
            )

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lengths) of blocks: two bytes a piece."""
    for batch in batches:
        lists = batch.column(1)
        flat, at = np.asarray(lists.flatten().to_numpy(), "<u2"), np.cumsum([0, *lists.value_lengths().to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())], ["block", "lengths"])


def _places(window: int, first: int, columns: list[str]):
    """Rows of pieces with sequence, offset and the tokens that their sequence lacks, from blocks with their best packing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            items = batch.column(1).flatten()
            block = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
            sequence = (first + block) << _BITS | np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i2").astype(np.int64)
            order = np.argsort(sequence, kind="stable")
            items, sequence = items.take(pa.array(order)), sequence[order]
            fields = dict(zip((f.name for f in items.type), items.flatten(), strict=True))
            size = fields["length"].to_numpy()
            head = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
            of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(sequence)]))
            before = np.cumsum(size) - size
            lacks = window - np.add.reduceat(size, head)
            yield pa.RecordBatch.from_arrays([*(fields[c] for c in columns), pa.array(sequence), pa.array(before - before[head][of]), pa.array(lacks[of])], [*columns, "sequence_id", "offset", "lacks"])

    return run


def group(pieces: DataFrame, window: int = 4096, block: int = 2000, islands: int = 3, size: int = 4, rounds: int = 2, generations: int = 24, levels: int = 3, spare: int = 4) -> DataFrame:
    """``pieces`` (with a long column ``length`` of 1 to ``window``) with sequence_id and offset.

    ``pieces`` is read several times and numbered by the order of its partitions: give a written
    table. The packing is the same for the same table and settings. A sequence stands when it lacks at
    most ``spare`` tokens; pieces of the others meet again, ``levels`` times at most, and the last level stands as
    it is. Equal rows are pieces of their own; an empty table gives no rows.
    """
    if not 1 <= block <= 8000 or not 1 <= window < 1 << 16:
        raise ValueError("a block has 1 to 8000 pieces, a window 1 to 65535 tokens")
    spark, columns = pieces.sparkSession, pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    done: list[DataFrame] = []
    first = 0
    for level in range(levels):
        n = pieces.count()
        if not n and done:
            break
        blocks = -(-n // block)
        dealt = pieces.withColumn("_at", F.monotonically_increasing_id())
        dealt = dealt.select(F.pmod(F.xxhash64("_at", F.lit(level)), F.lit(max(1, blocks))).alias("block"), F.struct(*columns).alias("item"))
        held = staged(dealt.groupBy("block").agg(F.collect_list("item").alias("items")), "blocks")
        tasks = max(min(blocks * islands, 4 * spark.sparkContext.defaultParallelism), blocks * islands // 256, 1)
        state = held.select("block", F.col("items.length").alias("lengths")).mapInArrow(_lengths, "block long, lengths binary")
        state = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("packings", F.lit(None).cast("array<binary>")).withColumn("migrant", F.lit(None).cast("binary"))
        ring = Window.partitionBy("block").orderBy("island")
        for number in range(rounds):
            if number:
                before = F.coalesce(F.lag(F.col("packings")[0]).over(ring), F.last(F.col("packings")[0]).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
                state = state.withColumn("migrant", before)
            state = state.select("block", "island", "lengths", "packings", "migrant").repartition(tasks, "block", "island").mapInArrow(lean(_round(window, size, generations, number)), _STATE)
        best = state.groupBy("block").agg(F.min(F.struct("bins", "spread", "island", F.col("packings")[0].alias("packing"))).alias("best"))
        both = held.join(best.select("block", "best.packing"), "block").select("block", "items", "packing")
        placed = staged(both.mapInArrow(lean(_places(window, first, columns)), f"{schema}, sequence_id long, offset long, lacks long"), "placed")
        first += max(1, blocks)
        last = level == levels - 1 or blocks <= 1
        done.append((placed if last else placed.where(F.col("lacks") <= spare)).drop("lacks"))
        if last:
            break
        pieces = placed.where(F.col("lacks") > spare).select(*columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def best_fit_pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 1, **settings: int) -> DataFrame:
    """Pieces of all documents with their place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    ``tokenizer`` is the path of a vocabulary file that every executor can open. A document is its
    ids and ``end_id``. One of at most ``window`` ids is never cut; a longer one is cut at the
    window's multiples. A null or empty text is one piece, the end id alone. Rows that repeat a
    doc_id (or have none) are documents of their own; ties in length go by the order in the block;
    an empty table gives no rows; other columns are ignored.
    """
    tune(docs.sparkSession)
    docs = pick(docs, "doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = staged(docs.mapInArrow(lean(_cut(tokenizer, window, end_id)), schema).drop("doc_tokens"), "pieces")
    placed = group(pieces, window, **settings)
    return placed.select("doc_id", F.expr(f"start div {window}").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
