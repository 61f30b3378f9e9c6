"""Best-fit packing: packings are whole and close to the least, pieces are those of the tokenizer."""

import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import grouping
from emberline.llm.queries import tokenizer_path


def least_bins(lengths, window):
    """The least number of bins, by trying every set of pieces for the next bin."""
    n = len(lengths)

    @lru_cache(None)
    def solve(left):
        if not left:
            return 0
        first = (left & -left).bit_length() - 1
        rest, best = left & ~(1 << first), n
        sub = rest
        while True:
            if lengths[first] + sum(lengths[i] for i in range(n) if sub >> i & 1) <= window:
                best = min(best, 1 + solve(rest & ~sub))
            if not sub:
                return best
            sub = (sub - 1) & rest

    return solve((1 << n) - 1)


def whole(lengths, bins, window):
    fill = np.bincount(bins, lengths)
    return len(bins) == len(lengths) and (fill > 0).all() and (fill <= window).all()


@pytest.mark.parametrize("seed", range(40))
def test_islands_reach_the_least(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60, rng.integers(1, 11))
    got = grouping.evolve(lengths, [], 60, 4, 60, rng)
    assert all(whole(lengths, p, 60) for p in got)
    assert grouping.fitness(lengths, got[0], 60)[0] == least_bins(tuple(int(x) for x in lengths), 60)


def test_crossover_keeps_pieces_and_given_bins():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = rng.integers(1, 101, rng.integers(1, 200))
        one, other = (np.zeros(len(lengths), np.int16) for _ in range(2))
        for p in (one, other):
            grouping.best_fit(lengths, rng.permutation(len(lengths)), 100, p, [], 0)
        child = grouping.cross(lengths, one, other, 100, rng)
        assert whole(lengths, child, 100)
        groups = lambda p: {frozenset(np.flatnonzero(p == b)) for b in set(p.tolist())}
        assert any(any(a <= b for b in groups(child)) for a in groups(other))


def test_breeding_mends_bad_packings():
    """Triples that fill a bin exactly, from packings that founders do not find."""
    rng = np.random.default_rng(5)
    a = rng.integers(20, 40, 40)
    b = rng.integers(20, 40, 40)
    lengths = np.concatenate([a, b, 100 - a - b])
    founders = grouping.evolve(lengths, [], 100, 6, 0, np.random.default_rng(1))
    bred = grouping.evolve(lengths, founders, 100, 6, 3000, np.random.default_rng(1))
    fit = lambda p: grouping.fitness(lengths, p, 100)
    assert fit(bred[0]) < fit(founders[0]) and whole(lengths, bred[0], 100)


def test_blocks_islands_and_levels(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 700, rng.choice([1, 5, 50, 64, rng.randrange(1, 65), 33])) for i in range(3000)] + [(None, 7)] * 900 + [(1, 40)] * 1000
    spark.createDataFrame(rows, "id long, length long").repartition(4).write.parquet(str(tmp_path / "p"))
    pieces = spark.read.parquet(str(tmp_path / "p"))
    got = grouping.group(pieces, window=64, block=150, spare=0).collect()
    assert sorted((str(r.id), r.length) for r in got) == sorted((str(i), n) for i, n in rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces_of in by.values():
        at = 0
        for offset, length in sorted(pieces_of):
            assert offset == at
            at += length
        assert at <= 64
    # no packing has fewer bins than the sum of lengths and the pieces over half a window allow
    over = sum(n > 32 for _, n in rows)
    assert len(by) <= 1.01 * max(over, -(-sum(n for _, n in rows) // 64)) + 3
    assert grouping.group(pieces.limit(0), window=64).collect() == []
    again = grouping.group(spark.read.parquet(str(tmp_path / "p")), window=64, block=150, spare=0).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_pieces_of_documents(spark):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts = ["word " * 20_000, "", None, "Some text, with marks! " * 10, "é 𝒳 ｆｏｏ", "  \n", "x" * 50_000]
    texts += [" ".join(rng.choice(["alpha", "beta", "gamma", "delta9", "Ünïcode"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("length", "piece", "block", "items", "start")]).repartition(3)
    got = grouping.best_fit_pack(docs, tokenizer_path()).collect()
    encoder = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in rows:
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, want))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces_of in by.values():
        assert [o for o, _ in sorted(pieces_of)] == np.cumsum([0] + [n for _, n in sorted(pieces_of)])[:-1].tolist()
        assert sum(n for _, n in pieces_of) <= 4096
    assert len(by) <= -(-sum(r.length for r in got) // 4096) + 1
    assert grouping.best_fit_pack(docs.limit(0), tokenizer_path()).collect() == []
