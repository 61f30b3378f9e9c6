"""Periodic runs against failure functions and stretches looked for period by period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(w):
    fail = [0] * len(w)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def slow_runs(w, least=24, times=3):
    n, out = len(w), set()
    for p in range(1, n // times + 1):
        s = 0
        while s < n - p:
            e = s
            while e < n - p and w[e] == w[e + p]:
                e += 1
            if e > s and e + p - s >= max(least, times * p) and smallest_period(w[s : e + p]) == p:
                out.add((s, e + p - s, p))
            s = e + 1
    return sorted(out)


def made(rng):
    w = []
    while len(w) < rng.randrange(20, 160):
        kind = rng.random()
        if kind < 0.4:
            w += [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 20))]
        else:
            unit = [rng.choice("ab" if kind < 0.7 else "abcdefgh") for _ in range(rng.randrange(1, 12))]
            w += (unit * 30)[: rng.randrange(1, 70)]
    return w


def numbers(w):
    seen = {}
    return np.array([seen.setdefault(x, len(seen)) for x in w], np.int64)


@pytest.mark.parametrize("seed", range(150))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    w = made(rng)
    least, times = rng.choice([(24, 3), (24, 3), (6, 2), (1, 2), (10, 4)])
    assert periodic.runs_of(numbers(w), least, times) == slow_runs(w, least, times)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=0, max_size=120))
def test_runs_of_two_words(w):
    assert periodic.runs_of(np.array(w, np.int64), 8, 3) == slow_runs(w, 8, 3)


def test_words_that_mislead_hashes():
    """Such sums agree on the two halves of a sequence of this kind; words must decide."""
    t = np.array([bin(i).count("1") % 2 for i in range(4096)], np.int64)
    w = np.concatenate([t, 1 - t] * 3)
    h, at = periodic.PrefixHashes(w), np.array([0])
    assert h.equal(at, at + 4096, at + 4096)[0] and not (w[:4096] == w[4096:8192]).all()
    found = periodic.runs_of(w, 24, 3)
    assert (0, len(w), 8192) in found
    for s, length, q in found:
        x = w[s : s + length]
        assert (x[q:] == x[:-q]).all() and (s == 0 or w[s - 1] != w[s - 1 + q])


def test_large_inputs():
    assert periodic.runs_of(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    rng = np.random.default_rng(1)
    w = rng.integers(0, 50, 200_000)
    w[1000:1000 + 50_000] = np.tile(w[1000:11_000], 5)
    w[61_000:61_030] = 3
    got = periodic.runs_of(w)
    assert {(q, n // 100) for _, n, q in got} == {(10_000, 500), (1, 0)}


def planted(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def row(doc_id, text):
    w = planted(doc_id, text)
    runs = slow_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_on_odd_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(made(rng))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, None), (202, " \t\n"), (203, "é 𝒳\x1c\x85   " * 40), (204, "again " * 3000), (205, "unbroken" * 100_000), (None, "x y z " * 20), (206, "same row " * 15), (206, "same row " * 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(3).alias(c) for c in ("runs", "start", "length", "n_words", "best", "_w", "_g")]).repartition(3)
    got = sorted((tuple(r) for r in periodic.periodic_runs(docs).collect()), key=str)
    assert got == sorted((row(*r) for r in rows), key=str)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_operator_gives_spans_and_text(spark):
    docs = spark.createDataFrame([("a", "start " + "one two " * 14 + "end")], "doc_id string, text string")
    r = periodic.find_runs(docs).first()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (30, [(1, 28, 2)], "start one two end")
    assert periodic.find_runs(docs, least=30).first().runs == []
