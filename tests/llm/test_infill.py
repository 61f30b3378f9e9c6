"""Fill-in-the-middle against a plain reading of its definition."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from emberline.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain_reading(doc_id, text, plain_from=90, spm_below=20):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if h[3] % 100 < spm_below:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    alphabet = ["a", "Bc", "word", " ", "\n", "é", "𝒳", "<", ">", "<P", "1", "\x00", "S>", "ß"]
    made = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 400)))) for i in range(150)]
    made += [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 4)))) for i in range(150, 220)]
    made += [(300, None), (301, ""), (None, "no id at all"), (None, None), (302, "a <P> mark"), (303, "<M>"), (304, "x" * 300_000), (305, "ab " * 120_000), (306, "-" * 64), (307, "a-" * 16)]
    made += [(308, "the same row twice")] * 2 + [(308, "one id, another text"), (309, "the same text"), (310, "the same text")]
    return made


def test_as_defined(spark, rows):
    clash = ["n", "block", "part", "before", "cut", "form", "lo", "_a", "_row", "output"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in clash]).repartition(3)
    got = sorted((tuple(r) for r in infill.fill_in_middle(docs).collect()), key=str)
    assert got == sorted(((i, *plain_reading(i, t)) for i, t in rows), key=str)
    forms = {r[2] for r in got}
    assert forms == {"plain", "psm", "spm"}


def test_digests_and_round_trip(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in infill.infill(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for i, t in rows:
        n, form, p, m, _, out = plain_reading(i, t)
        want.add((i, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(t or "")))
    assert got == want


def test_other_parameters_ids_and_empty(spark):
    docs = spark.createDataFrame([("x1", "some words, here"), ("x2", "and there")], "doc_id string, text string")
    for r in infill.fill_in_middle(docs, plain_from=100, spm_below=100).collect():
        assert r.form == "spm" and r.output == f"<S>{r.suffix}<P>{r.prefix}<M>{r.middle}"
    assert infill.infill(docs.limit(0)).collect() == []
    assert {r.form for r in infill.fill_in_middle(docs, plain_from=0).collect()} == {"plain"}
