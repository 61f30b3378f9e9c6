"""The pipeline: each stage takes effect, keeps its columns, and survives odd input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, groups, prose

SECRET = "token=abcdefgh12345678"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(21)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(20, 200))
        rows.append((3 * i, text, "en", f"s{i % 3}", len(text)))
        if i % 4 == 0:
            rows.append((3 * i + 1, text + " extra", "en", "s0", 1))
        if i % 5 == 0:
            rows.append((3 * i + 2, prose(rng, 30) + " " + SECRET, "en", None, 1))
    rows += [(900, None, "en", "s1", None), (901, "", None, "s1", 0), (902, "12 34", "en", "s1", 5)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("row", F.lit(2))


def test_stages(spark, docs):
    d = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, "").cache()
        if name != "packing":
            assert out.columns == docs.columns
        seen[name] = (d.collect(), out.collect())
        d = out
    before, after = seen["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {900, 901, 902}
    before, after = seen["near_duplicates"]
    want, _ = groups([(r.doc_id, r.text) for r in before], 80, 100)
    assert sorted(r.doc_id for r in after) == sorted(set(want.values()))
    before, after = seen["secrets"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    assert not any("abcdefgh12345678" in r.text for r in after) and any("[SECRET]" in r.text for r in after)
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["mixing"]
    words = lambda rows, s: sum(len(re.findall(r"\S+", r.text)) for r in rows if r.source == s)
    total = sum(words(before, s) for s in ("s0", "s1", "s2", None))
    assert abs(sum(words(after, s) for s in ("s0", "s1", "s2", None)) - 1.5 * total) < 0.1 * total
    before, after = seen["packing"]
    assert sum(r.start == 0 for r in after) == len(before)


def test_empty(spark, docs):
    d = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, "")
        assert d.count() == 0


def test_repeated_and_null_ids(spark):
    text = "some words that are said more than once in this table of texts"
    d = spark.createDataFrame([(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, "en", "a", 1), (2, text + " and more of it here so it differs a lot from the first one", "en", "a", 1)], SCHEMA)
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, d, "")
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2]
