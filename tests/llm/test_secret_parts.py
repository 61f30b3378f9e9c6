"""Secret scans: short keys, keys behind readable words, names in code, and many spans in one text."""

from __future__ import annotations

import random
import string
import time

from emberline.llm import secrets

_62 = string.ascii_letters + string.digits
_WORDS = "get user account handle request timeout parse json file buffer size list index value config manager create update delete service pool cache entry stream reader socket provider query result".split()


def _found(spark, texts: list[str]) -> list[list[tuple[int, int]]]:
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "random"] for r in secrets.secret_scan(d).collect()}
    return [got[i] for i in range(len(texts))]


def test_short_and_glued_keys_are_found_and_names_are_not(spark):
    rng = random.Random(11)
    key = lambda n, abc=_62: "".join(rng.choice(abc) for _ in range(n))
    uuid = lambda: "-".join(key(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12))
    kinds = [("", 16, ""), ("sk-proj-", 40, ""), ("https://example.com/api/v1/keys/", 40, ""), ("/keys/", 24, "/details"), ("ghp_", 36, "")]
    planted = [(before, key(n), after) for before, n, after in kinds for _ in range(40)] + [("", uuid(), "") for _ in range(40)]
    name = lambda: rng.choice(_WORDS) + "".join(rng.choice(_WORDS).title() for _ in range(rng.randint(3, 5)))
    names = [name() for _ in range(60)] + [sep.join(rng.choice(_WORDS) for _ in range(5)) for sep in "_-/" for _ in range(20)] + [key(16, "0123456789") for _ in range(20)]
    found = _found(spark, [f"é {a}{b}{c} end" for a, b, c in planted] + [f"é {x} end" for x in names])
    exact = [(2 + len(a), 2 + len(a) + len(b)) in spans for (a, b, _), spans in zip(planted, found, strict=False)]
    assert sum(exact) >= 0.98 * len(planted)
    assert not any(found[len(planted) :])


def test_parts_of_a_rejected_run(spark):
    run = "SomeReadableFolderName/AnotherReadableName/q7ZxV0pLr3BtWk9YdHs2Gm5J"
    others = [f"x {n} y" for n in ("SomeReadableFolderName", "AnotherReadableName", "HandleRequestTimeout") for _ in range(20)]
    first = _found(spark, [f"see {run} end", *others])[0]
    at = 4 + run.index("q7Z")
    assert first == [(at, at + 24)]


def test_long_runs_of_words_and_separators(spark):
    texts = ["ab-" * 50000 + "Z", "-" * 50000, "Z" + "-abc" * 50000, "a/" * 30000, "=" * 50]
    assert _found(spark, texts) == [[], [], [], [], []]


def test_redaction_of_many_spans(spark):
    rng = random.Random(3)
    n = 6000
    text = " ".join("é𝒳 " + "".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(n))
    d = spark.createDataFrame([(1, text + " token=" + "a" * 30 + "\nend"), (2, "")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in secrets.redact(d, d.columns).collect()}
    assert got == {1: " ".join(["é𝒳 [SECRET]"] * n) + " [SECRET]\nend", 2: ""}
    assert time.time() - began < 60
