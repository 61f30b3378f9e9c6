"""Chat formatting: many turns in one conversation, long texts, and ids that are not numbers."""

from __future__ import annotations

import hashlib
import random
import time

from emberline.llm import chat


def _expected(turns: list[tuple[str, str]]) -> tuple[int, str, int, str]:
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def _of(row) -> tuple[int, str, int, str]:
    return row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256


def test_many_turns_in_one_conversation(spark):
    rng = random.Random(2)
    turns = [("assistant" if i % 2 else "user", f"é𝒳 {i} " + rng.choice(["</s>", "<|im_end|>", "\\", "", "[INST]"]) * rng.randint(0, 3)) for i in range(32000)]
    d = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string").coalesce(4).cache()
    d.count()
    began = time.time()
    got = {r.conv_id: r for r in chat.chat_format(d).collect()}
    assert _of(got[7]) == _expected(turns)
    assert time.time() - began < 30
    d.unpersist()


def test_texts_longer_than_a_chunk(spark):
    turns = [("user", "a<|" * 5000), ("assistant", "𝒳b</s>\n" * 4000), ("assistant", ""), ("assistant", "z" * 4096), ("user", "é")]
    d = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_format(d).collect()}
    assert _of(got[1]) == _expected(turns)


def test_ids_of_other_types(spark):
    rows = [("a", 0, "user", "hi"), ("a", 1, "assistant", "ho"), (None, 0, "assistant", "x")]
    d = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r.conv_id: _of(r) for r in chat.chat_format(d).collect()}
    probe = [("user", chat.PROBE), ("assistant", chat.PROBE)]
    assert got == {"a": _expected([("user", "hi"), ("assistant", "ho")]), None: _expected([("assistant", "x")]), "-1": _expected(probe)}
