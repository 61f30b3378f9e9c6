"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy arrays.

One Arrow pass computes the statistics of every whole text. The trees are fitted on a bounded
sample of labelled rows (``SAMPLE`` rows, taken by a hash of doc_id), with monotonic
constraints: more repetition, symbols or repeated lines can only lower a document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lean, pick, staged, tune
from ._text import _COEF, _GOLD, hash_words, mix

#: Most labelled rows that the trees are fitted on.
SAMPLE = 20_000
WINDOW = 8

#: Statistics in column order, with the sign that the score must follow (0: free).
FEATURES: dict[str, int] = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "upper_share": 0,
    "digit_share": 0,
    "punctuation_share": 0,
    "line_words": 0,
    "wide_share": 0,
    "long_word_share": 0,
    "top_word_share": -1,
}

_KIND = np.zeros((256, 6), np.float32)
_KIND[list(b"#*$%&|<>"), 0] = 1
_KIND[list(range(0x41, 0x5B)), 1] = 1
_KIND[list(b"0123456789"), 2] = 1
_KIND[list(b".,;:!?\"'()-"), 3] = 1
_KIND[list(range(0xC2, 0xF5)), 4] = 1
_KIND[[i for i in range(256) if i & 0xC0 != 0x80 and i not in (0x20, *range(0x09, 0x0E))], 5] = 1


def repeated(words: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    acc = np.zeros(n, np.uint64)
    for i in range(width):
        acc = (acc ^ words[i : i + n]) * _COEF[i % 5] + _GOLD
    acc = mix(acc)
    order = np.argsort(acc, kind="stable")
    s = acc[order]
    twin = np.zeros(n, bool)
    same = s[1:] == s[:-1]
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twin)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


_BLANK = str.maketrans("", "", " \t\n\r\x0b\x0c")


def dup_lines(text: str) -> tuple[int, int]:
    """Lines (cut at newlines) that hold a word and equal an earlier line; all lines that hold a word."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line and line.translate(_BLANK):
            n += 1
            seen.add(line)
    return n - len(seen), n


def statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Integer base columns (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features."""
    base = np.zeros((len(texts), 5), np.int64)
    out = np.zeros((len(texts), len(FEATURES)), np.float64)
    for i, (text, (words, _)) in enumerate(zip(texts, hash_words(texts, lower=False), strict=True)):
        if not text:
            continue
        kinds = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256) @ _KIND.astype(np.float64)
        n, chars = len(words), int(kinds[5])
        dup, lines = dup_lines(text)
        again = repeated(words)
        base[i] = n, chars, int(kinds[0]), dup, again
        if not n:
            continue
        values, counts = np.unique(words, return_counts=True)
        out[i] = (
            np.log1p(n), chars / n, kinds[0] / chars, dup / lines, again / n, len(values) / n, kinds[1] / chars, kinds[2] / chars,
            kinds[3] / chars, min(n / lines, 1000), kinds[4] / chars, min(chars / n, 30) > 12, counts.max() / n,
        )
    return base, out


@dataclass
class Trees:
    """Flat node arrays: leaves point to themselves, so scoring is ``depth`` rounds of indexing."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a row is good."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 2.0, least: int = 10) -> Trees:
    """Second-order boosting of the logistic loss on binned features.

    A split on a constrained feature is allowed only if its children's values follow the sign;
    the midpoint of both then bounds everything below, so whole trees are monotonic.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), start)
    nodes: list[list] = []
    roots = []

    def value(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        v = value(gs, hs, low, high)
        nodes.append([0, np.inf, me, me, rate * v])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                c = codes[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                ok = (nl >= least) & (len(rows) - nl >= least)
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                if signs[f]:
                    ok &= signs[f] * (vr - vl) >= 0
                gain = np.where(ok, gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, k, float(vl[k]), float(vr[k])))
        if best[1] is not None:
            f, k, vl, vr = best[1]
            mid = (vl + vr) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[signs[f]]
            side = codes[rows, f] <= k
            left = grow(rows[side], g, h, level + 1, *bounds[0])
            right = grow(rows[~side], g, h, level + 1, *bounds[1])
            nodes[me] = [f, float(edges[f][k]), left, right, 0.0]
        else:
            margin[rows] += rate * v
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -8.0, 8.0))
    t = np.array(nodes, float).reshape(-1, 5)
    return Trees(t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4], np.array(roots, int), depth, start)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, x = statistics(batch.column(1).to_pylist())
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(base[:, k]) for k in range(5)), listed], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features"])


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score).

    A document is kept if it does not fail the base rule and the trees' probability of good
    quality is ``threshold`` or more. ``labels`` holds doc_id and quality (0, 1; null is no
    label); a doc_id with several labels counts with each. Without labels of both kinds the
    score is null and the base rule alone decides. A null or empty text has no words and fails
    the base rule. Repeated rows are measured each; an empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"
    stats = staged(pick(docs, "doc_id", "text").mapInArrow(lean(_measure), schema), "stats")
    known = pick(labels, "doc_id", "quality").dropna()
    share = sample / max(known.count(), 1)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(min(share, 1) * 1_000_003)) if share < 1 else known
    rows = stats.select(F.col("doc_id").alias("id"), "features").join(chosen, F.col("id") == F.col("doc_id")).select("id", "features", "quality")
    train = rows.orderBy(F.xxhash64("id"), "id", "features", "quality").limit(sample).toPandas()  # `sample` rows at most
    y = train["quality"].to_numpy(float)
    trees = fit_trees(np.stack(train["features"].to_numpy()), y, list(FEATURES.values())) if len(set(y)) > 1 else None
    shared = spark.sparkContext.broadcast(trees)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            x = batch.column(6).flatten().to_numpy().reshape(-1, len(FEATURES))
            p = pa.array(t.score(x)) if t is not None else pa.nulls(batch.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], p], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    judged = stats.mapInArrow(lean(judge), schema.replace("features array<double>", "score double"))
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.coalesce("score", F.lit(1.0)) >= threshold)).alias("kept"), "score",
    )
