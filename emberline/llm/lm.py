"""Language-model scoring: hashed maximum-entropy model with a class-factored softmax.

A token's probability is P(class | context) * P(digit | class, context) * P(digit | class and digit,
context) * P(word | leaf). Class and first digit come from the word's ending, the second digit from the
word itself, so frequent words have a leaf nearly to themselves; the end of the text is a class
of its own. Each of the three factors is a softmax over hashed features of the context joined
with the path so far: the word before (n-gram), the one before that (skip), both together, and
the endings of the last two words. They are trained by stochastic gradient steps inside each
partition, whose weights are averaged by Spark between rounds; each round sees another part of the
training texts, all of them once. The last factor is the maximum-entropy solution for one
feature a word, (c + 0.1) / (N_k + 0.1 * (V_k + 1)) within leaf k, so it needs exact counts:
those of frequent words are broadcast (a fixed number), those of all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import lean, pick, staged, tune
from ._text import hash_words
from .langid import remainder

SMOOTH = 0.1
#: Branches of each factor; rows of the weights (features are hashed into them).
WIDTH = 16
ROWS = 1 << 16
LEAVES = WIDTH**3
FREQUENT = 1 << 17
#: Words whose endings are features, at all and for each factor; tokens of one gradient step, at last and at first.
REACH = 2
_NEAR = (2, 2, 1)
_STEP = 4096
_FIRST_STEP = 256
_START = np.uint64(0x5851F42D4C957F2D)
_MERGE = 1_500_000
#: Rows 0 to _PATHS - 1 are the biases of the paths; then those of endings, then those of words.
_PATHS = 1 + WIDTH + WIDTH**2
_ENDINGS = ROWS // 2


def _tokens(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and leaves of each text; leaves have one entry more, the end's, which is 0."""
    for words, ending in hash_words(texts):
        first = 1 + ending % np.uint32(WIDTH - 1)
        second = (ending * np.uint32(0x85EBCA6B) >> np.uint32(13)) % np.uint32(WIDTH)
        third = (words >> np.uint64(59)).astype(np.uint32) % np.uint32(WIDTH)
        yield words, np.append((first * WIDTH + second) * WIDTH + third, 0).astype(np.int32)


def _hashed(x: np.ndarray, path: np.ndarray | int, low: int, high: int) -> np.ndarray:
    """Rows from low to high - 1 for a feature joined with a path."""
    h = (x ^ (path + np.uint64(0x9E3779B9))) * np.uint64(0xD6E8FEB86659FD93)
    h >>= np.uint64(40)
    h *= np.uint64(high - low)
    h >>= np.uint64(24)
    h += np.uint64(low)
    return h.astype(np.uint16)


def _features(words: list[np.ndarray], leaves: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each factor: weight rows (tokens x features) and the branch taken, over all texts of a batch.

    The end of a text has only the first factor.
    """
    # Texts one after the other, each behind REACH starts; ``here`` are the places of its tokens.
    start = np.full(REACH, _START)
    before = np.concatenate([x for w in words for x in (start, w)])
    ending = np.zeros(len(before) + 1, np.uint64)
    sizes = np.array([len(x) for x in leaves])
    first = np.cumsum(sizes + REACH - 1) - (sizes + REACH - 1)
    here = np.repeat(first + REACH - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    leaf = np.concatenate(leaves)
    ending[here] = (leaf // WIDTH + 1).astype(np.uint64) << np.uint64(20)
    word = np.ones(len(leaf), bool)
    word[np.cumsum(sizes) - 1] = False
    ending[here[~word]] = 0  # the place of an end is the next text's first start
    out = []
    for level in range(3):
        at, y = (here, leaf) if level == 0 else (here[word], leaf[word])
        path = (np.zeros(len(at), np.uint64), 1 + y // WIDTH**2, 1 + WIDTH + y // WIDTH)[level].astype(np.uint64)
        one = before[at - 1]
        columns = [path.astype(np.uint16), *(_hashed(ending[at - d], path, _PATHS, _ENDINGS) for d in range(1, _NEAR[level] + 1)), _hashed(one, path, _ENDINGS, ROWS)]
        if level == 0:
            two = before[at - 2]
            columns += [_hashed(two, np.uint64(3 << 40), _ENDINGS, ROWS), _hashed(one ^ two >> np.uint64(7), np.uint64(5 << 40), _ENDINGS, ROWS)]
        out.append((np.stack(columns, axis=1), (y // WIDTH ** (2 - level) % WIDTH).astype(np.int64)))
    return out


def _joined(texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray], list[np.ndarray]]:
    """``_features`` of all texts of a batch, with the words and leaves of each."""
    pairs = list(_tokens(texts))
    words, leaves = [w for w, _ in pairs], [x for _, x in pairs]
    return _features(words, leaves) if pairs else [], words, leaves


def _probabilities(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Probabilities of the branches of one factor."""
    logits = weights.take(features[:, 0], axis=0, mode="clip")
    for k in range(1, features.shape[1]):
        logits += weights.take(features[:, k], axis=0, mode="clip")
    np.clip(logits, -40, 40, out=logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _step(weights: np.ndarray, squares: np.ndarray, tokens: np.ndarray, f: np.ndarray, y: np.ndarray, rate: float) -> None:
    """One adaptive gradient step on the rows that the tokens' features touch."""
    g = _probabilities(weights, f)
    g[np.arange(len(y)), y] -= 1
    flat = f.reshape(-1)
    order = np.argsort(flat, kind="stable")
    rows = flat[order]
    first = np.flatnonzero(np.diff(rows.astype(np.int32), prepend=-1))
    sums, hit = np.add.reduceat(g.take(order // f.shape[1], axis=0, mode="clip"), first, axis=0), rows[first]
    now = squares[hit] + np.einsum("ij,ij->i", sums, sums)
    squares[hit] = now
    sums *= (rate / np.sqrt(now))[:, None]
    weights[hit] -= sums
    tokens[hit] += np.diff(first, append=len(rows))


def _train(shared, rate: float):
    """One pass of adaptive gradient steps over a partition, from the shared weights.

    Yields each touched row's weights, multiplied by the number of features that touched it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.copy()
        squares = np.ones(len(weights), np.float32)
        tokens = np.zeros(len(weights), np.int64)
        size = _FIRST_STEP
        for batch in batches:
            factors, _, _ = _joined(batch.column(0).to_pylist())
            at = 0
            while factors and at < len(factors[0][1]):
                for f, y in factors:
                    if at < len(y):
                        _step(weights, squares, tokens, f[at : at + size], y[at : at + size], rate)
                at += size
                size = min(_STEP, size * 9 // 8)
        moved = np.flatnonzero(tokens)
        for at in range(0, len(moved), 1 << 13):
            some = moved[at : at + (1 << 13)]
            part = weights[some] * tokens[some][:, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(tokens[some]), *(pa.array(part[:, k]) for k in range(WIDTH))], ["row", "seen", *(f"w{k}" for k in range(WIDTH))])

    return run


def fit(training: DataFrame, rounds: int = 2, rate: float = 1.0) -> np.ndarray:
    """Weights (ROWS x WIDTH) of the factors after ``rounds`` averaged rounds over ``training`` (doc_id, text).

    Each row is averaged over the partitions that met it, by how often they did.
    """
    spark = training.sparkSession
    weights = np.zeros((ROWS, WIDTH), np.float32)
    schema = "row int, seen long, " + ", ".join(f"w{k} float" for k in range(WIDTH))
    for r in range(rounds):
        part = training.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r).select("text")
        moved = part.mapInArrow(lean(_train(spark.sparkContext.broadcast(weights), rate)), schema)
        mean = moved.groupBy("row").agg(F.sum("seen").alias("seen"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(WIDTH)])
        table = mean.select("row", *[(F.col(f"w{k}") / F.col("seen")).cast("float").alias(f"w{k}") for k in range(WIDTH)]).toArrow()  # ROWS rows at most
        weights = weights.copy()
        weights[table["row"].to_numpy()] = np.stack([table[f"w{k}"].to_numpy() for k in range(WIDTH)], axis=1)
    return weights


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words with leaf (class) and count, merged over a bounded number of tokens."""
    words: list[np.ndarray] = []
    kinds: list[np.ndarray] = []
    held, docs = 0, 0

    def merged() -> pa.RecordBatch:
        w, k = np.concatenate(words), np.concatenate(kinds)
        order = np.argsort(w, kind="stable")
        first = np.flatnonzero(np.diff(w[order], prepend=w[order[:1]] ^ np.uint64(1)))
        n = np.diff(np.append(first, len(w)))
        return pa.RecordBatch.from_arrays([pa.array(w[order][first].view(np.int64)), pa.array(k[order][first]), pa.array(n.astype(np.int64))], ["word", "class", "n"])

    for batch in batches:
        docs += batch.num_rows
        for w, k in _tokens(batch.column(0).to_pylist()):
            if len(w):
                words.append(w)
                kinds.append(k[:-1])
                held += len(w)
                if held > _MERGE:
                    yield merged()
                    words, kinds, held = [], [], 0
    if words:
        yield merged()
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int32()), pa.array([docs], pa.int64())], ["word", "class", "n"])


def count_words(training: DataFrame) -> DataFrame:
    """(word, class, n) over all rows of ``training`` (text); word is a 64-bit hash, null stands for the end."""
    tune(training.sparkSession)
    return staged(training.select("text").mapInArrow(lean(_tally), "word long, class int, n long").groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n")), "words")


def _frequent(words: DataFrame) -> DataFrame:
    """The words with the largest counts: all those over the smallest count (on a grid of 16 steps
    an octave) that at most FREQUENT words reach. Only the grid is summed up on the driver."""
    step = F.floor(16 * F.log2("n")).cast("int")
    total, least = 0, None
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True):  # a row a step, about 1000 at most
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["step"]
    return words.where(step >= least) if least is not None else words.limit(0)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, frequent, logs, leaf_logs = shared.value
        for batch in batches:
            factors, words, leaves = _joined(batch.column(1).to_pylist())
            size = np.array([len(x) for x in leaves], np.int64)
            chosen = np.zeros(int(size.sum()))
            word = np.concatenate(leaves) > 0 if len(leaves) else np.empty(0, bool)
            places = (np.arange(len(chosen)), np.flatnonzero(word), np.flatnonzero(word))
            for (f, y), place in zip(factors, places, strict=False):
                for at in range(0, len(y), _STEP):
                    p = _probabilities(weights, f[at : at + _STEP])
                    chosen[place[at : at + _STEP]] += np.log10(p[np.arange(len(p)), y[at : at + _STEP]])
            known, base, factor, rare = [], [], [], []
            starts = np.cumsum(size) - size
            for i, w in enumerate(words):
                at = np.minimum(np.searchsorted(frequent, w), len(frequent) - 1) if len(frequent) else np.zeros(len(w), int)
                hit = frequent[at] == w if len(frequent) else np.zeros(len(w), bool)
                known.append(int(hit.sum()))
                base.append(float(logs[at[hit]].sum()))
                rare.append(w[~hit].view(np.int64))
                factor.append(float(chosen[starts[i] : starts[i] + size[i]].sum() - leaf_logs[leaves[i][:-1]].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(factor, pa.float64()), pa.array(rare, pa.list_(pa.int64()))],
                ["doc_id", "n_tokens", "known", "base", "factor", "rare"],
            )

    return run


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text).

    ``base_score``: the add-0.1 unigram score in log10, ``score``: the model's log10 probability,
    both over the words and one end of text. Words never seen in training share the unknown
    probability. A null or empty text is the end alone. With no training rows N and V are 0.
    Repeated rows are scored each; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    training, docs = pick(training, "doc_id", "text"), pick(docs, "doc_id", "text")
    counts = count_words(training)
    by_class = {r["class"]: (r["n"], r["v"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # LEAVES rows at most
    n_all, v_all = sum(n for n, _ in by_class.values()), sum(v for _, v in by_class.values())
    ends = by_class.get(0, (0, 0))[0]
    leaf_logs = np.array([np.log10(n + SMOOTH * (v + 1)) for n, v in (by_class.get(k, (0, 0)) for k in range(LEAVES))])
    words = counts.where("word is not null")
    top = _frequent(words).toPandas()  # FREQUENT rows at most
    heads, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.float64)
    order = np.argsort(heads)
    shared = spark.sparkContext.broadcast((fit(training), heads[order], np.log10(n[order] + SMOOTH), leaf_logs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = staged(
        docs.mapInArrow(lean(_score(shared)), f"doc_id {kind}, n_tokens long, known long, base double, factor double, rare array<long>").withColumn("row", F.monotonically_increasing_id()), "scored"
    )
    rare = scored.select("row", F.explode("rare").alias("w"))
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))
    tail = rare.join(words.select("word", "n"), F.col("w") == F.col("word"), "left").groupBy("row").agg(F.sum(log).alias("tail"), F.count("n").alias("more"))
    end = float(np.log10(ends + SMOOTH))
    whole = float(np.log10(n_all + SMOOTH * (v_all + 1)))
    text = F.col("base") + F.coalesce("tail", F.lit(0.0))
    return scored.drop("rare").join(tail, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (text + F.lit(end) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("factor") + text).alias("score"),
    )


def lm_score(docs: DataFrame, fold: int = 10, held_out: int = 0) -> DataFrame:
    """``score`` of all rows, learned from those whose crc32(doc_id as text) mod ``fold`` is not
    ``held_out``; adds held_out. A null doc_id is in no fold: scored, neither learned from nor held out."""
    d = pick(docs, "doc_id", "text")
    out = score(d, d.where(remainder(F.col("doc_id"), fold) != held_out))
    held = F.coalesce(remainder(F.col("doc_id"), fold) == held_out, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
