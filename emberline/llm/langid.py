"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams by label in one Arrow pass and sums them in Spark; the matrix of
log probabilities (buckets x labels, a size fixed by parameters) is broadcast. Scoring looks up
the rows of a batch's n-grams and adds them up by document in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import lean, pick, staged, tune

UNKNOWN = "und"
_ORDERS = (2, 3)
_BLOCK = 250_000
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.bool_))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points with every run of non-letters as one 0, framed by 0; empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[c]
    if not letter.any():
        return np.empty(0, np.uint32)
    c = np.where(letter, c, np.uint32(0))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = c[keep]
    return np.concatenate(([np.uint32(0)] if c[0] else [], c, [np.uint32(0)] if c[-1] else [])).astype(np.uint32)


def _grams(c: np.ndarray, bits: int) -> np.ndarray:
    """Hash buckets of all n-grams of a block of code points."""
    out = []
    for n in _ORDERS:
        acc = np.full(max(len(c) - n + 1, 0), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            acc = (acc ^ c[i : i + len(acc)]) * np.uint32(0x85EBCA6B)
            acc ^= acc >> np.uint32(15)
        out.append((acc * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits))
    return np.concatenate(out)


def _blocks(c: np.ndarray) -> Iterator[np.ndarray]:
    """A text in blocks of bounded size that overlap so that no n-gram is lost or counted twice
    (but for those of lower order in the overlap, at most one a block)."""
    step = _BLOCK - max(_ORDERS) + 1
    for at in range(0, max(len(c) - max(_ORDERS) + 1, 1), step):
        yield c[at : at + _BLOCK]


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = _codes(text or "")
                if not len(c):
                    continue
                if lang not in sums:
                    sums[lang], docs[lang] = np.zeros(1 << bits, np.int64), 0
                docs[lang] += 1
                for block in _blocks(c):
                    sums[lang] += np.bincount(_grams(block, bits), minlength=1 << bits)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], docs[lang]))], ["lang", "bucket", "n"]
            )

    return run


class Model:
    """Log probabilities: ``rows`` (buckets x labels, float32), ``prior`` and the label names."""

    def __init__(self, names: list[str], rows: np.ndarray, prior: np.ndarray) -> None:
        self.names, self.rows, self.prior = names, rows, prior

    def score(self, texts: list[str | None], bits: int) -> tuple[list[str], list[float]]:
        codes = [_codes(t or "") for t in texts]
        total = np.tile(self.prior, (len(texts), 1))
        pending, owner, size = [], [], 0

        def flush() -> None:
            nonlocal pending, owner, size
            if pending:
                starts = np.cumsum([0] + [len(g) for g in pending[:-1]])
                np.add.at(total, owner, np.add.reduceat(self.rows[np.concatenate(pending)], starts, axis=0, dtype=np.float64))
            pending, owner, size = [], [], 0

        for i, c in enumerate(codes):
            for block in _blocks(c) if len(c) else ():
                g = _grams(block, bits)
                pending.append(g)
                owner.append(i)
                size += len(g)
                if size > _BLOCK:
                    flush()
        flush()
        share = np.exp(total - total.max(axis=1, keepdims=True)) if len(texts) else total
        best = share.argmax(axis=1) if len(texts) else []
        lang = [self.names[b] if len(c) else UNKNOWN for b, c in zip(best, codes, strict=True)]
        sure = [float(1 / share[i].sum()) if len(c) else 0.0 for i, c in enumerate(codes)]
        return lang, sure


def train(labelled: DataFrame, bits: int = 15, alpha: float = 0.1, max_labels: int = 256) -> Model | None:
    """Fit on all rows of ``labelled`` (text, lang); None where no row has a label and a letter."""
    tune(labelled.sparkSession)
    counts = pick(labelled, "text", "lang").where("lang is not null").mapInArrow(lean(_count(bits)), "lang string, bucket int, n long")
    counts = staged(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    names = sorted(r[0] for r in counts.select("lang").distinct().limit(max_labels + 1).collect())
    if len(names) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    if not names:
        return None
    table = counts.toPandas()  # at most 2**bits + 1 rows a label
    n, prior = np.zeros((1 << bits, len(names))), np.zeros(len(names))
    at = table["lang"].map({s: i for i, s in enumerate(names)}).to_numpy()
    bucket, value = table["bucket"].to_numpy(), table["n"].to_numpy()
    gram = bucket >= 0
    n[bucket[gram], at[gram]] = value[gram]
    prior[at[~gram]] = value[~gram]
    rows = np.log((n + alpha) / (n.sum(axis=0) + alpha * (1 << bits)))
    return Model(names, rows.astype(np.float32), np.log(prior / prior.sum()))


def identify(docs: DataFrame, model: Model | None, keep: list[str], bits: int = 15) -> DataFrame:
    """``keep`` columns of ``docs`` plus lang_pred and score (the posterior, 0 to 1).

    A null text or one without a letter, or no model, gives `und` with score 0.
    """
    spark = docs.sparkSession
    tune(spark)
    columns = list(dict.fromkeys(keep))
    d = docs.select(docs["text"].alias("_text"), *[docs[c] for c in columns])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lang, sure = m.score(texts, bits) if m else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(sure, pa.float64())], [*columns, "lang_pred", "score"])

    schema = d.drop("_text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return d.mapInArrow(lean(run), schema)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's text, modulo ``by``."""
    return F.crc32(doc_id.cast("string")) % by


def language_id(docs: DataFrame, fold: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang).

    Learns from text and non-null lang of the rows outside the held-out fold; predicts from the
    text alone. Ties go to the first label in order. A null doc_id is in no fold: it is neither
    learned from nor held out. Repeated rows count each; an empty table gives no rows; extra
    columns are ignored.
    """
    d = pick(docs, "doc_id", "text", "lang").withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), fold) == held_out, F.lit(False)))
    model = train(d.where("doc_id is not null and not held_out"))
    return identify(d, model, ["doc_id", "held_out"])
