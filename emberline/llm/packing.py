"""Packing documents into fixed windows: minimum bin slack over the multiset of piece lengths.

1. An Arrow pass tokenises each whole text, cuts it into pieces of at most the window, and
   returns a row for each piece: its place, length and checksum, not its ids.
2. The histogram of piece lengths (at most one row for each length up to the window) goes to
   the driver. There a bitset subset-sum programme picks, for the longest piece left, the
   multiset of lengths that fills its window best; the pattern repeats while its pieces last.
3. Pieces of one length are numbered (in hash buckets, so a length that a third of all pieces
   share is spread over many tasks) and their number alone gives sequence and offset.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import lean, pick, staged, tune


class WordTokenizer:
    """Token ids of whole texts, as little-endian uint32 bytes.

    The tokenizer turns any run of white space into a cut that no token spans, cuts between a
    letter or digit and punctuation, and lower-cases. So texts are lower-cased (ASCII only) and
    cut into chunks, at white space and before punctuation that follows an ASCII letter or digit.
    The different chunks of a block of texts are looked up; new ones are encoded many at a time and
    kept in a table of bounded size. A text that could hold a special token, or a mark that combines with the letter
    before it (a composed capital need not have a composed small letter), is cut at white space only.
    Chunks of letters need no regular expressions to be cut and normalised, so lean encoders of the same model take them.

    All this follows from one kind of vocabulary file (``_cuts_words``); with any other, whole
    texts are encoded as they are.
    """

    #: Most bytes of chunks that are kept, with what a dictionary entry takes besides.
    KEPT = 40 << 20
    ENTRY = 160
    #: Bytes of text whose new chunks are encoded in one go.
    BLOCK = 1 << 21
    _SPACES = bytes.maketrans(b"\t\n\r\x0b\x0c", b" " * 5)
    _SMALL = bytes.maketrans(b"\t\n\r\x0b\x0cABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * 5 + b"abcdefghijklmnopqrstuvwxyz")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._encoder = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self._by_word = _cuts_words(json.load(f))
        self._ascii, self._latin = Tokenizer(self._encoder.model), Tokenizer(self._encoder.model)
        self._ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._latin.normalizer = normalizers.Lowercase()
        self._latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._known: dict[bytes, bytes] = {}
        self._held = 0
        self._last = np.zeros(self._encoder.get_vocab_size(), bool)
        self._last[[i for t, i in self._encoder.get_vocab().items() if t.endswith("</w>")]] = True
        self._word, self._mark = np.zeros(256, bool), np.zeros(256, bool)
        self._word[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
        self._mark[list(b".,;:!?%$&#*)|")] = True

    def _chunks(self, texts: list[bytes], whole: bool) -> tuple[pa.Array, np.ndarray]:
        """Chunks of some texts, and where those of each text begin (and the last ends); ``whole``: cut at white space only."""
        b = np.frombuffer(b"".join(texts).translate(self._SPACES if whole else self._SMALL), np.uint8)
        begin = np.cumsum([0, *map(len, texts)])
        inside = b != 32
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        if not whole:
            first[1:] |= self._mark[b[1:]] & self._word[b[:-1]]
        edge = begin[begin < len(b)]
        first[edge] = inside[edge]
        chars = b[inside]
        offsets = np.append(np.flatnonzero(first[inside]), len(chars))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(chars)])
        return chunks, np.searchsorted(np.flatnonzero(first), begin)

    @staticmethod
    def _one_word(chunk: bytes) -> bool:
        """Letters only, all below U+0250, where composing changes nothing and (but for U+0130) a small letter is one character."""
        text = chunk.decode("utf-8", "replace")
        return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode chunks joined by spaces. A chunk of plain letters is one word and ends with a
        word-end token; for any other, a token belongs to the chunk that its offset lies in."""
        plain, latin, other = [], [], []
        for c in chunks:
            (plain if c.isalpha() else latin if self._one_word(c) else other).append(c)
        for encoder, kind in ((self._ascii, plain), (self._latin, latin), (None, other)):
            for at in range(0, len(kind), 20_000):
                some = kind[at : at + 20_000]
                words = b" ".join(some)
                cut: list[int] = []
                if encoder is not None:
                    ids = np.array(encoder.encode_batch_fast([words.lower().decode()], add_special_tokens=False)[0].ids, "<u4")
                    cut = [0, *(4 * np.flatnonzero(self._last[ids]) + 4).tolist()]
                if len(cut) != len(some) + 1:
                    text = words.decode("utf-8", "replace")
                    got = self._encoder.encode(text, add_special_tokens=False)
                    ids = np.array(got.ids, "<u4")
                    starts = np.cumsum([0] + [len(w) + 1 for w in text.split(" ")])
                    cut = (4 * np.searchsorted(np.fromiter((first for first, _ in got.offsets), np.int64), starts)).tolist()
                data = ids.tobytes()
                self._held += len(data) + sum(map(len, some)) + self.ENTRY * len(some)
                self._known.update(zip(some, [data[i:j] for i, j in zip(cut, cut[1:], strict=False)], strict=True))

    def _block(self, texts: list[bytes], whole: bool) -> list[bytes]:
        """Ids of each text of a block: looked up once for each different chunk, then taken chunk by chunk into one buffer."""
        chunks, begin = self._chunks(texts, whole)
        if not len(chunks):
            return [b""] * len(texts)
        coded = chunks.dictionary_encode()
        met = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self._known.get, met))
        if new := [c for c, i in zip(met, found, strict=True) if i is None]:
            if self._held > self.KEPT:
                # Words met first are mostly the frequent ones: they stay.
                self._known = dict(islice(self._known.items(), len(self._known) // 3))
                self._held = sum(len(c) + len(i) + self.ENTRY for c, i in self._known.items())
                new = [c for c in met if c not in self._known]
            self._learn(new)
            found = list(map(self._known.__getitem__, met))
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        cut = np.frombuffer(offsets, np.int64, len(ids) + 1)[begin].tolist()
        view = memoryview(data or b"")
        return [bytes(view[i:j]) for i, j in zip(cut, cut[1:], strict=False)]

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of each text (UTF-8 bytes; None is empty), worked on in blocks of a few megabytes."""
        if not self._by_word:
            for text in texts:
                ids = self._encoder.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids
                yield np.array(ids, "<u4").tobytes()
            return
        at = 0
        while at < len(texts):
            kinds: tuple[list[bytes], list[bytes]] = [], []
            order, size = [], 0
            while at < len(texts) and size < self.BLOCK:
                text = texts[at] or b""
                whole = b"<|" in text or b"\xcc" in text or b"\xcd" in text
                kinds[whole].append(text)
                order.append(whole)
                size += len(text)
                at += 1
            found = [iter(self._block(kind, k == 1)) for k, kind in enumerate(kinds)]
            for whole in order:
                yield next(found[whole])


# Fixed parts of the vocabulary file that cutting by words relies on.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def _cuts_words(file: dict) -> bool:
    """Whether a tokenizer file lower-cases, cuts at white space and punctuation, and ends words with a mark."""
    first, *rest = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = file["model"]
    return (
        (file.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", _SPLIT, "Removed", True)
        and rest == [_BYTES]
        and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", "</w>", None)
        and all(t["content"].startswith("<|") for t in file.get("added_tokens", ()))
    )


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, so its tables serve all its tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _cut(path: str, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for k, ids in enumerate(tokenizer.encode(batch.column(1).cast(pa.binary()).to_pylist())):
                data = ids + end
                for i in range(0, len(data), step):
                    piece = data[i : i + step]
                    at.append(k)
                    start.append(i // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(data) // 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def best_fill(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (at most left[length] of each) whose sum comes closest to, and not over, capacity.

    ``reach`` is a bit set of attainable sums; it is kept after each step, so that the counts
    can be read back from the best sum.
    """
    if capacity <= 0:
        return {}
    mask, reach = (1 << (capacity + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    goal = 1 << capacity
    for length in sorted((n for n in left if n <= capacity), reverse=True):
        spare, take = min(left[length], capacity // length), 1
        while spare and not reach & goal:
            take = min(take, spare)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            spare -= take
            take *= 2
        if reach & goal:
            break
    total, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= take * length
    return out


def plan_windows(histogram: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to count) with the number of windows that each fills; all pieces are used.

    Minimum bin slack: every window takes the longest piece left and the best fill for the rest
    of it. Patterns number at most window * ln(window), whatever the number of pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = best_fill({n: c for n, c in left.items() if c}, window - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        repeats = min(left[n] // c for n, c in pattern.items())
        for n, c in pattern.items():
            left[n] -= c * repeats
            if not left[n]:
                del left[n]
        out.append((pattern, repeats))
    return out


def _place(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length, ranges of piece numbers with their pattern's first sequence, count and offset."""
    rows, used, base = [], {}, 0
    for pattern, repeats in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            count = pattern[length]
            low = used.get(length, 0)
            rows.append((length, low, count, base, offset))
            used[length] = low + count * repeats
            offset += count * length
        base += repeats
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {name: table[:, i] for i, name in enumerate(("length", "low", "count", "base", "offset"))}


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(t["length"], length, "left")
            end = np.searchsorted(t["length"], length, "right")
            while (step := end - at > 1).any():
                mid = (at + end) // 2
                up = step & (t["low"][np.minimum(mid, len(t["low"]) - 1)] <= number)
                at, end = np.where(up, mid, at), np.where(step & ~up, mid, end)
            k = number - t["low"][at]
            sequence, offset = t["base"][at] + k // t["count"][at], t["offset"][at] + k % t["count"][at] * length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    return run


def numbered(rows: DataFrame, key: str, order: list[str], sizes: dict[int, int]) -> DataFrame:
    """``rows`` with ``number``: 0, 1, ... within each value of ``key``, without one task for a value.

    ``sizes`` has the rows of each value. A value of n rows is dealt by a hash into about sqrt(n)
    buckets; rows are numbered inside a bucket, and the buckets' counts are added up, so
    neither step puts more than about sqrt(n) rows of a value into one task.
    """
    spark = rows.sparkSession
    deal = spark.createDataFrame([(k, math.isqrt(n) + 1) for k, n in sizes.items()], "k long, buckets long")  # a row a length, `window` at most
    part = rows.join(F.broadcast(deal), F.col(key) == F.col("k")).withColumn("bucket", F.pmod(F.xxhash64(*order), F.col("buckets"))).drop("k", "buckets")
    counts = part.groupBy(key, "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(key).alias("k"), F.col("bucket").alias("b"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    inside = part.withColumn("inside", F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order)) - 1)
    joined = inside.join(first, (F.col(key) == F.col("k")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("number", (F.col("first") + F.col("inside")).cast("long")).drop("k", "b", "bucket", "first", "inside")


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their place: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``tokenizer`` is the path of a vocabulary file that every executor can open. A null or
    empty text is one piece, the end id alone. Texts longer than the window are cut at its
    multiples. Rows that repeat a doc_id (or have none) are packed as documents of their own;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = pick(docs, "doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = staged(docs.mapInArrow(lean(_cut(tokenizer, window, end_id)), schema), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    shared = spark.sparkContext.broadcast(_place(plan_windows(histogram, window)))
    numbers = numbered(pieces, "length", ["doc_id", "start", "doc_tokens", "ids_crc32"], histogram)
    return numbers.mapInArrow(lean(_assign(shared)), schema + ", sequence_id long, offset long")
