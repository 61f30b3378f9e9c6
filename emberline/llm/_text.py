"""Vectorised word hashing: whole batches of texts become numpy arrays of 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that separate words: space and U+0009 to U+000D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD1342543DE82EF95
_SEGMENT = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche (xor-shift multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD) | np.uint64(1)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _SEGMENT + 4096)
            base = np.full(size, _P, np.uint64)
            base[0] = 1
            inverse = np.full(size, pow(_P, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            self.up, self.down = np.cumprod(base), np.cumprod(inverse)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _hash_words(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place of the first byte, and last two bytes (as one number) of each word of ``buf``."""
    b = np.frombuffer(buf, np.uint8)
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    up, down = _powers.get(len(b) + 1)
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _GOLD)
    ending = b[end - 1].astype(np.uint32) * np.uint32(256) + np.where(end - start > 1, b[end - 2], 0).astype(np.uint32)
    return hashes, start, ending


def _segments(data: bytes) -> Iterator[bytes]:
    """Cut a long text at spaces, so that working memory stays bounded."""
    at = 0
    while len(data) - at > _SEGMENT:
        cut = max(data.rfind(c, at, at + _SEGMENT) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            found = [i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := data.find(c, at + _SEGMENT)) >= 0]
            cut = min(found, default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def hash_words(texts: list[str | None], lower: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """64-bit hashes and endings of the words of each text, in order; None counts as empty.

    An ending is a 32-bit mix of a word's last two bytes.
    """
    out = [(np.empty(0, np.uint64), np.empty(0, np.uint32))] * len(texts)
    block: list[bytes] = []
    ids: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal block, ids, size
        if not block:
            return
        offsets = np.cumsum([0] + [len(x) + 1 for x in block])
        h, start, ending = _hash_words(b" ".join(block) + b" ")
        ending = ending * np.uint32(0x9E3779B1) >> np.uint32(7)
        cut = np.searchsorted(start, offsets)
        for k, i in enumerate(ids):
            out[i] = h[cut[k] : cut[k + 1]], ending[cut[k] : cut[k + 1]]
        block, ids, size = [], [], 0

    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        data = data.translate(_LOWER) if lower else data
        if len(data) > _SEGMENT:
            parts = [_hash_words(x) for x in _segments(data)]
            out[i] = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts]) * np.uint32(0x9E3779B1) >> np.uint32(7)
            continue
        if size + len(data) > _SEGMENT:
            flush()
        block.append(data)
        ids.append(i)
        size += len(data) + 1
    flush()
    return out


def hash_batch(texts: list[str | None], lower: bool = True) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in order; None counts as empty."""
    return [h for h, _ in hash_words(texts, lower)]


_COEF = mix(np.arange(101, 106, dtype=np.uint64) * _GOLD) | np.uint64(1)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text with fewer words is one shingle."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        acc = np.array([n], np.uint64) * _GOLD
        for w in words:
            acc = mix(acc ^ w)
        return acc
    acc = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        acc += words[i : n - width + 1 + i] * _COEF[i % 5] ^ np.uint64(i // 5)
    return np.unique(mix(acc))


#: Elements of a block, code points of a chunk.
_BLOCK, _CHUNK = 64, 4096


def blocks_sql(items: str) -> str:
    """SQL for the array ``items`` as blocks of 64 elements; adding to an array copies it, so long ones are built by block."""
    return f"transform(sequence(0, cast((size({items}) - 1) / {_BLOCK} as int)), b -> slice({items}, b * {_BLOCK} + 1, {_BLOCK}))"


def chunks_sql(text: str) -> str:
    """SQL for ``text`` in chunks that ``cut_sql`` cuts: a substring counts from the start of its text, however long."""
    return f"regexp_extract_all({text}, '(?s).{{1,{_CHUNK}}}', 0)"


def cut_sql(chunks: str, low: str, high: str) -> str:
    """SQL for the code points from ``low`` to ``high`` (exclusive) of a text in chunks."""
    part = f"substring({chunks}[c], greatest({low} - c * {_CHUNK}, 0) + 1, {high} - greatest({low}, c * {_CHUNK}))"
    span = f"sequence(cast(floor({low} / {_CHUNK}) as int), cast(floor(({high} - 1) / {_CHUNK}) as int))"
    return f"if({low} >= {high}, '', array_join(transform({span}, c -> {part}), ''))"
