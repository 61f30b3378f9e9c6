"""Token ids of whole texts: those of the plain encoder, with one look-up for each different chunk of a block."""

import random

import numpy as np
from public_tokenizers import path

from emberline.llm import packing

FILE = path("word_bpe_49k.json")


def plain(encoder, text):
    return np.array(encoder.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()


class Counted(dict):
    """A table that counts look-ups and is never walked."""

    found = 0

    def get(self, *key):
        self.found += 1
        return super().get(*key)

    def __getitem__(self, key):
        self.found += 1
        return super().__getitem__(key)

    def keys(self):
        raise AssertionError("walked over the whole table")


def test_a_block_looks_up_each_different_chunk_once():
    tokens = packing.WordTokenizer(FILE)
    texts = [b"salt, pepper and salt. " * 500] * 20
    want = [plain(tokens._encoder, t) for t in texts]
    assert list(tokens.encode(texts)) == want
    tokens._known = Counted(tokens._known)
    assert list(tokens.encode(texts)) == want and tokens._known.found <= 10


def test_letters_take_no_regular_expressions():
    tokens = packing.WordTokenizer(FILE)
    encoder = tokens._encoder
    texts = ["Plainly worded text".encode(), "Élan Straße NAÏVE ŁÓDŹ".encode(), b"<| Kept CAPITALS"]
    want = [plain(encoder, t) for t in texts]
    tokens._encoder = None  # any use of it fails
    assert list(tokens.encode(texts[:2])) == want[:2]
    tokens._encoder = encoder
    assert list(tokens.encode(texts)) == want


def test_same_ids_as_the_plain_encoder(monkeypatch):
    rng = random.Random(3)
    bits = ["a", "B", "it's", "I'LL", " ", "\t", "\r\n", "\x0b", "\xa0", "\x85", " ", ".", ",", "!", "-", "(", "|", "12", "3", "É", "é", "É", "İ", "ß", "ª", "ΑΣ", "中", "😀", "‍", "̀", "ǅ", "<", "<|", "<|endoftext|>", "</w>", "\x00", "tion", "The"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))).encode() for _ in range(3000)]
    texts += [None, b"", b" ", b"\n\n", "\x85".encode(), b".", b"a", b"\xff\xfe abc\xe9 x.", b"abc\xcc", b"x" * 5000]
    for block, kept in ((1 << 21, 40 << 20), (1, 40 << 20), (400, 50_000)):  # all at once, a text a time, with chunks that go and come back
        monkeypatch.setattr(packing.WordTokenizer, "BLOCK", block)
        monkeypatch.setattr(packing.WordTokenizer, "KEPT", kept)
        tokens = packing.WordTokenizer(FILE)
        assert list(tokens.encode(texts)) == [plain(tokens._encoder, t) for t in texts]
    assert list(tokens.encode([])) == []
