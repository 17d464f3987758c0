"""Words of a byte-level tokenizer are cut and put together for a batch at once."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex

from evidentry.llm.columns import utf8
from evidentry.llm.tokenize import BYTE_LEVEL, CachedTokenizer, byte_classes, byte_words, default_path

PIECES = ["a", "be", "s", "t", "re", "ve", "m", "ll", "d", "S", "l", "r", "é", "ßĀ", "ª", "µ", "ɏ", "1", "23", "²", "¾", "'", "'", "''", ",", "?!", "_", "×", "¡", "-", " ", " ", "  ", "   ", "\n", "\n\n", " \n", "\n "]
UNSURE = ["\t", "\r\n", " ", "­", "ı", "İ", "ɐ", "и", "中文", "😀", "é", "\x00", "\x7f", "\x01", "<|endoftext|>", "<|endoftext|", " x", "’s"]


def texts(seed: int, n: int, pieces: list[str], most: int = 12) -> list[str]:
    dice = random.Random(seed)
    return ["".join(dice.choices(pieces, k=dice.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def coder():
    return CachedTokenizer(default_path("byte_bpe_50k.json"), 2)


def test_words_of_texts_end_to_end():
    for seed in range(20):
        some = texts(seed, 1000, PIECES)
        data, offsets = utf8(pa.array(some))
        at = byte_words(data, offsets, byte_classes(data)).tolist()
        raw = data.tobytes()
        assert [raw[a:b].decode() for a, b in zip(at, [*at[1:], len(raw)])] == [w for t in some for w in regex.findall(BYTE_LEVEL, t)]


@pytest.mark.parametrize("limit", [50, 1_200_000])
def test_ids_are_the_librarys(limit):
    own = CachedTokenizer(default_path("byte_bpe_50k.json"), 2, limit)
    for seed in range(8):
        some = [*texts(seed, 500, PIECES), *texts(seed, 100, PIECES + UNSURE), "", " ", "\n", "'", "'s", " 's", "x'", "é"]
        random.Random(seed).shuffle(some)
        assert own.encode(some) == own._direct(some)
        column = pa.array([None, *some, None, *some])[1:]  # a slice, with copies and a null
        end = np.array([2], own.wide).tobytes()
        assert own.encoded(column).to_pylist() == [x + end for x in own._direct([t or "" for t in column.to_pylist()])]


def test_small_columns(coder):
    end = np.array([2], coder.wide).tobytes()
    assert coder.encoded(pa.array([], pa.string())).to_pylist() == []
    assert coder.encoded(pa.array([None, ""], pa.string())).to_pylist() == [end, end]
    assert coder.encoded(pa.array(["中"], pa.string()), end=False).to_pylist() == coder._direct(["中"])
    assert coder.encoded(pa.array([None, ""], pa.string()), end=False).to_pylist() == [b"", b""]
    assert coder.encoded(pa.array(["a b", "и"], pa.large_string())).to_pylist() == [x + end for x in coder._direct(["a b", "и"])]


def test_a_batchs_word_is_looked_up_once(coder):
    class Counted(defaultdict):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    counted = coder.cache = Counted(None, coder.cache)
    counted.default_factory = counted.__len__
    some = [" ".join(random.Random(k).choices(["one", "two", "three", "four", "five"], k=50)) for k in range(200)]
    assert coder.encode(some) == coder._direct(some)
    assert counted.asked <= 10
