"""Public tokenizers with a bounded cache of words, exact to the token.

Both kinds of tokenizer here cut a text into words before they merge anything, and no merge
crosses a cut. So a text's ids are its words' ids end to end, and most words of a corpus are
repeats. Where it isn't certain that this module cuts as the tokenizer does (characters
outside printable ASCII and Latin letters, or a special token's string), the whole text is
given to the tokenizer. Words of a byte-level tokenizer are cut, told apart and put together
for a whole batch at once: Python sees each of a batch's distinct words a single time.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from evidentry.llm.columns import kept, utf8

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The word patterns of the two public tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_OTHER = re.compile("[^\n -~¡-¬®-įĲ-ɏ]")
BLANK, LETTER, NUMBER, MARK, UNSURE = range(5)


def _character_classes() -> np.ndarray:
    """The class of each character of one or two bytes."""
    out = np.full(0x800, UNSURE, np.uint8)
    for c in map(chr, range(0x250)):
        if not _OTHER.match(c):
            out[ord(c)] = BLANK if c in " \n" else LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else MARK
    return out


_CLASSES = _character_classes()
_BYTES = np.r_[_CLASSES[:128], np.full(128, UNSURE, np.uint8)]


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    out, data = _BYTES[data], np.append(data, np.uint8(0))
    at = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    code = (data[at].astype(np.int64) & 0x1F) << 6 | data[at + 1] & 0x3F
    found = np.where(data[at + 1] & 0xC0 == 0x80, _CLASSES[code], UNSURE)
    out[at] = found
    out[at[found < UNSURE] + 1] = found[found < UNSURE]
    return out


def byte_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where BYTE_LEVEL has words begin in texts that lie end to end; no byte is UNSURE."""
    n = len(data)
    heads = np.zeros(n + 3, bool)  # of texts
    heads[offsets] = True
    heads[n:] = True
    out, blank = heads[:n].copy(), classes == BLANK
    out[1:] |= (classes[1:] != classes[:-1]) & (data[:-1] != 32)  # a blank is part of the word after it
    out[1:-1] |= blank[1:-1] & blank[:-2] & ~blank[2:] & ~heads[2:n]  # and leaves the other blanks before it
    data = np.append(data, np.zeros(2, np.uint8))
    at = np.flatnonzero(data == 39)
    at = at[out[at] & ~heads[at + 1]]
    first, second = data[at + 1], np.where(heads[at + 2], 0, data[at + 2])
    long = ((first == 114) | (first == 118)) & (second == 101) | (first == 108) & (second == 108)  # 're, 've, 'll
    short = np.isin(first, np.frombuffer(b"stmd", np.uint8))
    at, size = at[short | long], np.where(long, 3, 2)[short | long]
    out[at + 1] = False
    out[(at + size)[at + size < n]] = True
    return np.flatnonzero(out)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedTokenizer:
    """Encodes texts to little-endian ids; ``limit`` words, some 280 MB, are kept at most between batches.

    An id takes two bytes (``wide``) where the vocabulary and ``end_id`` allow it, else four.
    """

    def __init__(self, path: str, end_id: int = 0, limit: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.vocabulary = end_id, max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.wide = "<u4" if self.vocabulary > 65536 else "<u2"
        self.cache: dict = {}  # of words: their ids, or their numbers in the three arrays below
        self.limit = limit
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        pre, norm = model.get("pre_tokenizer") or {}, model.get("normalizer")
        text = json.dumps([pre, norm])
        self.kind, self.sizes = "", None
        if pre.get("type") == "ByteLevel" and not norm and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.kind = "bytes"
            self.ids = np.array([end_id], self.wide)
            self._forget(0)
        elif json.dumps(WORD_LEVEL) in text and '"Lowercase"' in text and '"Removed"' in text:
            self.kind, self.words = "words", regex.compile(WORD_LEVEL)

    def _direct(self, texts: list[str]) -> list[bytes]:
        form = "H" if self.wide == "<u2" else "I"
        return [struct.pack(f"<{len(e.ids)}{form}", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str] | None:
        if not self.kind or any(s in text for s in self.special):
            return None
        if not (text.isascii() and text.replace("\n", "").isprintable()) and _OTHER.search(text):
            return None
        return text.split()

    def _joined(self, plain: list[str]) -> list[bytes]:
        """The ids of words of letters (after a blank, where blanks are part of words), many given to the tokenizer at once: it cuts them from each other, and nowhere else."""
        out = []
        if self.kind == "bytes":
            ids, begins, sizes = self._joined_by_bytes([w.encode() for w in plain])
            return [ids[b : b + n].tobytes() for b, n in zip(begins, sizes)]
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, owner = np.array(found.ids, self.wide), np.array(found.word_ids, np.int64)
            if not len(ids) or owner[-1] != len(part) - 1:
                out += self._direct(part)
                continue
            raw, ends = ids.tobytes(), (np.searchsorted(owner, np.arange(len(part)), "right") * ids.itemsize).tolist()
            out += map(raw.__getitem__, map(slice, [0, *ends], ends))
        return out

    def _joined_by_bytes(self, words: list[bytes], between: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each word's begin in them and how many they are, without the library's account of words.

        Each character of a token is a byte, so words end where the sums of bytes meet. ``between``
        is nothing or one character that stands alone.
        """
        if self.sizes is None:
            self.sizes = np.zeros(self.vocabulary, np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.sizes[i] = len(token)
        gap, out, begins, sizes, n = len(between), [], [], [], 0
        parts = [words[at : at + 512] for at in range(0, len(words), 512)]
        for some in (parts[at : at + 32] for at in range(0, len(parts), 32)):
            for part, found in zip(some, self.tokenizer.encode_batch_fast([between.join(p).decode() for p in some], add_special_tokens=False)):
                ids = np.array(found.ids, self.wide)
                reached = np.cumsum(self.sizes[ids])
                wanted = np.cumsum([*map(len, part)]) + gap * np.arange(len(part))
                last = np.searchsorted(reached, wanted)
                if len(ids) and reached[-1] == wanted[-1] and (reached[last] == wanted).all() and (reached[last[:-1] + gap] == wanted[:-1] + gap).all():
                    first = np.r_[0, last[:-1] + 1 + gap]
                    own = last + 1 - first
                else:
                    raw = self._direct([w.decode() for w in part])
                    ids, own = np.frombuffer(b"".join(raw), self.wide), np.array([len(x) for x in raw], np.int64) // ids.itemsize
                    first = np.cumsum(own) - own
                out.append(ids), begins.append(n + first), sizes.append(own)
                n += len(ids)
        none = np.zeros(0, np.int64)
        return np.concatenate([np.zeros(0, self.wide), *out]), np.concatenate([none, *begins]), np.concatenate([none, *sizes])

    def _forget(self, keep: int) -> None:
        """Keeps the ``keep`` words met first, which are the frequent ones. Word 0 is the end id."""
        words = defaultdict(None, islice(self.cache.items(), keep)) or defaultdict(None, {None: 0})
        words.default_factory = words.__len__  # a word gets its number as it is met
        self.cache = words
        if keep:
            self.begins, self.counts = self.begins[: len(words)], self.counts[: len(words)]
            self.ids = self.ids[: int((self.begins + self.counts).max())].copy()
        else:
            self.begins, self.counts, self.ids = np.zeros(1, np.int64), np.ones(1, np.int64), self.ids[:1]

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word; new ones are given to the tokenizer."""
        before, listed = len(self.cache), words.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.cache.__getitem__, listed), np.int64, len(listed))
        new = [listed[k] for k in np.flatnonzero(numbers >= before)]
        if new:
            blank, apart, spaced = [], [], []
            for k, word in enumerate(new):
                (apart if word[0] not in b" \n" else blank if word.isspace() else spaced).append(k)
            of = lambda which: [new[k] for k in which]
            raw = self._direct([w.decode() for w in of(blank)]) if blank else []
            sizes = np.array([len(x) for x in raw], np.int64) // self.ids.itemsize
            found = [self._joined_by_bytes(of(spaced)), self._joined_by_bytes(of(apart), b"\n"), (np.frombuffer(b"".join(raw), self.wide), np.cumsum(sizes) - sizes, sizes)]
            begins, counts, end = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), len(self.ids)
            for which, (ids, first, own) in zip([spaced, apart, blank], found):
                begins[which], counts[which] = end + first, own
                end += len(ids)
            self.ids = np.concatenate([self.ids, *(ids for ids, _, _ in found)])
            self.begins, self.counts = np.concatenate([self.begins, begins]), np.concatenate([self.counts, counts])
        return numbers

    def encoded(self, texts: pa.Array, end: bool = True) -> pa.Array:
        """Each text's ids (null: none), with the end id after them if ``end``."""
        if self.kind != "bytes":
            last = np.array([self.end_id], self.wide).tobytes() if end else b""
            return pa.array([x + last for x in self.encode([t or "" for t in texts.to_pylist()])], pa.binary())
        data, offsets = utf8(texts)
        classes = byte_classes(data)
        unsure = np.zeros(len(texts) + 1, bool)
        unsure[np.searchsorted(offsets, np.flatnonzero(classes == UNSURE), "right") - 1] = True
        raw = data.tobytes() if self.special else b""
        for token in self.special:
            if token.encode() in raw:
                unsure[:-1] |= pc.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)
        if not unsure.any():
            return self._encoded(data, offsets, classes, end)
        whole, cut = np.flatnonzero(unsure[:-1]), np.flatnonzero(~unsure[:-1])
        listed = texts.take(pa.array(whole)).to_pylist()
        distinct = list(dict.fromkeys(listed))
        found = dict(zip(distinct, self._direct(distinct)))
        last = np.array([self.end_id], self.wide).tobytes() if end else b""
        parts = [pa.array([found[t] + last for t in listed], pa.binary()), self.encoded(texts.take(pa.array(cut)), end)]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.r_[whole, cut])))

    def _encoded(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, end: bool) -> pa.Array:
        if len(self.cache) > self.limit:
            self._forget(self.limit // 2)
        at = byte_words(data, offsets, classes)
        bounds = np.append(at, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        numbers = self._numbers(words.dictionary)[words.indices.to_numpy()]
        ends = np.searchsorted(at, offsets[1:])  # of each text's words
        if end:
            numbers = np.insert(numbers, ends, 0)
            ends = ends + np.arange(1, len(ends) + 1)
        reached = np.r_[0, np.cumsum(self.counts[numbers])]
        places = np.repeat(self.begins[numbers] - reached[:-1], self.counts[numbers])
        places += np.arange(len(places))
        bounds = pa.array(np.r_[0, reached[ends]] * self.ids.itemsize).cast(pa.int32())  # an error beyond 2 GB
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, bounds.buffers()[1], pa.py_buffer(self.ids[places])])

    def _learn(self, words: set[str]) -> None:
        """Adds the words' ids to the cache. Letters, and letters before one other mark, are cut without the regex."""
        known = self.cache
        low = {w: w.lower() for w in words}
        plain, parts = set(), {}
        for word, w in low.items():
            if w.isalpha():
                plain.add(w)
            elif w and not (end := w[-1]).isalnum() and not end.isspace() and w[:-1].isalpha():
                base = w[:-1]
                parts[word] = base, end
                plain.add(base)
            else:
                parts[word] = self.words.findall(w)
        plain = list(plain.difference(known))
        known.update(zip(plain, self._joined(plain)))
        others = list(set().union(*parts.values()).difference(known))
        known.update(zip(others, self._direct(others) if others else []))
        known.update({w: known[ps[0]] + known[ps[1]] if len(ps) == 2 else b"".join(map(known.__getitem__, ps)) for w, ps in parts.items()})
        known.update({w: known[x] for w, x in low.items() if w not in known})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids; equal texts are encoded once."""
        if self.kind == "bytes":
            distinct = list(dict.fromkeys(texts))
            found = dict(zip(distinct, self.encoded(pa.array(distinct, pa.string()), end=False).to_pylist()))
            return [found[t] for t in texts]
        if len(self.cache) > self.limit:  # the words met first are the frequent ones
            self.cache = dict(islice(self.cache.items(), self.limit // 2))
        cut = {t: self._cut(t) for t in dict.fromkeys(texts)}
        new = set().union(*(words for words in cut.values() if words)).difference(self.cache)
        if new:
            self._learn(new)
        ids = self.cache.__getitem__
        out = {t: b"".join(map(ids, words)) for t, words in cut.items() if words is not None}
        whole = [t for t in cut if t not in out]
        out.update(zip(whole, self._direct(whole) if whole else []))
        return [out[t] for t in texts]


def tokenizer(path: str, end_id: int = 0, limit: int = 1_200_000) -> CachedTokenizer:
    """The one that this Python worker keeps, so that its cache outlives a task."""
    return kept(("tokenizer", path, end_id, limit), lambda: CachedTokenizer(path, end_id, limit))
