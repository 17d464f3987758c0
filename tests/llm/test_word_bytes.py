"""Words of a byte-level tokenizer end where the bytes of its tokens meet theirs; no account of words is asked of the library."""

from __future__ import annotations

import random

from evidentry.llm.tokenize import CachedTokenizer, default_path


def test_words_end_where_bytes_meet():
    coder = CachedTokenizer(default_path("byte_bpe_50k.json"), 2)
    dice = random.Random(4)
    words = list({" " + "".join(dice.choice("abcdeéüßĀ") for _ in range(dice.randint(1, 12))) for _ in range(3000)})

    class Fast:
        """The library without its slower call."""

        def __getattr__(self, name):
            assert name != "encode"
            return getattr(library, name)

    library, coder.tokenizer = coder.tokenizer, Fast()
    assert coder._joined(words) == coder._direct(words)
    text = "".join(w + dice.choice(["", "", ",", "?!", "'s", " 12", "\n"]) for w in words).strip()
    assert coder.encode([text]) == coder._direct([text])
