"""Token ids of whole texts by the tokenizers library, with a memory for words.

For a vocabulary that normalises to NFC and lower case and whose pre-tokens never
cross white space or the border between letters and marks (as the word-level BPE
used here), the ids of a text are the ids of its words, one after the other, and
marks that end a word may stand apart from it. :class:`WordEncoder` cuts texts up
accordingly, asks the library for each new word once and joins remembered ids. A
word of lower-case letters alone is one pre-token, so only the library's model is
asked; other words take its whole way. Texts for which that need not hold (special
tokens, vertical tabs, text that lower-casing takes out of NFC) go to the library
whole. Tests hold the result against the library's encoding of whole texts.

All this holds only for the normaliser and the pre-tokenizer that :data:`ASSUMED` states.
A vocabulary with any other is never cut up: the library encodes its texts whole.

The memory is two generations of at most ``MEMORY`` words: when the young one is
full it becomes the old one, whose words are taken over as they come up again.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

MEMORY = 700_000
#: What the shortcut takes for granted of a tokenizer file (fixed values of its format).
ASSUMED = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
_TAIL = re.compile(rb"(?<=[a-z0-9])([.,!]+)(?=[ \n])")


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary has for each byte."""
    shown = sorted(x for a, b in ((33, 127), (161, 173), (174, 256)) for x in range(a, b))
    rest = iter(range(256, 512))
    return [chr(x) if x in shown else chr(next(rest)) for x in range(256)]


_LETTER = _byte_letters()
assert set(_LETTER) == set(pre_tokenizers.ByteLevel.alphabet())


class WordEncoder:
    """Little-endian unsigned 32-bit ids of a text, as bytes."""

    def __init__(self, vocab_file: str):
        self.tokenizer = Tokenizer.from_file(vocab_file)
        parts = json.loads(self.tokenizer.to_str())
        # Added tokens are looked for before all else, so a text with a mark of one goes whole.
        self.by_words = all(parts.get(k) == v for k, v in ASSUMED.items()) and all(t["content"].startswith("<|") for t in parts["added_tokens"])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, new: set[bytes]) -> None:
        tokenize, young, old = self.tokenizer.model.tokenize, self.young, self.old
        for w in new:
            got = old.get(w)
            if got is None:
                x = w.decode()
                if x.isalpha() and (x.isascii() or x == x.lower()):
                    ids = [t.id for t in tokenize(x if x.isascii() else "".join(map(_LETTER.__getitem__, w)))]
                    got = struct.pack(f"<{len(ids)}I", *ids)
                else:
                    got = self._whole(x)
            young[w] = got

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words:
            return self._whole(text)
        raw = text.encode()
        if b"<|" in raw or b"\x0b" in raw or b"\x0c" in raw:
            return self._whole(text)
        low = raw.lower()
        if not text.isascii() and not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low.decode())):
            return self._whole(text)
        words = _TAIL.sub(rb" \1", low).split()
        if len(self.young) > MEMORY:
            self.old, self.young = self.young, {}
        new = set(words).difference(self.young)
        if new:
            self._learn(new)
        return b"".join(map(self.young.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(vocab_file: str) -> WordEncoder:
    """One encoder for each Python worker and vocabulary."""
    return WordEncoder(vocab_file)
