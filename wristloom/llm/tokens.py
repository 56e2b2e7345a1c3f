"""Exact text-to-id encoding with a public tokenizer, cached by word.

A word-level tokenizer cuts texts at white space before anything else, so the ids
of a text are the ids of its white-space-separated chunks, in order.  Web text
repeats words, so each worker process keeps a bounded dictionary chunk -> ids, and
only chunks it has not seen go through the tokenizers library.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
END_ID = 2

#: Python splits at these, the tokenizer does not.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A chunk of Latin letters and then ASCII signs: two pre-tokens, whatever stands around it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
#: A sign before a stop or comma is in one pre-token with it; after a letter or digit a new one begins.  Only letters that are
#: the same after normalisation count: others may turn into a letter and a sign.
_SIGN_BEFORE = re.compile(r"[.,](?<=[^0-9A-Za-zÀ-ÖØ-öø-ÿ\s].)")
_SPECIAL = "<|"


def _chunks(text: str) -> list[str]:
    """Chunks that the tokenizer would cut apart as well, as alike as may be: lower case, stops and commas apart."""
    if _SPECIAL not in text:
        try:
            text.encode("latin-1")
            text = text.lower()  # up to U+00FF, letter by letter in any library
        except UnicodeEncodeError:
            pass
    if _SIGN_BEFORE.search(text) is None:
        text = text.replace(".", " .").replace(",", " ,")
    return text.split()


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets show printable bytes as themselves and the others from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


class CachedEncoder:
    """Ids of texts as bytes (little-endian unsigned 32-bit), equal to the tokenizer's own.

    At most 2 * cache_words chunks are kept: when the young half is full, it becomes the old
    half, and chunks that are still in use move back.
    """

    def __init__(self, path: str, cache_words: int = 250_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache_words = cache_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.hidden = _byte_letters()

    @property
    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _letters(self, head: str) -> bytes:
        head = head.lower()
        if not head.isascii():
            head = head.encode().decode("latin-1").translate(self.hidden)
        ids = [x.id for x in self.model.tokenize(head)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes | None:
        """The ids of a chunk of Latin letters, signs after them or not; None for any other."""
        if chunk.isalpha() and (chunk.isascii() or _LATIN.fullmatch(chunk)):
            return self._letters(chunk)
        if m := _PLAIN.fullmatch(chunk):
            head, tail = m.groups()
            for x in (head, tail):
                if x not in self.young:
                    self.young[x] = self._letters(x) if x is head else self._whole([x])[0]
            return self.young[head] + self.young[tail]
        return None

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        split, odd = [], []
        for k, text in enumerate(texts):
            if any(x in text for x in _SEPARATORS):
                odd.append((k, text))
                split.append([])
            else:
                split.append(_chunks(text))
        if len(self.young) > self.cache_words:
            self.old, self.young = self.young, {}
        young, old, rest = self.young, self.old, []
        for chunk in set().union(*split).difference(young):
            ids = old.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
            if ids is None:
                rest.append(chunk)
            else:
                young[chunk] = ids
        for chunk, ids in zip(rest, self._whole(rest) if rest else [], strict=True):
            young[chunk] = ids
        get = young.__getitem__
        out = [b"".join(map(get, x)) for x in split]
        for k, text in odd:
            out[k] = self._whole([text])[0]
        return out


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(name: str = WORD_BPE) -> CachedEncoder:
    """The worker process's encoder of that public vocabulary, or of a tokenizer file at a path."""
    if name not in _ENCODERS:
        _ENCODERS[name] = CachedEncoder(name if "/" in name else public_tokenizers.path(name))
    return _ENCODERS[name]
