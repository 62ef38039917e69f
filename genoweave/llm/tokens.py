"""Token ids by the tokenizers library, with a cache of pre-tokens."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterable
from itertools import islice
from operator import itemgetter

import numpy as np

# The splitting pattern of byte-level BPE (public), written with the letters, digits and
# white space of the characters for which the library agrees (tests try them all); OTHER is the rest.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-ώА-я"
DIGIT = "0-9²³¹¼½¾"
SPACE = r"\t\n\r "
SPLIT = rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
OTHER = r"[^\t\n\r\x20-\x7E¡-ɏΑ-ΡΣ-ώА-я–-—‘-„…]"


#: Longer pre-tokens aren't remembered.
LONG = 64


def packed(ids: Iterable[int], width: int = 4) -> bytes:
    """Little-endian unsigned integers of that many bytes."""
    out = array("I" if width == 4 else "H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def widened(ids: bytes, width: int) -> bytes:
    """As little-endian unsigned 32-bit integers."""
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _byte_names() -> dict[int, str]:
    """The characters that byte-level BPE writes bytes with (public): printable ones stand for themselves, the others are numbered from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Ids by pre-token. A new one goes through the library's model when it is asked for."""

    def __init__(self, model, width: int):
        self.tokenize, self.width, self.names = model.tokenize, width, _byte_names()

    def __missing__(self, part: str) -> bytes:
        own = packed([t.id for t in self.tokenize(part.encode("utf-8").decode("latin-1").translate(self.names))], self.width)
        if len(part) <= LONG:
            self[part] = own
        return own


class Encoder:
    """Ids of whole texts as little-endian unsigned integers of `width` bytes: 2 if the vocabulary allows it, else 4.

    Byte-level BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in a row; each
    new pre-token goes through the library's model once and is then remembered. Any text with a character outside
    the agreed set, with the content of an added token, or for another kind of tokenizer, goes through the
    library whole. At `most` entries the older half of the cache is dropped and pre-tokens of over LONG
    characters aren't kept, so memory is bounded.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.cache = _Known(self.tokenizer.model, self.width)
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.splits = (
            kind["model"]["type"] == "BPE" and not kind.get("normalizer") and not kind.get("post_processor")
            and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        )
        self.split = re.compile(SPLIT).findall
        added = [re.escape(x["content"]) for x in kind.get("added_tokens") or []]
        self.other = re.compile("|".join([OTHER, *added])).search

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width)

    def encode(self, texts: Iterable[str | None]) -> Iterable[bytes]:
        for text in texts:
            text = text or ""
            if not self.splits or self.other(text):
                yield self.whole(text)
                continue
            parts, cache = self.split(text), self.cache
            if len(parts) < 2:
                yield self.whole(text)
                continue
            if len(cache) > self.most:
                for p in list(islice(cache, self.most // 2)):
                    del cache[p]
            yield b"".join(itemgetter(*parts)(cache))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
