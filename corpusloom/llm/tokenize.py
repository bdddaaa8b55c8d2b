"""Encoders with the ids of the tokenizers library, made fast where that provably gives the same ids.

Both need only texts of code points below U+0250, whose character classes and case never change between Unicode versions, and
without the strings of special tokens; other texts go through the library itself, whole."""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable

import tiktoken
from tokenizers import Tokenizer

#: Entries of a worker's table of distinct words; at this size it starts anew, which changes no ids.
TABLE = 400_000


def _far() -> re.Pattern:
    """Matches texts that need the library: code points from U+0250 on, and the four controls whose class differs between libraries."""
    return re.compile("[^\x00-\x1b\x20-\u024f]")


def _bytes_of_chars() -> dict[str, int]:
    """Byte-level BPE writes a byte as a printable character: itself where printable, else the next free one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> Callable[[str], list[int]]:
    """Encoder for a byte-level BPE file whose ids are the order of its merges: ranks of tiktoken are then its ids."""
    spec, odd, library = json.load(open(path, encoding="utf-8")), _far(), Tokenizer.from_file(path)
    byte, special = _bytes_of_chars(), {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    # Words of the byte-level pre-tokenizer: contractions, letters, numbers, others, white space.
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_bpe", pat_str=words, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if odd.search(text) or any(s in text for s in special):
            return library.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


class _Words(dict):
    """Ids of each distinct word, as little-endian 32-bit integers, segmented by the library's model when first met."""

    def __init__(self, library: Tokenizer):
        super().__init__()
        self.model, self.chars = library.model, str.maketrans({b: c for c, b in _bytes_of_chars().items()})

    def __missing__(self, word: str) -> bytes:
        as_chars = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.chars)
        ids = self[word] = array("I", [t.id for t in self.model.tokenize(as_chars)]).tobytes()
        return ids


@functools.lru_cache(maxsize=4)
def word_bpe(path: str) -> Callable[[str], bytes]:
    """Encoder for a lower-casing BPE file with word ends, giving ids as little-endian 32-bit integers."""
    odd, library = _far(), Tokenizer.from_file(path)
    special = [t["content"].lower() for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])]
    # Contractions, runs of letters, single numbers, runs of others; below U+0250 these are the library's words.
    words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:_|[^\s\w])+")
    table = _Words(library)

    def encode(text: str) -> bytes:
        low = text.lower()
        if odd.search(text) or any(s in low for s in special):
            return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        if len(table) > TABLE:
            table.clear()
        return b"".join(map(table.__getitem__, words.findall(low)))

    return encode
