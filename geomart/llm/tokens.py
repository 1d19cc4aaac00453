"""Byte-level BPE ids of whole texts inside Arrow tasks, with a bounded cache of space-separated segments.

A boundary of the pre-tokenizer always lies before a single space that stands between two other characters, so a text
whose spaces all do can be encoded segment by segment; any other text is encoded as a whole. Both ways give the same ids.
"""

from __future__ import annotations

import base64
from array import array

import public_tokenizers
import tiktoken


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class SegmentEncoder:
    """encode(text) -> the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks_path: str, cache_entries: int = 400_000):
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        self.limit = cache_entries
        self.cache = _Segments(self)

    def whole(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if len(self.cache) > self.limit:
            self.cache.clear()
        if not rest:
            return self.whole(text)
        if first[-1:].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.cache.__getitem__, rest))
        except TypeError:  # a None: a space that doesn't stand between two other characters
            return self.whole(text)


class _Segments(dict):
    def __init__(self, owner: SegmentEncoder):
        self.owner = owner

    def __missing__(self, piece: str):
        self[piece] = ids = None if not piece or piece[0].isspace() or piece[-1].isspace() else self.owner.whole(" " + piece)
        return ids
