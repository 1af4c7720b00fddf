"""Token ids of whole texts in the public byte-level vocabulary."""

from __future__ import annotations

import base64
import re
from array import array

import public_tokenizers

RANKS = "byte_bpe_50k.tiktoken"
MOST_CACHED = 400_000
SPLIT = re.compile(r"(?<=\S) (?=\S)")
END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256
"""The vocabulary's one special token. Its name within a text is that token, as in the tokenizer file's own reading."""


class Encoder:
    """Little-endian 32-bit ids of a text, equal to those of the vocabulary's tokenizer file.

    The pattern never joins what stands before a space between two characters that are not white to what follows,
    so texts are split there and the ids of frequent pieces are kept. The special token cuts a text before that:
    what stands on both sides of it is read by itself.
    """

    def __init__(self, path: str | None = None):
        import tiktoken

        with open(path or public_tokenizers.path(RANKS), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.known = _Known(self.encode)
        self.end = array("I", [END_OF_TEXT_ID]).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if END_OF_TEXT in text:
            return self.end.join(map(self, text.split(END_OF_TEXT)))
        first, *rest = SPLIT.split(text)
        head = array("I", self.encode(first)).tobytes()
        return head + b"".join(map(self.known.__getitem__, rest))


class _Known(dict):
    """Ids of a piece with the space before it; a full cache stays as it is."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        found = array("I", self.encode(" " + piece)).tobytes()
        if len(self) < MOST_CACHED and len(piece) < 64:
            self[piece] = found
        return found
