"""Token ids of whole texts by the tokenizers library, chunk by chunk with a bounded memory."""

from __future__ import annotations

import os
import re
import sys
from array import array

CACHE_CHUNKS = 1_000_000
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: Chunks made of Latin letters, simple marks and single newlines only: each part is one pre-token.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-įı-ɏ", ".,!?;:#*$%&"
_PLAIN = re.compile(f"(?:[{_LETTERS}{_MARKS}]+(?:\n(?!\n))?)+")
_PARTS = re.compile(f"\n|[{_LETTERS}]+|[{_MARKS}]+")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself where it is visible, the next
    free one from 256 on where it isn't."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Known(dict):
    """Ids (as bytes) by chunk, found out when first asked for."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, key):
        self[key] = out = self.find(key)
        return out


class ChunkEncoder:
    """Encodes a text as the concatenation of its space-separated chunks.

    No pre-token of these vocabularies crosses the chunk borders used here, so the ids are those of
    the whole text. Chunks repeat a lot; their ids are kept, up to CACHE_CHUNKS, then forgotten.

    words=True: white space is dropped by the tokenizer, chunks are words.
    words=False: a space belongs to the word behind it. A space with white space on both sides
    (or at the end of the text behind white space) could be inside a pre-token; such a text is
    encoded as a whole.

    A chunk of plain Latin words and marks goes to the vocabulary's model part by part, any other
    through the whole tokenizer.
    """

    def __init__(self, path: str, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.words = self.tokenizer.model, words
        self.table = _byte_characters()
        self.first = _Known(lambda chunk: self._chunk(chunk.decode(), ""))
        self.later = _Known(lambda chunk: self._chunk(chunk.decode(), " "))

    def _packed(self, ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, text: str, space: str) -> bytes:
        parts = [text] if text.isascii() and text.isalpha() else _PARTS.findall(text) if _PLAIN.fullmatch(text) else None
        if parts is None:
            return self._whole(space + text)
        if len(parts) > 1:
            known = self.later if space else self.first
            return b"".join([known[parts[0].encode()], *[self.first[p.encode()] for p in parts[1:]]])
        seen = (space + text).encode()
        if self.words:
            seen = text.lower().encode()
        return self._packed([t.id for t in self.model.tokenize(seen.decode("latin-1").translate(self.table))])

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; a null text has none."""
        if not text:
            return b""
        for known in (self.first, self.later):
            if len(known) > CACHE_CHUNKS:
                known.clear()
        if self.words:
            return b"".join(map(self.first.__getitem__, text.encode().split()))
        if _UNSAFE.search(text):
            return self._whole(text)
        first, *rest = text.encode().split(b" ")
        return b"".join([self.first[first], *map(self.later.__getitem__, rest)])


_OPEN: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, words: bool) -> ChunkEncoder:
    """One encoder for each worker process."""
    if (path, words) not in _OPEN:
        _OPEN[path, words] = ChunkEncoder(path, words)
    return _OPEN[path, words]
