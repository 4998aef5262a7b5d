"""Token ids of whole texts, fast for tokenizers that drop white space.

``word_bpe_49k`` splits at white space before anything else, so the ids of a text
are those of its white-space chunks, one after the other. Each task keeps the ids
of chunks it has met. Texts for which that could differ (special-token strings,
control characters that Python alone takes for white space) go to the tokenizer
whole.
"""

from __future__ import annotations

import struct

import numpy as np

#: Chunks a worker remembers; at the bound the memory is emptied (results do not change).
CHUNKS_MAX = 600_000
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: White space that ends a chunk must be the same for both sides.
_ENDS = ".,!?;:"


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """Byte -> the letter that stands for it in byte-level vocabularies.

    Printable bytes stand for themselves, the others follow from U+0100 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: b for b in shown} | {b: 0x100 + i for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def _plain(letters: str) -> bool:
    return max(letters) < "\u0250" and "\u0130" not in letters


class _Memory(dict):
    """Ids of the chunks met so far; those of an unknown chunk are made by ``make``."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        got = self.make(chunk)
        if len(chunk) <= 64:
            self[chunk] = got
        return got


class ChunkTokenizer:
    """Ids of texts by a tokenizer file, as little-endian unsigned 16- or 32-bit bytes."""

    def __init__(self, path: str, dtype: str = "<u4"):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._chunks = _Memory(self._chunk)
        self._words: dict[str, bytes] = {}
        self._dtype = dtype
        self._pack = [struct.Struct(f"<{n}{'I' if dtype == '<u4' else 'H'}") for n in range(16)]

    def _bytes(self, ids: list[int]) -> bytes:
        return self._pack[len(ids)].pack(*ids) if len(ids) < 16 else np.array(ids, self._dtype).tobytes()

    def _direct(self, text: str) -> bytes:
        return self._bytes(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """Ids of Latin letters without the rules that only other texts need.

        Composed letters below U+0250 other than İ are stable under the tokenizer's
        normal form, become one letter each in lower case, and form one word.
        """
        word = word.lower()
        got = self._words.get(word)
        if got is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            got = self._bytes([t.id for t in self._model.tokenize(shown)])
            if len(word) <= 64:
                self._words[word] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        """Ids of one chunk; a closing mark after letters is a token of its own."""
        if len(chunk) == 1:
            return self._direct(chunk)
        if chunk[-1] in _ENDS:
            head = chunk[:-1]
            if head.isalpha() and (head.isascii() or _plain(head)):
                return self._word(head) + self._chunks[chunk[-1]]
        elif chunk.isalpha() and (chunk.isascii() or _plain(chunk)):
            return self._word(chunk)
        return self._direct(chunk)

    def pieces(self, text: str) -> list[bytes]:
        """The ids as bytes, chunk by chunk (one piece for a text taken whole)."""
        if any(mark in text for mark in _WHOLE):
            return [self._direct(text)]
        out = list(map(self._chunks.__getitem__, text.split()))
        for memory in (self._chunks, self._words):
            if len(memory) > CHUNKS_MAX:
                memory.clear()
        return out

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(text)), dtype=self._dtype)

    def count(self, text: str) -> int:
        return sum(map(len, self.pieces(text))) // np.dtype(self._dtype).itemsize
