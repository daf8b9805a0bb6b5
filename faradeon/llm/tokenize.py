"""Byte-level BPE encoding with a bounded cache of encoded words."""

from __future__ import annotations

import re

import numpy as np

#: White space as the byte-level BPE pattern sees it (Unicode White_Space); fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_RARE = [c for c in WHITE if c not in " \n"]
_SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Letters, then ASCII marks but the apostrophe, which can begin a contraction.
_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
#: Encoded words of each of the two generations that a worker keeps, and the longest that it keeps (in characters).
#: They bound memory only.
CACHE_WORDS = 200_000
CACHE_CHARS = 64


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter: itself if it is one, else the next from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


class Encoder(dict):
    """``encode(text)`` -> little-endian uint32 ids as bytes, equal to those of the tokenizers library.

    The strings of special tokens in a text are those tokens, as is the library's default; with ``plain`` they
    are ordinary text.

    The byte-level pattern never joins a non-space character with white space that follows it, nor a letter with
    marks that follow it, so a text may be cut there and each piece encoded by itself. A run of letters (with a
    leading space) is one word of the pattern, so the library's model encodes it directly. Keys are pieces
    without their leading space (or with their leading line feed); values are the ids' bytes.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._special = [] if plain else [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._tokenizer.encode_special_tokens = plain
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._ends = {"\n": self.raw("\n")}
        self._older: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str, space: str = " ") -> bytes:
        """Ids of letters alone, after a space or nothing."""
        mapped = (space + word).encode().decode("latin-1").translate(self._letters)
        return np.array([t.id for t in self._model.tokenize(mapped)], "<u4").tobytes()

    def _end(self, marks: str) -> bytes:
        """Ids of a run of marks right after letters."""
        if marks not in self._ends:
            if len(self._ends) >= CACHE_WORDS:
                self._ends = {"\n": self._ends["\n"]}
            self._ends[marks] = self.raw(marks)
        return self._ends[marks]

    def __missing__(self, piece: str) -> bytes:
        ids = self._older.get(piece)
        if ids is None:
            if piece.isalpha():
                ids = self._word(piece)
            elif (end := _MARKED.fullmatch(piece)) and end[1].isalpha():
                ids = self[end[1]] + self._end(end[2])
            elif piece[:1] == "\n":
                rest = piece[1:]
                ids = self._ends["\n"] + self._word(rest, "") if rest.isalpha() else self.raw(piece)
            else:
                ids = self.raw(" " + piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self._older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self._special):
            return self.raw(text)
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[-1] in WHITE or text[0] in WHITE or any(c in text for c in _RARE):
            return b"".join(self._segment(x) for x in _SEGMENT.findall(text))
        head, *rest = text.replace("\n", " \n").split(" ")
        return self.raw(head) + b"".join(map(self.__getitem__, rest))

    def _segment(self, x: str) -> bytes:
        """A run of white space and the word after it."""
        if x[0] == " " and x[1:2] and x[1] not in WHITE:
            return self[x[1:]]
        return self[x] if x[0] == "\n" and x[1:2] and x[1] not in WHITE else self.raw(x)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)
