"""Encoding of whole texts from the encodings of their pieces.

A text is cut at single spaces between two characters that are not white space. No match
of the byte-level pre-tokeniser's pattern spans such a cut and what follows is matched as
if the text began there, so the ids of a text are those of its pieces in a row. Pieces
repeat; a worker keeps the encodings of those met last. The cut is only a shortcut: texts
that have other white space are cut where it is safe, or encoded in one go.
"""

from __future__ import annotations

import re
import unicodedata

SAFE = re.compile(r"(?<=\S) (?=\S)")  # \S of Python excludes all that any library calls space


# The pre-tokenisers' patterns for texts of printable ASCII, line ends and composed Latin
# letters only. There letters and digits are plain ranges and nothing changes under NFC.
TOP = "\u0250"  # letters below it are the Latin ones that Unicode has had for decades
_LETTER = "A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u01c3\u01cd-\u024f"
LATIN = re.compile(rf"[{_LETTER}\n -~]*")
GPT_LATIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"
)
WORD_LATIN = re.compile(rf"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")



def byte_alphabet() -> str:
    """Character for each byte in the byte-level alphabet.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters
    from 256 on, in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(hidden)) for b in range(256))


ALPHABET = byte_alphabet()


def visible(word: str) -> str:
    """The UTF-8 bytes of a word, written in the byte-level alphabet."""
    if word.isascii() and word[1:].isalpha():
        return "Ġ" + word[1:] if word[0] == " " else word
    return word.encode().decode("latin-1").translate(ALPHABET)


class _Irregular(Exception):
    pass


class Cache(dict):
    """Encodings by piece, at most ``size`` of them; a full cache starts anew."""

    def __init__(self, encode, size: int, regular=None):
        super().__init__()
        self.encode, self.size, self.regular = encode, size, regular

    def __missing__(self, piece: str) -> bytes:
        if self.regular is not None and not self.regular(piece):
            raise _Irregular
        found = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[piece] = found
        return found


class Marked(Cache):
    """Cache that puts a word and a final mark together from their own encodings.

    ``word(w)`` encodes Latin letters, ``mark(m)`` one punctuation mark after a word. They
    are put together only where ``parted(w)`` holds: the library parts the word, as it
    stands after normalisation, from the mark.
    """

    def __init__(self, word, mark, other, size: int, regular=None, between: bytes = b"", parted=str.isalpha):
        super().__init__(other, size, regular)
        self.word, self.other, self.between, self.parted = word, other, between, parted
        self.marks = {m: between + mark(m) for m in ",.;:!?"}

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha() and (piece.isascii() or max(piece) < TOP and "\u0130" not in piece):
            found = self.word(piece)
        elif self.regular is not None and not self.regular(piece):
            raise _Irregular
        else:
            front = piece[:-1]
            if front and front.isalpha() and piece[-1] in self.marks and self.parted(front):
                found = self[front] + self.marks[piece[-1]]
            else:
                found = self.other(piece)
        if len(piece) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[piece] = found
        return found


MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Lines(Marked):
    """`Marked` that also takes any run of ASCII marks off a Latin word, and parts a piece at a
    single line end.

    For patterns that take such a run as one match and a line end between two other characters
    as a match of its own. ``bare`` encodes what begins a line, ``line`` is the line end.
    """

    def __init__(self, word, mark, other, size: int, regular, line: bytes, bare: Lines | None = None):
        super().__init__(word, mark, other, size, regular)
        self.runs, self.line = Cache(mark, 10_000), line
        self.bare = self if bare is None else bare

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            return super().__missing__(piece)
        front = piece.rstrip(MARKS)
        if front.isalpha() and (front.isascii() or max(front) < TOP and "\u0130" not in front):
            found = self[front] + self.runs[piece[len(front) :]]
        else:
            left, end, right = piece.partition("\n")
            if not (end and _inside(left) and _inside(right)):
                return super().__missing__(piece)
            found = self[left] + self.line + self.bare[right]
        if len(piece) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[piece] = found
        return found


class Words(Cache):
    """Encodings by word, for words that recur in pieces with other punctuation."""

    def __init__(self, encode, size: int = 100_000):
        super().__init__(encode, size)


def _inside(piece: str) -> bool:
    """Whether both ends are characters other than white space."""
    return bool(piece) and not piece[0].isspace() and not piece[-1].isspace()


class SpacePieces:
    """``encode(text)``: ids as bytes, for patterns that glue one space to what follows.

    ``unit(text)`` encodes a string by itself, ``word(w)`` Latin letters after a space.
    ``between`` separates the results of two pieces. ``bare(w)``, if given, encodes Latin
    letters that no space goes before; then line ends are cuts as well (see `Lines`).
    """

    def __init__(self, unit, word, between: bytes = b"", size: int = 600_000, bare=None):
        self.unit, self.between = unit, between
        other = lambda piece: unit(" " + piece)
        if bare is None:
            self.cache = Marked(word, unit, other, size, _inside, between)
        else:
            begun = Lines(bare, unit, unit, size // 6, _inside, unit("\n"))
            self.cache = Lines(word, unit, other, size, _inside, unit("\n"), begun)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if _inside(first):
            try:
                known = map(self.cache.__getitem__, rest)
                return self.between.join((self.unit(first), *known))
            except _Irregular:
                pass
        first, *rest = SAFE.split(text)
        parts = [self.unit(first)]
        parts += [self.cache[p] if _inside(p) else self.unit(" " + p) for p in rest]
        return self.between.join(parts)


def ends_in_letter(word: str) -> bool:
    """Whether the word still ends in a letter in NFC and lower case.

    Some letters end in a combining mark there, which goes with the marks that follow.
    """
    return unicodedata.normalize("NFC", word).lower()[-1].isalpha()


class WordPieces:
    """``encode(text)`` for tokenisers that drop all white space: any space is a safe cut."""

    def __init__(self, unit, word, size: int = 600_000):
        other = lambda piece: unit(piece) if piece else b""
        self.cache = Marked(word, unit, other, size, parted=ends_in_letter)

    def encode(self, text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        return b"".join(map(self.cache.__getitem__, parts))
