"""Texts to ids with the ``tokenizers`` library, without special tokens around them."""

from __future__ import annotations

import re
import struct

from .common import worker_state
from .pieces import GPT_LATIN, LATIN, WORD_LATIN, SpacePieces, WordPieces, Words, visible


def _load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _packer():
    """Function from ids to bytes, with a compiled format for each usual number of them."""
    ready = [struct.Struct(f"<{n}I").pack for n in range(33)]

    def pack(ids: list[int]) -> bytes:
        n = len(ids)
        return ready[n](*ids) if n < 33 else struct.pack(f"<{n}I", *ids)

    return pack


def encoder(path: str):
    """Function from a text to its ids as little-endian unsigned 32-bit integers.

    The library's own normaliser, pre-tokeniser and model are called for pieces of the
    text; a tokeniser of an unknown kind encodes the whole text, as does any for a text in
    which an added token may stand.
    """

    def make():
        import json

        tokenizer = _load(path)
        model, normalizer, splitter = (
            tokenizer.model,
            tokenizer.normalizer,
            tokenizer.pre_tokenizer,
        )
        tokenize, pack = model.tokenize, _packer()
        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        kinds = _kinds(declared.get("pre_tokenizer"))
        normal = _kinds(declared.get("normalizer"))

        def whole(text: str) -> bytes:
            return pack(tokenizer.encode(text, add_special_tokens=False).ids)

        def guarded(pieces):
            """Texts that may hold an added token go to the library as a whole."""
            added = declared.get("added_tokens") or []
            if not added:
                return pieces
            if normal and any(token["normalized"] for token in added):
                return whole  # to be found in the normalised text only
            holds = re.compile("|".join(re.escape(token["content"]) for token in added)).search
            return lambda text: whole(text) if holds(text) else pieces(text)

        def ids_of(words) -> bytes:
            return pack([token.id for word in words for token in model.tokenize(word)])

        if declared["model"]["type"] != "BPE" or declared["model"].get("dropout"):
            return whole

        if kinds == ["ByteLevel"] and not normal:
            if declared["pre_tokenizer"]["add_prefix_space"]:
                return whole

            words = Words(lambda word: ids_of([visible(word)]))

            def unit(text: str) -> bytes:
                if LATIN.fullmatch(text):
                    return b"".join(map(words.__getitem__, GPT_LATIN.findall(text)))
                return ids_of(word for word, _ in splitter.pre_tokenize_str(text))

            def word(letters: str) -> bytes:
                shown = "Ġ" + letters if letters.isascii() else visible(" " + letters)
                return pack([token.id for token in tokenize(shown)])

            def bare(letters: str) -> bytes:
                return pack([token.id for token in tokenize(visible(letters))])

            return guarded(SpacePieces(unit, word, bare=bare).encode)

        if kinds == ["Split", "ByteLevel"] and normal == ["NFC", "Replace", "Lowercase"]:

            def library(text: str) -> bytes:
                text = normalizer.normalize_str(text)
                return ids_of(part for part, _ in splitter.pre_tokenize_str(text))

            words = Words(lambda word: ids_of([visible(word.lower())]))

            def piece(text: str) -> bytes:
                if LATIN.fullmatch(text):
                    return b"".join(map(words.__getitem__, WORD_LATIN.findall(text)))
                return library(text)

            def word(letters: str) -> bytes:
                lower = letters.lower()
                shown = lower if lower.isascii() else visible(lower)
                return pack([token.id for token in tokenize(shown)])

            return guarded(WordPieces(piece, word).encode)

        return whole

    return worker_state(("tokenizers", path), make)


def _kinds(declared) -> list[str]:
    if not declared:
        return []
    inner = declared.get("pretokenizers") or declared.get("normalizers")
    return [part["type"] for part in inner] if inner else [declared["type"]]
