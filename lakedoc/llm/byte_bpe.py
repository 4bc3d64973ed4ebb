"""Operator 9: byte-level BPE encoding and decoding from a file of ranks.

Method: a sentencepiece BPE model is serialised directly from the vocabulary. Bytes are
written as visible characters (the byte-level alphabet), the score of a piece is its
negative rank, and the normaliser is the identity, so that merging the neighbours whose
result scores best is merging by lowest rank. Each match of the pre-tokeniser's pattern
is encoded by itself; a match that is a vocabulary entry is that entry. Decoding joins
the byte strings of the ids.

Plan: one pass without shuffle; a task holds the vocabulary and a bounded cache.

Defined results: null and empty texts have no ids (digest of the empty string); null and
repeated ids are passed through; an empty table gives no rows; further columns are
ignored. Texts are taken whole. A byte that is no vocabulary entry is an error, as a
text that holds it could not be encoded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts, worker_state
from .pieces import ALPHABET, GPT_LATIN, LATIN, SpacePieces, Words, visible

# Fixed value: the public pre-tokeniser pattern of these ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


# -- serialisation: the few protocol-buffer fields that a model needs ------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """ModelProto: pieces (1), trainer_spec (2) and normalizer_spec (3).

    Piece 0 is the unknown piece; the piece of rank r has the id r + 1.
    """
    by_rank = sorted(ranks.items(), key=lambda item: item[1])
    if [rank for _, rank in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    parts = [_field(1, unknown)]
    for token, rank in by_rank:
        piece = _field(1, alphabet_text(token).encode()) + _field(2, float(-rank)) + _field(3, 1)
        parts.append(_field(1, piece))
    trainer = (
        _field(3, 2)  # model_type: BPE
        + _field(4, len(by_rank) + 1)
        + _field(40, 0)  # unk_id; there is no bos, eos or pad
        + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    )
    normalizer = (
        _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    )  # no dummy prefix, no removal and no escaping of white space
    return b"".join(parts) + _field(2, trainer) + _field(3, normalizer)


def alphabet_text(token: bytes) -> str:
    return token.decode("latin-1").translate(ALPHABET)


class Codec:
    """Encoder of whole texts and decoder of ids."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.pattern = regex.compile(PATTERN)
        self.tokens = {str(rank).encode(): token for token, rank in self.ranks.items()}
        self.words = Words(self._word)
        self.pieces = SpacePieces(self._unit, lambda word: self._word(" " + word), b" ")

    def _word(self, word: str) -> bytes:
        rank = self.ranks.get(word.encode())
        if rank is not None:
            return b"%d" % rank
        ids = self.model.encode(visible(word), out_type=int)
        if 0 in ids:
            raise ValueError(f"the vocabulary lacks a byte of {word!r}")
        return " ".join([str(i - 1) for i in ids]).encode()

    def _unit(self, text: str) -> bytes:
        split = GPT_LATIN if LATIN.fullmatch(text) else self.pattern
        return b" ".join(map(self.words.__getitem__, split.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids as decimal numbers with one space between them."""
        return self.pieces.encode(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.split()))


def codec(path: str) -> Codec:
    return worker_state(("byte-bpe", path), lambda: Codec(path))


def encode_documents(
    docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in slices(batches, 128):
            ids = [list(map(int, own.encode(t).split())) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, body``: the bytes that the ids of `encode_documents` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in slices(batches, 128):
            bodies = [
                b"".join(own.tokens[b"%d" % i] for i in ids or ())
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bodies, pa.binary())], names=["doc_id", "body"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, body binary")


def round_trips(
    docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in slices(batches, 256):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                body = own.decode(ids)
                count = ids.count(b" ") + 1 if ids else 0
                rows.append((count, _sha(ids), _sha(body)))
            count, first, second = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(first), pa.array(second)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _sha(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()
