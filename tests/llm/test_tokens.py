import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lakedoc.llm import byte_bpe, hf, packing, token_files
from lakedoc.llm.pieces import SpacePieces
from tests.llm.conftest import documents

ODD = [
    "", " ", "  ", "a  b", " a", "a ", "a\n b", "\n\n x  \n", "it's  don't 's IT'S", "a\x1cb \x1c c",
    "\x85 a\xa0b c", "<|endoftext|> x", "é é ́ x", "ΑΣ ΑΣ. İ ǅ", "日本 語 12 345 ½ x²",
    "'s 'S ’s", "ﬁ Å", "\r\n \r\n", "\U0001f600 a", "x" * 3000, "word, and. more!", "Ǆ, ŉ.",
]
BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def strings():
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'s", "1", "!", "é", "́", "\t", "\xa0", "日", "Σ", "\x1c", ","]
    return ODD + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(2000)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_encode_like_the_library(path):
    encode, library = hf.encoder(path), hf._load(path)
    for text in strings():
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == expected, text


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_letter_before_every_mark(path):
    """Some letters end in a combining mark after normalisation, which a mark joins."""
    from tokenizers import Tokenizer

    encode, library = hf.encoder(path), Tokenizer.from_file(path)
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    for mark in ",.;:!?":
        some = [letters[i : i + 40] for i in range(0, len(letters), 40)]
        rows = [" ".join(f"x{c}{mark}" for c in group) for group in some]
        rows += [" ".join(f"{c}{mark}" for c in group) for group in some if mark in ",."]
        for text, found in zip(rows, library.encode_batch(rows, add_special_tokens=False)):
            assert np.frombuffer(encode(text), "<u4").tolist() == found.ids, text
    for text in ("BELEDİYESİ, GAZETESİ: Sİ.", "क़, ड़. ਸ਼! ড়; ଡ଼?", "ΑΣ, ΟΔΟΣ. Σ!"):
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_codec_equals_tiktoken_and_decodes():
    import tiktoken

    codec = byte_bpe.Codec(RANKS)
    reference = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}
    )
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN
    for text in strings():
        ids = codec.encode(text)
        assert ids.decode() == " ".join(map(str, reference.encode_ordinary(text))), text
        assert codec.decode(ids) == text.encode()


def test_round_trips(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, "again"), (None, None)]
    docs = documents(spark, *rows)
    got = byte_bpe.round_trips(docs, RANKS).collect()
    bodies = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert sorted(r.decoded_sha256 for r in got) == bodies
    encoded = byte_bpe.encode_documents(docs, RANKS)
    decoded = byte_bpe.decode_ids(encoded, RANKS).collect()
    assert sorted(bytes(r.body) for r in decoded) == sorted((t or "").encode() for _, t in rows)
    assert byte_bpe.round_trips(docs.limit(0), RANKS).collect() == []


def test_token_files(spark, tmp_path):
    rows = [(i * 3 % 101, t) for i, t in enumerate(ODD)] + [(200 + i, "some words") for i in range(300)]
    rows += [(None, "x"), (None, None)]
    docs = documents(spark, *rows)
    folder = str(tmp_path / "tokens")
    got = token_files.token_file_digests(docs, BYTE, folder).collect()
    library, start = hf._load(BYTE), 2 + len(library_ids(BYTE, "x"))
    assert sorted(r.start for r in got if r.doc_id is None)[0] == 0
    by_id = {r.doc_id: r for r in got}
    for i, text in sorted((r for r in rows if r[0] is not None)):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        r = by_id[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    # the files hold page indexes and dictionary-coded ids, and can be read in part
    import glob

    import pyarrow.parquet as pq

    files = [pq.ParquetFile(f) for f in glob.glob(f"{folder}/tokens/*.parquet")]
    group = max((f.metadata.row_group(0) for f in files if f.metadata.num_rows), key=lambda g: g.num_rows)
    tokens = group.column(group.num_columns - 1)
    assert tokens.has_offset_index and "RLE_DICTIONARY" in tokens.encodings
    assert any("DELTA_BINARY_PACKED" in group.column(k).encodings for k in range(group.num_columns))
    some = token_files.read_tokens(spark, folder).where("doc_id between 200 and 210")
    assert some.count() == 11
    plan = some.select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan.split("ReadSchema")[1].split(">")[0]


def library_ids(path, text):
    return hf._load(path).encode(text, add_special_tokens=False).ids


def test_token_files_of_an_empty_table(spark):
    assert token_files.token_file_digests(documents(spark, (1, "a")).limit(0), BYTE).collect() == []


def test_plan_is_exact_and_tight():
    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.choice([10, 30, 100, 2048])
        counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(0, 60))}
        filled, got = packing.plan(counts, capacity), {}
        for lengths, count in filled:
            assert sum(lengths) <= capacity and count > 0
            assert sum(3 * n > capacity for n in lengths) <= 2
            for n in lengths:
                got[n] = got.get(n, 0) + count
        assert got == counts
    rng = random.Random(1)
    counts = {n: rng.randint(1, 1000) for n in range(1, 700)}
    sequences = sum(c for _, c in packing.plan(counts))
    assert sequences <= 1.001 * sum(n * c for n, c in counts.items()) / 2048 + 1


def test_packing_of_documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.choice([0, 1, 5, 5, 5, 40, 90])))) for i in range(120)]
    rows += [(500, "a " * 700), (501, None), (None, "x y"), (7, "same id")]
    packed = packing.pack(documents(spark, *rows), WORD, capacity=100, with_ids=True)
    got = packed.toPandas().sort_values(["sequence_id", "offset"])
    whole = {}
    for r in got.itertuples():
        assert r.length <= 100 and zlib.crc32(r.ids) == r.ids_crc32
        whole.setdefault(r.doc_id if r.doc_id == r.doc_id else None, []).append((r.start, r.ids))
    for i, text in rows:
        if i != 7:
            ids = library_ids(WORD, text or "") + [0]
            joined = b"".join(b for _, b in sorted(whole[i]))
            assert np.frombuffer(joined, "<u4").tolist() == ids
    sums = got.groupby("sequence_id").length
    assert (sums.sum() <= 100).all() and (sums.cumsum() - got.length == got.offset).all()
    together = packing.sequences(packed).toPandas()
    assert together.ids.map(len).sum() == 4 * got.length.sum()
    assert packing.pack(documents(spark, (1, "a")).limit(0), WORD).collect() == []


@pytest.mark.parametrize(
    "path, mark", [(BYTE, "<|endoftext|>"), (WORD, "<|endoftext|>"), (WORD, "<|startoftext|>")]
)
def test_added_tokens_encode_like_a_fresh_tokenizer(path, mark):
    from tokenizers import Tokenizer

    encode, library = hf.encoder(path), Tokenizer.from_file(path)
    texts = [f"a {mark} x", mark, f"a{mark}b", f"{mark}{mark}", f"a\n{mark}\tb  {mark.upper()}"]
    for text in [*texts, *(t + mark + t for t in ODD), *strings()]:
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == expected, text
    assert library.token_to_id(mark) in np.frombuffer(encode(texts[0]), "<u4")


def test_line_ends_and_runs_of_marks_part_known_words():
    """Pieces are put together from words met before, with the library's ids."""
    library, encode = hf._load(BYTE), hf.encoder(BYTE)
    words = ["one", "Two", "élan", "ıx", "it's", "x9", "", "你"]
    ends = ["", ".", "###", ".'", "''", "…", "\n", ".\n", "\n\n", "\r\n", " \n", "\n.", "$\n$"]
    for first, end, last in itertools.product(words, ends, words):
        for text in (f"a {first}{end}{last} b", f"{first}{end}{last}{end}"):
            ids = library.encode(text, add_special_tokens=False).ids
            assert encode(text) == np.array(ids, "<u4").tobytes(), text
    asked = []

    def said(kind):
        return lambda piece: asked.append(piece) or f"[{kind}{piece}]".encode()

    pieces = SpacePieces(said("u"), said("w"), bare=said("b"))
    assert pieces.encode("go one two\nthree four### five.\nsix") == (
        b"[ugo][wone][wtwo][u\n][bthree][wfour][u###][wfive][u.][u\n][bsix]"
    )
    asked.clear()
    pieces.encode("go two\nsix five### one\nthree")
    assert asked == ["go"]
