"""Ids and decoded texts against the tokenizers library itself."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docpipe.llm.bpe import Bitmap, block_chunks, encode_documents, encode_parts, join_parts
from docpipe.llm.packing import pieces
from docpipe.llm.tokens import SpaceEncoder, WordEncoder

PARTS = [*"abzAZ019.,'!?-_<>|é ÀßİıŸǅ½²ªµ", "'s", "'LL", "the ", " and", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\0", " ", "́", "Σ", "中", "😀", "ﬁ", "Å", "<|endoftext|>", "<|startoftext|>", "  ", " \n ", "2024"]


def texts(n=1500):
    rng = random.Random(11)
    return ["", " ", "\n\n", *["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40))) for _ in range(n)]]


def test_word_encoder():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), WordEncoder(path)
    all_texts = texts()
    for text, (ids, decoded) in zip(all_texts, own.encode([t.encode() for t in all_texts]), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert decoded.decode() == library.decode(expected, skip_special_tokens=False)


def test_space_encoder():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), SpaceEncoder(path)
    all_texts = texts()
    for text, ids in zip(all_texts, own.encode(all_texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_chunks_anywhere_are_joined_exactly():
    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    for text in [t for t in texts(150) if t]:
        places = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(4))})
        chunks = [text[a:b].encode() for a, b in zip(places[:-1], places[1:], strict=True)]
        assert join_parts(encoder, [encode_parts(encoder, chunks)]) == encoder.encode([text.encode()])


def test_chunks_are_given_by_content():
    rng = np.random.default_rng(2)
    shared = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    texts_ = [b"x" * 777 + shared, b"", shared + b"tail", "é".encode() * 3000]
    chunks = block_chunks(np.frombuffer(b"".join(texts_), np.uint8), np.cumsum([0, *map(len, texts_)]))
    assert [b"".join(c) for c in chunks] == texts_
    assert len(set(chunks[0]) & set(chunks[2])) >= len(chunks[2]) - 2 > 5
    assert all(c.decode() for c in chunks[3])


def test_bitmap(spark):
    keys = [bytes([i] * 16) for i in range(200)]
    bitmap = Bitmap.of(spark.createDataFrame([(k,) for k in keys], "key binary"), len(keys))
    assert bitmap.has(keys).all() and not bitmap.has([hashlib.md5(k).digest() for k in keys]).any()


def expected_digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_documents(odd, none):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    source = {r.doc_id: r.text for r in odd.collect()}
    rows = encode_documents(odd).collect()
    assert len(rows) == odd.count()
    wanted = {i: expected_digest(library, t) for i, t in source.items()}
    assert all(tuple(r)[1:] == wanted[r.doc_id] for r in rows)
    assert encode_documents(none).count() == 0


def test_many_alternations(documents):
    """A text that alternates shared and own passages more often than a narrow number of the run could tell."""
    rng = np.random.default_rng(8)
    passage = lambda: rng.integers(97, 107, 4000, dtype=np.uint8).tobytes().decode().replace("a", " ")
    shared = [passage() for _ in range(20)]
    long = " ".join(x for i in range(1300) for x in (shared[i % 20], passage()))
    source = [long, *shared]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = encode_documents(documents(source)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: expected_digest(library, t) for i, t in enumerate(source)}


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pieces(odd, none, capacity):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    wanted = []
    for r in odd.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
            start = 0 if k == 0 else stop - capacity
            wanted.append((r.doc_id, k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
    assert sorted(map(str, map(tuple, pieces(odd, path, capacity).collect()))) == sorted(map(str, wanted))
    assert pieces(none, path).count() == 0
