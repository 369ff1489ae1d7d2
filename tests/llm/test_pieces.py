import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from llm.helpers import CLASHES, docs, rows_of, words
from salesloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return pieces.codec(f.read())


def test_any_text_equals_the_library(own, library):
    rng = random.Random(3)
    parts = [*"abcdeé日😀ß\n\t\r\x00<>_.,!?0", " ", "  ", "     ", "▁", "the", " in", "ing", "<0x41>", "</s>", "<unk>"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == library.decode(ids), repr(text)


def test_any_ids_decode_like_the_library(own, library):
    rng = random.Random(4)
    for _ in range(1500):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(260) for _ in range(rng.randrange(20))]
        assert own.decode(ids) == library.decode(ids), ids


def test_backtracking_where_the_longest_match_is_wrong(own, library):
    shortened = 0
    for text in words(3000, 1).split() + ["thhatherein", "ingthereation"]:
        unit = "▁" + text
        shortened += own.longest_matches(unit)[1] < len(unit)
        assert [own.begin, *own.backtrack(unit), own.end] == library.encode(text, add_bos=True, add_eos=True)
    assert shortened


def test_query_columns(spark, library):
    rows = [(1, "Some words, and\nlines.", "a"), (1, "Some words, and\nlines.", "a"), (2, None, "a"), (3, "", None), (None, "日本 é  x", "b"), (4, words(30_000, 2), "b"), (5, "x" * 50_000, "b")]
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = pieces.digest_texts(docs(spark, rows), "doc_id", "text", PATH)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert pieces.digest_texts(docs(spark, []), "doc_id", "text", PATH).collect() == []


def test_round_trip_keeps_rows_and_columns(spark, library):
    table = docs(spark, [(1, "a b", "s"), (2, None, None), (2, "  two  spaces ", "s")])
    with pytest.raises(ValueError):
        pieces.encode_texts(table, "text", PATH)  # it has a column ids
    coded = pieces.decode_ids(pieces.encode_texts(table, "text", PATH, "tokens"), "tokens", PATH)
    assert coded.columns == [*table.columns, "tokens", "decoded"] and CLASHES[0] in coded.columns
    assert rows_of(coded, "doc_id", "decoded") == [(1, "a b"), (2, "  two  spaces "), (2, "")]
