import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return bpe.BytePairCodec(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_like_the_library_on_odd_texts(own, library):
    rnd = random.Random(1)
    letters = list("ab  \n\t's'll12½²Ⅷé漢字🙂 　\x1c​.,!?")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(5000)]
    texts += ["", " ", "\n", " a", "a ", "it's 've", "a 's", "a" * 40, "é" * 17, "<|endoftext|>"]
    for text, (n, ids, data) in zip(texts, own.round_trip(texts), strict=True):
        expected = library.encode_ordinary(text)
        assert (n, ids, data) == (len(expected), " ".join(map(str, expected)), text.encode())
        assert own.encode(text) == expected


def test_one_very_long_match(own, library):
    text = "ab" * 30000
    assert own.merge(text.encode()) == library.encode_ordinary(text)


def test_cache_generations(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    for text in ["some words of one text", "other words, of another", "some words of one text"]:
        [(_, ids, _)] = own.round_trip([text])
        assert ids == " ".join(map(str, library.encode_ordinary(text)))


def test_nulls_empty_tables_and_other_columns(spark, library):
    rows = [(1, "It is. Is it?", "x"), (2, None, "y"), (3, "", "z"), (1, "It is. Is it?", "x"), (None, "a\n\nb", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    got = sorted(map(tuple, bpe.round_trip_digests(df, PATH, PATTERN).collect()), key=str)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert got == sorted(want, key=str)
    assert bpe.round_trip_digests(df.limit(0), PATH, PATTERN).count() == 0


def test_encode_then_decode(spark):
    df = spark.createDataFrame([(1, "Été, 12 ans"), (2, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN)
    assert {r.id: bytes(r.data).decode() for r in back.collect()} == {1: "Été, 12 ans", 2: ""}
