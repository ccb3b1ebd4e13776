import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from trackloom.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.BytePairCodec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(3)
    yield from ["", " ", "a", "<|endoftext|> it's", "x" * 5000, "ab" * 900 + "\n\n  ", "é" * 700, "日本語のテキスト 🎉🎉", "0123456789" * 60, " \t\n    x"]
    for n in (3, 40, 400):
        for letters in ("abcdefgh ", "etaoinshr .,'\n", "ñçé日 x", "aab"):
            yield "".join(r.choice(letters) for _ in range(n))
            yield "".join(r.choice(letters.strip()) for _ in range(n))


def test_ids_equal_the_library(codec, theirs):
    every = list(texts())
    ids, bounds = codec.encode(every)
    for i, text in enumerate(every):
        own = ids[bounds[i] : bounds[i + 1]]
        assert own.tolist() == theirs.encode_ordinary(text), text[:40]
        assert codec.decode(own).decode() == text


def test_tables(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "one two", "c"), (2, "one two", "d"), (2, "one two", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = P.path("byte_bpe_50k.tiktoken")
    out = bpe.round_trip(docs, path, P.PATTERN).collect()
    assert sorted(r.n_tokens for r in out) == [0, 0, 2, 2, 2]
    back = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == [b"", b"", b"one two", b"one two", b"one two"]
    assert bpe.round_trip(docs.limit(0), path, P.PATTERN).count() == 0
