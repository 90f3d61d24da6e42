import base64
import hashlib
import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from vecspark.llm import bpe
from vecspark.llm.queries import QUERIES, ranks_path


@pytest.fixture(scope="module")
def encoding():
    with open(ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_query_equals_the_library(spark, sf_dir, encoding):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op9_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(encoding, texts[r["doc_id"]])


def test_odd_texts(spark, encoding):
    rng = random.Random(5)
    alphabet = list("abcXYZ'st re0159 .,!\n\t\r  ") + ["  ", "\n\n", " \n", " ", " ", "é", "日", "😀", "é", "'ll", "\u0000", "\x1c", "\x85"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += [None, "", " ", "\n", "a\n b", "'s 's", "x" * 3000, "ab" * 2000, "<|endoftext|>", "long word " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.round_trip(df, ranks_path(), with_ids=True).collect():
        want = expected(encoding, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want, texts[r["doc_id"]]
        assert r["ids"] == encoding.encode_ordinary(texts[r["doc_id"]] or "")


def test_long_words(spark, encoding):
    rng = random.Random(7)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choices(of, k=n))
    texts = [letters(200_000), letters(97), letters(20_000, "ab"), "a" * 5000, "hello" * 3000, "=" * 999, "日本語" * 4000, letters(30_000, "étéß日本語中文ひらがな"), "0123456789" * 2000, letters(5000, "xyz") + "e" * 3000 + letters(3000)]
    began = time.time()
    got = bpe.codec(ranks_path(), bpe.PATTERN).encode(pa.array(texts)).lists().to_pylist()
    assert time.time() - began < 20
    for t, ids in zip(texts, got):
        assert ids == encoding.encode_ordinary(t)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.round_trip(df, ranks_path()).collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(got[r["doc_id"]])


def test_encode_then_decode(spark, edge_docs):
    ids = bpe.encode(edge_docs, ranks_path())
    back = bpe.decode(ids, ranks_path())
    assert sorted(bytes(r["text"]) for r in back.collect()) == sorted((r["text"] or "").encode() for r in edge_docs.collect())
    assert bpe.encode(edge_docs.limit(0), ranks_path()).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>"), ranks_path()).collect()


def test_answers_are_forgotten_and_found_again(encoding):
    own = bpe.Codec(bpe.load_ranks(ranks_path()), limit=50)
    rng = random.Random(9)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abcd.", k=3)) for _ in range(rng.randint(0, 30))) for _ in range(5)]
        assert own.encode(pa.array(texts)).lists().to_pylist() == [encoding.encode_ordinary(t) for t in texts]
        assert len(own.known) == len(own.used) <= 50
    assert own.encode(pa.array([], pa.string())).lists().to_pylist() == []


def test_generations_forget():
    r = bpe.Recent(2)
    for k in "abc":
        r[k] = k
    r.turn()
    assert not r and r.missing(["a", "z"]) == ["z"] and r["a"] == "a"
