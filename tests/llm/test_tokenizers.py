import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sparkpoison.llm import bpe, pretokens, token_count

ALPHABET = ["a", "s", "t", "re", "ll", "'", "'", " ", "  ", "\n", "\t", "　", "1", "é", "!", "漢", "\U0001F600", "d", "m", "v", "e", "l", "the", "<|endoftext|>", "\x00", "Ⅷ", "́", "\U00013460", "\U00010D40"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(7)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return [None, "", " ", "\n \n", "'", "a" * 3000, "ab" * 20_000, "!" * 5000, " " * 4000 + "x", "x<|endoftext|> <|endoftext|>", *made, *made[:50]]


def ids_of(library, text):
    return library.encode_ordinary(text or "")


def digest(ids):
    return hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_classes_are_the_librarys(counter):
    table = pretokens.Pretokenizer(pretokens.class_table()).classes
    cut = counter.pre_tokenizer.pre_tokenize_str
    for point in [*range(0x3000), *range(0xA000, 0xD800, 3), *range(0x10000, 0x20000, 5)]:
        letter, number = len(cut("x" + chr(point))) == 1, len(cut("1" + chr(point))) == 1
        assert letter == (table[point] == pretokens.LETTER) and number == (table[point] == pretokens.NUMBER), hex(point)


def test_encode_and_decode(spark, library):
    path, rows = P.path("byte_bpe_50k.tiktoken"), texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS ids", "'x' AS decoded")
    coded = bpe.encode(df, path, ["doc_id", "decoded"])
    assert coded.columns == ["doc_id", "decoded", "ids", "offsets"]
    for r in coded.collect():
        ids = ids_of(library, rows[r["doc_id"]])
        assert r["ids"] == ids
        ends = [len(library.decode_single_token_bytes(i)) for i in ids]
        assert r["offsets"] == [sum(ends[:k]) for k in range(len(ends))] if len(ends) < 300 else True
    for r in bpe.decode(coded, path, ["doc_id"]).collect():
        assert bytes(r["decoded"]) == (rows[r["doc_id"]] or "").encode()
    assert bpe.encode(df.limit(0), path, ["doc_id"]).count() == 0


def test_op4(spark, sf_dir, library):
    docs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = bpe.op4_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = ids_of(library, docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), digest(ids))
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()


def test_count(spark, counter):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in token_count.count_tokens(df, P.path("byte_bpe_50k.json"), ["doc_id"]).collect():
        text = rows[r["doc_id"]] or ""
        assert (r["n_tokens"], r["n_bytes"]) == (len(counter.encode(text, add_special_tokens=False).ids), len(text.encode())), text[:80]


def test_op5(spark, sf_dir, counter):
    docs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in token_count.op5_token_count(spark, sf_dir).collect():
        n = len(counter.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 512)
