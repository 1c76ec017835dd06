import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkpoison.llm import token_alignment as T
from sparkpoison.llm.minimal_hash import MinimalHash

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def whole(libraries, text):
    """(a ids, b ids, groups) of one text by both libraries; the byte level is undone by the library's decoder."""
    a, b = libraries
    if not text:
        return [], [], []
    want = (" " + text).encode()
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    letters = T.byte_alphabet()
    ba = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
    bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ib)]
    if b"".join(ba) != want or b"".join(bb) != want:
        return [], [], []
    ea, eb = np.cumsum([len(t) for t in ba]).tolist(), np.cumsum([len(t) for t in bb]).tolist()
    groups, at, bt = [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        i, j = ea.index(cut, at) + 1, eb.index(cut, bt) + 1
        groups.append((ia[at:i], ib[bt:j]))
        at, bt = i, j
    return ia, ib, groups


def expected(libraries, rows):
    found = [(i, *whole(libraries, t)) for i, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for *_, groups in found for g in groups)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for i, ia, ib, groups in found:
        links = [(x[-1], y[-1]) for x, y in groups]
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(ia), len(ib), len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), line))
    return out


def texts():
    rng = random.Random(11)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'s", "1", "12", "é", "é", "漢字", "\U0001F600", ".", "!!", "▁", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", " ", "　", "\x00", "\x1c", "ﬁ", "Ⅷ", "hello", "Hello world", " ́", " ", "\x85"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    return [None, "", " ", "  ", "x", " x", "x ", "a  b", "a b", "ab" * 5000, "漢" * 3000, "x y " * 3000, " " * 500, *made, *made[:20]]


def test_against_both_libraries(spark, libraries):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id")]
    df = spark.createDataFrame([(i, t, 5, "g") for i, t in rows], "doc_id long, text string, n_a int, groups string").repartition(5)
    got = T.align(df.select("doc_id", "text", "n_a", "groups"), A, B, ["doc_id"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(libraries, rows), key=repr)
    assert sum(r["n_a"] > 0 for r in got.collect()) > 300
    assert T.align(df.limit(0), A, B, ["doc_id", "n_a"]).count() == 0


def test_query(spark, sf_dir, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in expected(libraries, rows)}
    got = [tuple(r) for r in T.op12_token_alignment(spark, sf_dir).collect()]
    assert set(got) == want and len(got) == len(rows)


def test_rank_library_gives_the_byte_level_ids(libraries):
    v = T.Vocabularies(Path(A).read_text(encoding="utf-8"), Path(B).read_bytes())
    for point in [*range(0x3000), *range(0x3000, 0xD800, 17), *range(0xE000, 0x20000, 11)]:
        c = chr(point)
        text = f" x{c}1{c} {c}{c}\n{c} 's{c}"
        assert v.encode_a(text) == libraries[0].encode(text, add_special_tokens=False).ids, hex(point)


def test_minimal_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = rng.integers(0, 1 << 40, n)
        hashed = MinimalHash(np.concatenate([keys, keys[: n // 2]]))
        assert sorted(hashed.index(np.unique(keys)).tolist()) == list(range(hashed.n)) and hashed.n == len(np.unique(keys))
        others = np.setdiff1d(rng.integers(0, 1 << 40, 1000), keys)
        assert (hashed.index(others) == -1).all()
        assert n < 1000 or 64 * len(hashed.words) < 4.5 * hashed.n


def test_tree_sum(spark):
    rows = [(p, t, np.full(3, 10**t, "<i8").tobytes()) for p in range(2) for t in range(18)]
    df = spark.createDataFrame([(p, t, bytearray(v)) for p, t, v in rows], "piece int, part int, counts binary")
    got = T.tree_sum(df, 18).collect()
    assert [(r["piece"], np.frombuffer(r["counts"], "<i8").tolist()) for r in sorted(got)] == [(p, [int("1" * 18)] * 3) for p in range(2)]


def test_pairs_are_bounded_by_the_vocabularies():
    v = T.Vocabularies(Path(A).read_text(encoding="utf-8"), Path(B).read_bytes())
    assert 50_000 < v.most_pairs() < 1_000_000
    print(v.most_pairs())


def test_parts_share_a_call_of_the_byte_level_encoder():
    """Parts are told from one another by their bytes, not by a call each; those with white space at an end stay apart."""
    v = T.Vocabularies(Path(A).read_text(encoding="utf-8"), Path(B).read_bytes())
    encode, calls = v.encode_a, []
    v.encode_a = lambda text: (calls.append(text), encode(text))[1]
    words = [f"w{i}'s{'é' * (i % 3)}\n{i}" for i in range(500)]
    batch = [" ".join(words).encode(), b" a b\t", b"", " ".join(words[::-1]).encode(), "x  y z ".encode()]
    aligner = T.Aligner(v)
    numbers, per_text, right = aligner.parts(batch)
    assert len(calls) <= 10 and right[0] and right[3]
    assert [aligner.n_a[i] for i in numbers] == [len(encode(" " + p)) for t in batch for p in (T._CUT.split(t.decode()) if t else [])]
    assert aligner.parts(batch)[0].tolist() == numbers.tolist() and len(calls) <= 10


def test_plain_split_cuts_as_the_pattern():
    for text in filter(None, [*texts(), " ", "a b\nc d", "a\tb c", "a \x1cb c", "a\x85 b", "a  b c d"]):
        assert T._cut(text) == T._CUT.split(text), repr(text)
    assert T._cut("") == []
