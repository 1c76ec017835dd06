"""Token counts by finite-state transduction.

Two machines. The first finds the pieces: chunks of text become state maps and compose in a
parallel prefix scan (``pretokens``). The second counts tokens inside a piece in one pass
from left to right: a deterministic transducer whose transitions carry the change of the
number of tokens.

Why a finite machine can count: let e(i) be the last token of the encoding of a piece's
first i bytes. The encoding of i bytes is the encoding of the bytes before e(i), then e(i),
and e(i) is the one token t ending at i that keeps apart from its predecessor e(i - |t|),
that is, for which merging the bytes of both gives both again. Only tokens that can still
grow matter, so a state is the longest suffix that begins some token, with e and the
relative count at each of its places. States, transitions and pair tests are compiled when
first met and kept by the task.
"""

from __future__ import annotations

import json
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkpoison.llm.bpe import CACHE_CHARS, CACHE_PIECES, vocabulary_path
from sparkpoison.llm.common import map_texts, read, text_bytes
from sparkpoison.llm.pretokens import Pretokenizer, class_table

#: compiled transitions and pair tests a task keeps before it begins anew
CACHE_TRANSITIONS = 2_000_000


def _byte_names() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: itself where visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in visible}
    hidden = (b for b in range(256) if b not in set(visible))
    return names | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_model(path: str) -> bytes:
    """What tasks need of a byte-level BPE model file: merges in order and added tokens, compressed."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))
    cutter = model["pre_tokenizer"] or {}
    if model["model"]["type"] != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or model["normalizer"]:
        raise ValueError("only byte-level BPE models without normaliser and prefix space are compiled")
    added = [t["content"] for t in model["added_tokens"]]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
        raise ValueError("added tokens that take in white space or depend on words are not compiled")
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    return zlib.compress(json.dumps({"merges": merges, "added": added}).encode())


class Transducer:
    """Counts tokens of byte strings; transitions are compiled when first needed."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        self.growing = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.forget()

    def forget(self) -> None:
        self.moves: dict[int, tuple[int, int]] = {}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        # suffix that may still grow; for each of its places (its begin included) the last token and tokens less than now
        self.states = [(b"", ((b"", 0),))]
        self.number = {self.states[0]: 0}

    def encode(self, piece: bytes) -> list[bytes]:
        """Merge by rank, leftmost first: the definition, used on two tokens at a time."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := self.rank.get(pair)) is not None]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def keeps_apart(self, a: bytes, b: bytes) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            known = self.apart[a, b] = self.encode(a + b) == [a, b]
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the number of tokens)."""
        suffix, places = self.states[state]
        longer = suffix + bytes([byte])
        for i in range(len(longer)):
            token, (last, less) = longer[i:], places[i]
            if token in self.tokens and (not last or self.keeps_apart(last, token)):
                break
        change = 1 - less
        grown = [(last, less + change) for last, less in places] + [(token, 0)]
        cut = 0
        while cut < len(longer) and longer[cut:] not in self.growing:
            cut += 1
        new = (longer[cut:], tuple(grown[cut:]))
        number = self.number.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        self.moves[state << 8 | byte] = number, change
        return number, change

    def count(self, piece: bytes) -> int:
        state = total = 0
        for byte in piece:
            move = self.moves.get(state << 8 | byte)
            state, change = move if move is not None else self.compile(state, byte)
            total += change
        return total


class Counter(dict):
    """Piece -> what the transducer emits on it."""

    def __init__(self, model: bytes, table: bytes):
        super().__init__()
        spec = json.loads(zlib.decompress(model))
        names = _byte_names()
        plain = lambda t: bytes(names[c] for c in t)
        self.machine = Transducer([(plain(a), plain(b)) for a, b in spec["merges"]])
        self.cutter = Pretokenizer(table)
        # Longest first, as the library matches added tokens.
        added = sorted((t.encode() for t in spec["added"]), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.chars = 0

    def __missing__(self, piece: str) -> int:
        self.chars += len(piece)
        n = self[piece] = self.machine.count(piece.encode())
        return n

    def tokens(self, texts: list[bytes]) -> np.ndarray:
        """Number of tokens of every text."""
        if len(self) > CACHE_PIECES or self.chars > CACHE_CHARS:
            self.clear()
            self.chars = 0
        if len(self.machine.moves) + len(self.machine.apart) > CACHE_TRANSITIONS:
            self.machine.forget()
        # An added token is one token and ends the text before it.
        segments = [self.added.split(t) if self.added else [t] for t in texts]
        parts = np.array([len(s) for s in segments], np.int64)
        whole, cuts, per_segment = self.cutter.split([s for segment in segments for s in segment])
        at = cuts.tolist()
        counts = np.fromiter((self[whole[a:b]] for a, b in zip(at, at[1:])), np.int64, len(at) - 1)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per_segment)])]
        return np.diff(ends[np.concatenate([[0], np.cumsum(parts)])]) + parts - 1


def count_tokens(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row's whole text.

    A null or empty text has 0 of both. The strings of the model's added tokens count as one token wherever they
    stand; nothing is added at begin or end. Other columns are not read; an empty table gives an empty result.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    model, table = read_model(path), class_table()

    def make():
        counter = Counter(model, table)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = text_bytes(batch.column(len(keep)))
            columns = {f"k{i}": batch.column(i) for i in range(len(keep))}
            return pa.RecordBatch.from_pydict(columns | {
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_tokens": pa.array(counter.tokens(texts), pa.int64()),
            })

        return step

    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    schema = "".join(f"k{i} {kinds[c]}, " for i, c in enumerate(keep)) + "n_bytes long, n_tokens long"
    return map_texts(rows, "text", schema, make).toDF(*keep, "n_bytes", "n_tokens")


def op5_token_count(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    """Tokens of every document, and whether they are more than ``limit``."""
    counted = count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path("byte_bpe_50k.json"), ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


QUERIES = {"op5_token_count": op5_token_count}
#: SQL has no tokenizer; tests/llm compares with the tokenizer library.
ORACLE_SQL: dict[str, str] = {}
