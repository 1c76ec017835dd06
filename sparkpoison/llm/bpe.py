"""Byte-level BPE: texts to token ids and back.

Pieces come from the prefix scan of ``pretokens``. Each distinct piece is merged once per
task and its ids are kept; the ids of a chunk of texts are then gathered from the kept ones
in one array operation. Byte offsets of the tokens stay with the ids, so any range of tokens
can be placed in its text, and decoding is one gather from the vocabulary's bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkpoison.llm.common import map_texts, read, text_bytes
from sparkpoison.llm.pretokens import Pretokenizer, class_table

#: kept pieces per task, by number and by their characters; beyond it a task begins anew
CACHE_PIECES, CACHE_CHARS = 1_000_000, 16_000_000
#: bytes from which merging keeps its pairs in a heap
_LONG = 48


def read_ranks(path: str) -> bytes:
    """The rank file's content, read where the query is planned: tasks need no file."""
    return Path(path).read_bytes()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank, leftmost first, is joined until none has a rank."""
    known = ranks.get(piece)
    if known is not None:
        return [known]
    if len(piece) >= _LONG:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks)
    scores = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while scores:
        best = min(scores)
        if best == none:
            break
        i = scores.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i:
            scores[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(scores):
            scores[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps: pairs wait in a heap by (rank, place), parts are a linked list."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins at a place; 0 once it is joined to the left
    left = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop or mid >= stop:
            continue  # one of the two parts has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            left[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        before = left[i]
        if before >= 0:
            r = ranks.get(piece[before:stop])
            if r is not None:
                heapq.heappush(heap, (r, before, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Vocabulary:
    """Bytes of every id, for decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.start[ids], self.length[ids])].tobytes()


class Encoder(dict):
    """Piece -> number of its kept ids; a miss merges the piece."""

    def __init__(self, ranks: dict[bytes, int], table: bytes):
        super().__init__()
        self.ranks, self.cutter, self.vocabulary = ranks, Pretokenizer(table), Vocabulary(ranks)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.first, self.chars = array("I"), array("q", [0]), 0

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self.first) - 1
        self.ids.extend(merge(piece.encode(), self.ranks))
        self.first.append(len(self.ids))
        self.chars += len(piece)
        return number

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of every text)."""
        if len(self) > CACHE_PIECES or self.chars > CACHE_CHARS:
            self.forget()
        whole, cuts, per_text = self.cutter.split(texts)
        at = cuts.tolist()
        numbers = np.fromiter((self[whole[a:b]] for a, b in zip(at, at[1:])), np.int64, len(at) - 1)
        first = np.array(self.first, np.int64)
        counts = np.diff(first)[numbers]
        ids = np.array(self.ids, np.uint32)[ragged(first[numbers], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])

    def offsets(self, ids: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """First byte of every token in its text."""
        ends = np.cumsum(self.vocabulary.length[ids])
        begins = ends - self.vocabulary.length[ids]
        heads = np.concatenate([[0], np.cumsum(per_text)])[:-1]
        return begins - np.repeat(begins[np.minimum(heads, max(len(ids) - 1, 0))] if len(ids) else heads, per_text)


Step = Callable[[pa.RecordBatch], pa.RecordBatch]


def encode_step(ranks: bytes, table: bytes, text: str) -> Step:
    """Replace a text column by ids and offsets."""
    encoder = Encoder(parse_ranks(ranks), table)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encoder.encode(text_bytes(batch.column(batch.schema.get_field_index(text))))
        heads = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        lists = {
            "ids": pa.ListArray.from_arrays(heads, pa.array(ids.astype(np.int32))),
            "offsets": pa.ListArray.from_arrays(heads, pa.array(encoder.offsets(ids, counts), pa.int64())),
        }
        kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != text}
        return pa.RecordBatch.from_pydict(kept | lists)

    return step


def decode_step(ranks: bytes) -> Step:
    """Add the bytes that a column ``ids`` stands for."""
    vocabulary = Vocabulary(parse_ranks(ranks))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(batch.schema.get_field_index("ids"))
        ids, heads = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))])
        ends = np.concatenate([[0], np.cumsum(vocabulary.length[ids])])[heads]
        if ends[-1] > 2**31 - 1:
            raise ValueError("a batch of ids decodes to more than 2 GiB; use smaller batches")
        decoded = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(vocabulary.decode(ids))])
        return pa.RecordBatch.from_pydict({n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {"decoded": decoded})

    return step


def _named(docs: DataFrame, keep: list[str]) -> tuple[list, str]:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "".join(f"k{i} {kinds[c]}, " for i, c in enumerate(keep))


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``ids`` array<int> and ``offsets`` array<bigint>, the first byte of every token.

    One row per row; a null or empty text has no ids. Texts are encoded whole, without special tokens.
    Other columns are not read. ``path`` is a rank file (base64 token and rank per line).
    """
    columns, schema = _named(docs, keep)
    ranks, table = read_ranks(path), class_table()
    out = map_texts(docs.select(*columns, F.col(text).alias("text")), "text", schema + "ids array<int>, offsets array<bigint>", lambda: encode_step(ranks, table, "text"))
    return out.toDF(*keep, "ids", "offsets")


def decode(encoded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``decoded`` binary of ``ids``; null ids decode to no bytes."""
    columns, schema = _named(encoded, keep)
    ranks = read_ranks(path)

    def run(batches):
        step = decode_step(ranks)
        for batch in batches:
            yield step(batch).drop_columns(["ids"])

    return encoded.select(*columns, F.col("ids")).mapInArrow(run, schema + "decoded binary").toDF(*keep, "decoded")


def round_trip(docs: DataFrame, path: str, keep: list[str], text: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: ``keep``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and ``ids``, ``offsets``).

    Ids are hashed as little-endian unsigned 32-bit integers. Nulls, empty texts and other columns as in ``encode``.
    """
    columns, schema = _named(docs, keep)
    ranks, table = read_ranks(path), class_table()
    digests = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    lists = ", ids array<int>, offsets array<bigint>" if ids else ""

    def make() -> Step:
        there, back = encode_step(ranks, table, "text"), decode_step(ranks)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = back(there(batch))
            get = lambda n: out.column(out.schema.get_field_index(n))
            flat = get("ids").flatten().to_numpy().astype("<u4").tobytes()
            ends = get("ids").offsets.to_numpy()
            ends = (ends - ends[0]) * 4
            columns = {f"k{i}": get(f"k{i}") for i in range(len(keep))} | {
                "n_tokens": pa.array(np.diff(ends) // 4, pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d.as_buffer()).hexdigest() for d in get("decoded")], pa.string()),
            }
            return pa.RecordBatch.from_pydict(columns | ({"ids": get("ids"), "offsets": get("offsets")} if ids else {}))

        return step

    out = map_texts(docs.select(*columns, F.col(text).alias("text")), "text", schema + digests + lists, make)
    return out.toDF(*keep, *(["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "offsets"] if ids else [])))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to ids and back; counts and digests of both."""
    return round_trip(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path("byte_bpe_50k.tiktoken"), ["doc_id"])


QUERIES = {"op4_bpe": op4_bpe}
#: SQL has no tokenizer; tests/llm compares with the tokenizer library.
ORACLE_SQL: dict[str, str] = {}
