"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often over the corpus.

Pass one encodes every text with both tokenizers, cuts it where tokens of both end, and counts the linked id
pairs of its task. The distinct pairs get a minimal perfect hash; the tasks' counts become dense vectors indexed
by it, which are summed in a tree. Pass two aligns the texts again and looks the pairs up, each checked against
the key stored at its index.

Two tokens that end together in one text are suffixes of one another, so the number of distinct pairs has a bound
from the vocabularies alone (``most_pairs``: for the two used here about half a million), whatever the corpus. Only
such pair tables reach the driver and the tasks.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkpoison.llm.bpe import ragged, vocabulary_path
from sparkpoison.llm.common import in_pieces, map_cells, map_texts, read, small_batches, text_bytes
from sparkpoison.llm.minimal_hash import MinimalHash
from sparkpoison.session import checkpoint

#: kept parts of a task, by number and characters; beyond it a task begins anew
CACHE_PARTS, CACHE_CHARS = 400_000, 16_000_000
#: entries of a dense vector's piece, and pieces summed at a time
PIECE, FAN_IN = 1 << 16, 8
#: a single space between other characters: neither tokenizer has a token across its left side
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: white space other than spaces and line ends
_RARE = re.compile(r"[^\S \n]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers and the bytes of their tokens.

    The byte-level one is a list of merges in the order of their ids, so its ids are ranks: the lowest-ranked pair whose
    bytes are a token is the next merge of the list. Pieces are merged by the rank library, which is several times faster.
    """

    def __init__(self, byte_level: str, pieces: bytes):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        told = json.loads(byte_level)
        ids, letters = told["model"]["vocab"], byte_alphabet()
        special = {t["content"] for t in told["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): number for token, number in ids.items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        made = np.array([ids["".join(m)] for m in merges], np.int64)
        plain = told["normalizer"] is None and told["pre_tokenizer"]["type"] == "ByteLevel" and told["pre_tokenizer"]["use_regex"]
        if not plain or told["pre_tokenizer"]["add_prefix_space"] or (np.diff(made) <= 0).any():
            raise ValueError("the byte-level tokenizer must take texts as they are and number its merges in order")
        self.encode_a = tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.a_bytes = [b""] * (max(ids.values()) + 1)
        for token, number in ranks.items():
            self.a_bytes[number] = token
        b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.encode_b = lambda texts: b.encode(texts, num_threads=1)
        names = list(map(b.id_to_piece, range(b.get_piece_size())))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("texts can be cut at spaces only if no piece goes on over a space")

    def most_pairs(self) -> int:
        """How many id pairs can end together at all: one token's bytes are the end of the other's."""
        a, b = Counter(filter(None, self.a_bytes)), Counter(filter(None, self.b_bytes))
        ends = lambda mine, other: sum(n * other[t[i:]] for t, n in mine.items() for i in range(1, len(t)))
        return ends(a, b) + ends(b, a) + sum(n * b[t] for t, n in a.items())


class Bytes:
    """Bytes of every token, to be gathered for many ids at once."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.all = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.all[ragged(self.start[ids], self.length[ids])]


def _cut(text: str) -> list[str]:
    """``_CUT.split``; where every space stands alone between other characters, as in most texts, by the faster plain split."""
    if not text:
        return []
    ends = text[0] == " " or text[-1] == " "
    if ends or "  " in text or " \n" in text or "\n " in text or _RARE.search(text):
        return _CUT.split(text)
    return text.split(" ")


def _per_part(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    added = np.concatenate([[0], np.cumsum(values)])
    return added[ends] - added[ends - counts]


class Numbers(dict):
    """Part -> its number; parts not met before get the next ones and are listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self.new.append(part)
        number = self[part] = len(self)
        return number


class Aligner:
    """Texts to aligned parts; a part is what stands between two cuts at single spaces, and is aligned once per task."""

    def __init__(self, vocabularies: Vocabularies, counts: "PairCounts | None" = None):
        self.v, self.counts = vocabularies, counts
        self.width = len(vocabularies.b_bytes)
        self.a, self.b = Bytes(vocabularies.a_bytes), Bytes(vocabularies.b_bytes)
        sizes = (len(vocabularies.a_bytes), self.width) if counts is not None else ()
        #: an id and the mark behind it, for both vocabularies
        self.written = [f"{i}{mark}" for n, last in zip(sizes, "|;") for mark in ("," + last) for i in range(n)]
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.chars = 0
        self.right, self.n_a, self.n_b = array("b"), array("q"), array("q")
        self.first, self.links = array("q", [0]), array("q")
        self.best, self.total = array("q"), array("q")
        self.groups: list[str] = []

    def _tokens_of(self, a: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of every part of a joined text, from the parts' bytes."""
        return np.diff(np.searchsorted(np.cumsum(self.a.length[a]), np.cumsum(size), side="right"), prepend=0)

    def _learn(self, parts: list[str]) -> None:
        """Align parts not met before, all at once.

        Those without white space at their ends go to the byte-level tokenizer as one text, joined at spaces where it would be cut.
        """
        known = len(self.number) - len(parts)
        whole = [(" " + p).encode() for p in parts]
        self.chars += sum(map(len, parts))
        encode, b_lists = self.v.encode_a, self.v.encode_b(parts)
        flat = lambda lists: np.fromiter(chain.from_iterable(lists), np.int64)
        count = lambda lists: np.fromiter(map(len, lists), np.int64, len(lists))
        b, n_b, size = flat(b_lists), count(b_lists), count(whole)
        plain = [p for p in parts if p == p.strip()]
        a = np.array(encode(" " + " ".join(plain)) if plain else [], np.int64)
        if len(plain) == len(parts):
            n_a = self._tokens_of(a, size)
        else:
            edged = np.array([p != p.strip() for p in parts])
            a_lists, n_a = [encode(" " + p) for p, alone in zip(parts, edged.tolist()) if alone], np.zeros(len(parts), np.int64)
            n_a[~edged], n_a[edged] = self._tokens_of(a, size[~edged]), count(a_lists)
            both, apart = np.zeros(int(n_a.sum()), np.int64), np.repeat(edged, n_a)
            both[~apart], both[apart] = a, flat(a_lists)
            a = both
        self.n_a.extend(n_a.tolist())
        self.n_b.extend(n_b.tolist())

        right = (_per_part(self.a.length[a], n_a) == size) & (_per_part(self.b.length[b], n_b) == size)
        text = np.frombuffer(b"".join(w for w, ok in zip(whole, right.tolist()) if ok), np.uint8)
        differ = (self.a.of(a[np.repeat(right, n_a)]) != text) | (self.b.of(b[np.repeat(right, n_b)]) != text)
        right[np.repeat(np.arange(len(parts)), np.where(right, size, 0))[differ]] = False
        self.right.extend(right.astype(np.int8).tolist())

        a, b, n_a, n_b, size = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)], n_a[right], n_b[right], size[right]
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        at = np.searchsorted(end_b, end_a)
        meet_a = np.flatnonzero(end_b[at] == end_a)
        meet_b = at[meet_a]
        links = a[meet_a] * self.width + b[meet_b]
        cuts = np.searchsorted(end_a[meet_a], np.cumsum(size), side="right")
        per_part = np.zeros(len(parts), np.int64)
        per_part[right] = np.diff(cuts, prepend=0)
        begin = len(self.links)
        self.links.extend(links.tolist())
        first = begin + np.cumsum(per_part)
        self.first.extend(first.tolist())
        if self.counts is None:
            return
        for out, values in zip((self.best, self.total), self.counts.of(links)):
            out.extend(_per_part(values, per_part).tolist())
        # groups in the order in which they are written: the a tokens of each, then its b tokens
        group_a, group_b = np.searchsorted(meet_a, np.arange(len(a))), np.searchsorted(meet_b, np.arange(len(b)))
        until_a, until_b = np.concatenate([[0], meet_a + 1]), np.concatenate([[0], meet_b + 1])
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[meet_a], last_b[meet_b] = 1, 1
        n = len(self.v.a_bytes)
        written = np.zeros(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + until_b[group_a]] = a + n * last_a
        written[np.arange(len(b)) + until_a[group_b + 1]] = 2 * n + b + self.width * last_b
        names = list(map(self.written.__getitem__, written.tolist()))
        ends = np.cumsum(np.where(right, np.array(self.n_a[known:]) + np.array(self.n_b[known:]), 0)).tolist()
        self.groups += ["".join(names[i:j]) for i, j in zip([0, *ends], ends)]

    def parts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of every part of all texts, parts per text, whether the text's tokens give its bytes)."""
        if len(self.number) > CACHE_PARTS or self.chars > CACHE_CHARS:
            self.forget()
        split: list[list[str]] = []
        for t in texts:
            try:
                split.append(_cut(t.decode()))
            except UnicodeDecodeError:
                split.append([])
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64)
        new, self.number.new = self.number.new, []
        if new:
            self._learn(new)
        per_text = np.array([len(ps) for ps in split], np.int64)
        wrong = np.concatenate([[0], np.cumsum(1 - np.array(self.right, np.int64)[numbers])])
        ends = np.cumsum(per_text)
        return numbers, per_text, (wrong[ends] == wrong[ends - per_text]) & (per_text > 0)


class PairCounts:
    """Corpus counts of linked pairs, indexed by a minimal perfect hash."""

    def __init__(self, hashed: MinimalHash, counts: np.ndarray, width: int):
        self.hashed, self.counts = hashed, counts
        b = hashed.keys % width
        highest = np.zeros(width, np.int64)
        np.maximum.at(highest, b, counts)
        self.is_best = (counts == highest[b]).astype(np.int64)

    def of(self, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(1 where the count is the highest of its second id, count) of every link; 0 for pairs never counted."""
        at = self.hashed.index(links)
        known = at >= 0
        best, counts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        best[known], counts[known] = self.is_best[at[known]], self.counts[at[known]]
        return best, counts


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(keys, return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, inverse.reshape(-1), counts)
    return keys, out


def partial_counts(rows: DataFrame, byte_level: str, pieces: bytes) -> DataFrame:
    """(pair, n) of every task: how often it linked a pair. No task holds more pairs than the vocabularies allow."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Vocabularies(byte_level, pieces))
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for piece in in_pieces(batch, "text"):
                numbers, per_text, right = aligner.parts(text_bytes(piece.column(0)))
                times = np.bincount(numbers[np.repeat(right, per_text)], minlength=1)
                used = np.flatnonzero(times)
                first = np.array(aligner.first, np.int64)
                sizes = first[used + 1] - first[used]
                held.append((np.array(aligner.links, np.int64)[ragged(first[used], sizes)], np.repeat(times[used], sizes)))
                if sum(len(k) for k, _ in held) > 1 << 20:
                    keys, counts = _added(*(np.concatenate(x) for x in zip((keys, counts), *held)))
                    held = []
        keys, counts = _added(*(np.concatenate(x) for x in zip((keys, counts), *held)))
        for at in range(0, len(keys), PIECE):
            yield pa.RecordBatch.from_pydict({"pair": pa.array(keys[at : at + PIECE]), "n": pa.array(counts[at : at + PIECE])})

    return rows.mapInArrow(run, "pair bigint, n bigint")


def _dense(partials: DataFrame, hashed: MinimalHash, tasks: int) -> DataFrame:
    """(piece, part, counts): the partial counts of each task as pieces of a dense vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(hashed.n, np.int64)
        for batch in batches:
            np.add.at(total, hashed.index(batch.column(0).to_numpy()), batch.column(1).to_numpy())
        for at in range(0, hashed.n, PIECE):
            yield pa.RecordBatch.from_pydict({
                "piece": pa.array([at // PIECE], pa.int32()), "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "counts": pa.array([total[at : at + PIECE].astype("<i8").tobytes()], pa.binary()),
            })

    return partials.coalesce(tasks).mapInArrow(run, "piece int, part int, counts binary")


def tree_sum(vectors: DataFrame, parts: int) -> DataFrame:
    """Add the vectors of each piece, ``FAN_IN`` at a time."""

    def solve(cell: pa.Table) -> pa.RecordBatch:
        total = sum(np.frombuffer(v.as_buffer(), "<i8") for v in cell.column("counts"))
        return pa.RecordBatch.from_pydict({
            "piece": cell.column("piece").slice(0, 1).combine_chunks(), "part": cell.column("part").slice(0, 1).combine_chunks(),
            "counts": pa.array([total.tobytes()], pa.binary()),
        })

    while parts > 1:
        vectors = vectors.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int"))
        vectors = map_cells(vectors, ["piece", "part"], "piece int, part int, counts binary", solve)
        parts = -(-parts // FAN_IN)
    return vectors


def pair_counts(rows: DataFrame, byte_level: str, pieces: bytes) -> PairCounts:
    """Counts of all linked pairs of a table with one column ``text``."""
    partials = checkpoint(partial_counts(rows, byte_level, pieces))
    size = partials.count()
    distinct = partials.select("pair").distinct().toArrow()  # at most ``most_pairs`` rows
    hashed = MinimalHash(distinct.column(0).to_numpy())
    # a dense vector is worth its length only for that many partial counts
    tasks = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // max(hashed.n, 1)))
    summed = tree_sum(_dense(partials, hashed, tasks), tasks)
    counts = np.zeros(hashed.n, np.int64)
    for row in summed.collect():  # one row per piece
        vector = np.frombuffer(row["counts"], "<i8")
        counts[row["piece"] * PIECE : row["piece"] * PIECE + len(vector)] += vector
    width = len(Vocabularies(byte_level, pieces).b_bytes)
    return PairCounts(hashed, counts, width)


def align(docs: DataFrame, byte_level_path: str, pieces_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and n_a, n_b, n_groups, n_links, n_best, count_sum (bigint) and ``groups`` of every row.

    Both tokenizers read a space and the text, without special tokens. ``groups`` lists the ids between places where
    tokens of both end, ``a1,a2|b1;a3|b2``; each group ends in one link, its last two ids, since no token is empty.
    ``n_best`` counts links whose corpus count is the highest of their second id (ties included), ``count_sum`` adds the
    counts. Null and empty texts, and texts that one tokenizer rewrites (its tokens' bytes differ), have no tokens: zeros
    and empty ``groups``; they count nowhere. Repeated rows count each. An empty table gives an empty result; other columns,
    whatever their names, are not read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    byte_level, pieces = Path(byte_level_path).read_text(encoding="utf-8"), Path(pieces_path).read_bytes()
    counts = pair_counts(docs.select(F.col(f"`{text}`").alias("text")), byte_level, pieces)
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = "".join(f"k{i} {kinds[c]}, " for i, c in enumerate(keep)) + "".join(f"{s} bigint, " for s in sums) + "groups string"

    def make():
        aligner = Aligner(Vocabularies(byte_level, pieces), counts)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            numbers, per_text, right = aligner.parts(text_bytes(batch.column(batch.schema.get_field_index("text"))))
            ends = np.cumsum(per_text)
            out = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"}
            links = np.diff(np.array(aligner.first, np.int64))
            for name, values in zip(sums, (aligner.n_a, aligner.n_b, links, links, aligner.best, aligner.total)):
                added = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[numbers])])
                out[name] = pa.array(np.where(right, added[ends] - added[ends - per_text], 0))
            groups, at = aligner.groups, numbers.tolist()
            out["groups"] = pa.array(
                ["".join([groups[i] for i in at[e - n : e]])[:-1] if ok else "" for e, n, ok in zip(ends.tolist(), per_text.tolist(), right.tolist())],
                pa.string(),
            )
            return pa.RecordBatch.from_pydict(out)

        return step

    out = map_texts(docs.select(*columns, F.col(f"`{text}`").alias("text")), "text", schema, make)
    return out.toDF(*keep, *sums, "groups")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of the byte-level and the piece vocabulary, with digests of its groups."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = align(docs, vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"), ["doc_id"])
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.withColumn("groups_sha256", digest).drop("groups")


QUERIES = {"op12_token_alignment": op12_token_alignment}
#: SQL has no tokenizer; tests/llm compares with both libraries on whole texts.
ORACLE_SQL: dict[str, str] = {}
