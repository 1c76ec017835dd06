"""N-gram Jaccard self-join through parity sketches.

If two sets of sizes a and b have a Jaccard similarity of at least p per cent, they differ
in at most (a + b)(100 - p) / (100 + p) elements. XOR the hashes of a set's elements part by
part, the parts dealt by hash: an element that only one set has changes one part of the
sketch, so the number of unequal parts is at most the number of differing elements. With one
part more than elements may differ, some part is equal (pigeonhole): parts are join keys.

* Sizes are cut into bands so wide that linkable sizes lie in one band or in neighbours; a
  set is keyed for its own band and, if it can link upwards, for the next.
* An empty part is no evidence and would be a hot key. Spare parts make some equal part
  non-empty for any set with at most as many empty parts; a set with more of them is keyed
  once more, by a second dealing, under each of its empty parts. So no pair is lost.
* Pairs that meet are filtered by a parity sketch of about four bits per element, whose Hamming
  distance is a lower bound of the difference too, and verified on the sets. A longer sketch
  is folded (its halves XORed) to compare with a shorter one.
* Equal sets are one node from the start. Inside a key, members meet the key's smallest
  member first; only members of different components found so are then compared with each
  other, in blocks, by their sketches. Of the pairs that may link, a block passes on a minimum
  spanning forest over the components, the most alike first: fewer rows than it has members.
  Where all its edges are verified, its members are joined as all pairs would have joined
  them. Keys of exactly the same members are compared once.
* Links and forest edges, those that failed too, connect every pair that may link, so they
  cut the sets into families. In a family that is still apart, whole sketches are compared
  once a pair, whatever number of keys it shares; members that may link to another component
  are then compared on the sets themselves. Members and spanning forests leave the blocks,
  never pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkpoison.llm.common import map_cells, map_texts, read, text_bytes
from sparkpoison.llm.words import Words, mix, white_space_words
from sparkpoison.operators.clustering import connected_components
from sparkpoison.session import broadcast_if_small, checkpoint

#: members of a key that one block of the second comparison holds
BLOCK = 2048
#: bytes of sketches or sets that one block of a family holds, unless one member has more
BLOCK_BYTES = 16 << 20
#: 64-bit words of a sketch in the second comparison: four bits per element up to 512 elements, longer sketches are folded
WORDS = 32
_R = np.uint64(0x9FB21C651E98DF25)


@lru_cache(maxsize=None)
def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first size of every band, parts, spare parts) up to the band after the one of ``largest``."""
    first, parts, spare = [1], [], []
    while first[-1] <= largest or len(parts) < 2 or first[-2] <= largest:
        top = first[-1] * 100 // percent  # the last size of this band
        differ = 2 * top * (100 - percent) // (100 + percent)
        e = _spare(differ, max(1, first[-1] * percent // 100))
        parts.append(differ + 1 + e)
        spare.append(e)
        first.append(top + 1)
    return np.array(first[:-1]), np.array(parts), np.array(spare)


def _spare(differ: int, size: int) -> int:
    """Spare parts for the smallest sets of a band, which have the most empty parts.

    Few parts: what costs least. Many: the mean number of empty ones and five deviations, so that a second
    dealing, whose keys are parts times empty parts, is needed for next to no set.
    """
    if differ < 100:
        return min(range(40), key=lambda e: _cost(differ + 1 + e, e, size))
    e, before = 0, -1
    while e != before and e <= differ:  # below about 75 per cent there is no such number
        before, mean = e, (differ + 1 + e) * math.exp(-size / (differ + 1 + e))
        e = max(e, math.ceil(mean + 5 * math.sqrt(mean) + 1))
    return e


def _cost(parts: int, spare: int, size: int) -> float:
    """Expected keys of a set: its parts, and a second dealing for each empty part if more than the spare ones are empty."""
    mean = parts * math.exp(-size / parts)
    term, weighted = math.exp(-mean), 0.0
    for j in range(spare + 1):
        weighted += j * term
        term *= mean / (j + 1)
    return parts * (1 + max(mean - weighted, 0.0))


class Sets:
    """The distinct shingles of a chunk of texts: ``hash`` sorted within ``owner``, ``size`` per text."""

    def __init__(self, texts: list[bytes], n: int):
        w = Words(texts, white_space_words())
        h, self.texts = w.hashes(), len(texts)
        count = np.diff(w.first)
        with np.errstate(over="ignore"):
            runs = np.zeros(max(len(h) - n + 1, 0), np.uint64)
            for k in range(n):
                runs = runs * _R + h[k : len(h) - n + 1 + k] if len(runs) else runs
            at = np.flatnonzero(w.owner[: len(runs)] == w.owner[n - 1 :]) if len(runs) else np.zeros(0, np.int64)
            short = np.flatnonzero((count > 0) & (count < n))
            whole = np.zeros(len(short), np.uint64)
            for i, t in enumerate(short):
                value = np.uint64(count[t])  # fewer words than n are one shingle
                for x in h[w.first[t] : w.first[t + 1]]:
                    value = value * _R + x
                whole[i] = value
        owner = np.concatenate([w.owner[at], short]).astype(np.uint16 if len(texts) < 65536 else np.int64)
        value = mix(np.concatenate([runs[at], whole]))
        order = np.argsort(value)
        order = order[np.argsort(owner[order], kind="stable")]
        owner, value = owner[order], value[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        self.owner, self.hash = owner[new].astype(np.int64), value[new]
        self.size = np.bincount(self.owner, minlength=self.texts)[: self.texts]
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def sums(self, salt: int) -> np.ndarray:
        """A 64-bit fingerprint of every set."""
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hash ^ np.uint64(salt)), dtype=np.uint64)])
            return total[self.first[1:]] - total[self.first[:-1]]

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of every set."""
        return self.sums(0x8EBC6AF09C88C6E3), self.sums(0x589965CC75374CC3)

    def lists(self) -> pa.ListArray:
        """Every set as sorted 64-bit hashes."""
        return pa.ListArray.from_arrays(pa.array(self.first, pa.int32()), _signed(self.hash))

    def sketch(self) -> pa.ListArray:
        """Parity bits of every set, a power of two of at least 256 and four per element, as 64-bit numbers."""
        words = 4 << np.ceil(np.log2(np.maximum(self.size / 64, 1))).astype(np.int64)
        heads = np.concatenate([[0], np.cumsum(words)])
        place = (self.hash >> np.uint64(7)) & (words[self.owner].astype(np.uint64) * np.uint64(64) - np.uint64(1))
        bits = np.bincount(heads[self.owner] * 64 + place.astype(np.int64), minlength=heads[-1] * 64) & 1
        return pa.ListArray.from_arrays(pa.array(heads, pa.int32()), pa.array(np.packbits(bits.astype(np.uint8)).view("<i8")))

    def keys(self, percent: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, key) of the wanted sets in both of their bands."""
        first, parts, spare = bands(percent, int(2 ** math.ceil(math.log2(max(self.size.max(initial=1), 2)))))
        own = np.searchsorted(first, self.size, side="right") - 1
        found = []
        for step in (0, 1):
            band = own + step
            use = wanted & (self.size > 0)
            if step:
                use &= self.size * 100 // percent >= first[np.minimum(band, len(first) - 1)]
            found.append(self._keys_at(np.where(use, band, -1), parts, spare))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _keys_at(self, band: np.ndarray, parts: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner, key, at, empty = self._deal(band, parts, 0, np.flatnonzero(band >= 0))
        tag = mix(_pack(band[owner], at))
        out_owner, out_key = [owner], [mix(key ^ tag)]
        # Sets with too many empty parts: a second dealing under each of them.
        texts, places = empty
        over = np.bincount(texts, minlength=self.texts)[: self.texts] > spare[np.maximum(band, 0)]
        for t in np.flatnonzero(over):
            o, k, a, (_, still) = self._deal(band, parts, 1, np.array([t]))
            part_keys = np.concatenate([mix(k ^ _pack(np.full(len(a), 1), a)), mix(_pack(np.full(len(still), 2), still))])
            for p in places[texts == t]:
                key = mix(part_keys ^ mix(_pack(np.array([band[t] + 1000]), np.array([p]))))
                out_owner.append(np.full(len(key), t))
                out_key.append(key)
        return np.concatenate(out_owner), np.concatenate(out_key)

    def _deal(self, band: np.ndarray, parts: np.ndarray, dealing: int, texts: np.ndarray):
        """XOR of every non-empty part of the given sets: (text, xor, part, (text, part) of the empty ones)."""
        n_parts = np.zeros(self.texts, np.int64)
        n_parts[texts] = parts[band[texts]]
        base = np.concatenate([[0], np.cumsum(n_parts)])
        if len(texts) == 1:
            rows = slice(self.first[texts[0]], self.first[texts[0] + 1])
        else:
            rows = np.flatnonzero(n_parts[self.owner] > 0)
        owner, h = self.owner[rows], self.hash[rows]
        if dealing:
            h = mix(h ^ np.uint64(0xA0761D6478BD642F))
        slot = base[owner] + ((h >> np.uint64(33)).astype(np.int64) % n_parts[owner])
        order = np.argsort(slot)
        slot, h = slot[order], mix(h[order] ^ np.uint64(0xE7037ED1A0B428DB))
        start = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        xor = np.bitwise_xor.reduceat(h, start) if len(start) else np.zeros(0, np.uint64)
        used = slot[start]
        none = np.ones(base[-1], bool)
        none[used] = False
        none = np.flatnonzero(none)
        of = lambda s: np.searchsorted(base, s, side="right") - 1
        text, no_text = of(used), of(none)
        return text, xor, used - base[text], (no_text, none - base[no_text])


def _pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(40)) | b.astype(np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sketched(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, s, b): size, fingerprint, parity sketch and, where it is longer than WORDS, its folded form."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = Sets(text_bytes(batch.column(1)), n)
            sketch = sets.sketch()
            long = sketch.value_lengths().to_numpy() > WORDS
            folded = np.ascontiguousarray(_folded(sketch.take(pa.array(np.flatnonzero(long))), WORDS).T).view(np.int64).ravel()
            heads = pa.array(np.concatenate([[0], np.cumsum(long * WORDS)]), pa.int32(), mask=np.append(~long, False))
            brief = pa.ListArray.from_arrays(heads, pa.array(folded))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets.size, pa.int64()), *map(_signed, sets.fingerprints()), sketch, brief],
                ["doc_id", "n_shingles", "f1", "f2", "s", "b"],
            )

        return step

    return map_texts(docs, "text", f"doc_id {kind}, n_shingles long, f1 long, f2 long, s array<long>, b array<long>", make)


def _keyed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(f1, key) of every set; a set that the task has just seen gives none."""

    def make():
        seen: set[tuple[int, int]] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = Sets(text_bytes(batch.column(0)), n)
            f1, f2 = sets.fingerprints()
            if len(seen) > 1_000_000:
                seen.clear()
            wanted = np.zeros(sets.texts, bool)
            for i, f in enumerate(zip(f1.tolist(), f2.tolist())):
                if f not in seen:
                    seen.add(f)
                    wanted[i] = True
            owner, key = sets.keys(percent, wanted)
            return pa.RecordBatch.from_arrays([_signed(f1[owner]), _signed(key)], ["f1", "key"])

        return step

    return map_texts(docs.where("doc_id IS NOT NULL").select("text"), "text", "f1 long, key long", make)


def _sets(docs: DataFrame, wanted: DataFrame, n: int, once: bool) -> DataFrame:
    """(f1, f2, hashes) of the wanted sets, each once; ``wanted(f1, f2, rep)``; ``once``: no row repeats."""
    # Texts stay where they are as long as the wanted ids are small enough to go to them.
    ids = broadcast_if_small(wanted.select(F.col("rep").alias("doc_id")).distinct())
    rows = docs.join(ids, "doc_id", "left_semi")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = Sets(text_bytes(batch.column(0)), n)
            return pa.RecordBatch.from_arrays([*map(_signed, sets.fingerprints()), sets.lists()], ["f1", "f2", "hashes"])

        return step

    made = map_texts(rows.select("text"), "text", "f1 long, f2 long, hashes array<long>", make)
    made = made.join(broadcast_if_small(wanted.select("f1", "f2")), ["f1", "f2"], "left_semi")
    return made if once else made.dropDuplicates(["f1", "f2"])


def _may_link(percent: int, a: str, b: str) -> Column:
    """Sizes fit, and the sketches differ in no more bits than the sets may in elements."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    p, q = F.col(f"{a}.s"), F.col(f"{b}.s")
    size = F.least(F.size(p), F.size(q))
    halves = lambda s: F.zip_with(F.slice(s, F.lit(1), size), F.slice(s, size + 1, size), lambda u, v: u.bitwiseXOR(v))
    folded = lambda s: F.when(F.size(s) > size, halves(s)).otherwise(s)
    unequal = F.zip_with(folded(p), folded(q), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    distance = F.aggregate(unequal, F.lit(0), lambda total, n: total + n)
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & (distance * (100 + percent) <= (x + y) * (100 - percent))


def _verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int, once: bool) -> DataFrame:
    """(u, v) ids of the pairs of structs ``a`` and ``b`` that link."""
    node = lambda s: F.struct(*[F.col(f"{s}.{c}").alias(c) for c in ("f1", "f2", "rep")])
    wanted = checkpoint(pairs.select(F.explode(F.array(node("a"), node("b"))).alias("x")).select("x.*").distinct())
    sets = checkpoint(_sets(docs, wanted, n, once))
    left, right = (sets.select(F.col("f1").alias(f"{s}1"), F.col("f2").alias(f"{s}2"), F.col("hashes").alias(f"{s}h")) for s in "ab")
    both = pairs.select(
        F.col("a.f1").alias("a1"), F.col("a.f2").alias("a2"), F.col("a.rep").alias("u"),
        F.col("b.f1").alias("b1"), F.col("b.f2").alias("b2"), F.col("b.rep").alias("v"),
    ).join(left, ["a1", "a2"]).join(right, ["b1", "b2"])
    common = both.select("u", "v", F.size(F.array_intersect("ah", "bh")).alias("i"), (F.size("ah") + F.size("bh")).alias("t"))
    return common.where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * percent).select("u", "v").distinct()


def _members(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, f1, low) of the keys that several sets have, with the smallest of them.

    The keys' shuffle, the largest of the join, can be cleaned as soon as this has returned.
    """
    group = Window.partitionBy("key")
    keyed = _keyed(docs, n, percent).withColumns({"low": F.min("f1").over(group), "high": F.max("f1").over(group)})
    return checkpoint(keyed.where("low < high").select("key", "f1", "low").distinct())


def _met(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of every key's smallest member and its others, as far as the sketches allow.

    Sets of one 64-bit fingerprint and different second ones meet here too.
    """
    node = lambda s: nodes.select(F.col("f1").alias(f"{s}1"), F.struct("f1", "f2", "rep", "n", "s").alias(s))
    met = members.where("f1 <> low").select(F.col("low").alias("a1"), F.col("f1").alias("b1")).distinct()
    met = met.join(node("a"), "a1").join(node("b"), "b1").where(_may_link(percent, "a", "b"))
    return checkpoint(met.select("a", "b"))


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Sets are the distinct ``n``-word shingles of the whole lower-cased (A-Z) text; fewer words are one shingle, no
    words or a null text the empty set, which links with nothing. ``component_id`` is the smallest id reachable by
    links of 100 * intersection >= percent * union; meant for 75 per cent and more, as sketches have too many empty
    parts below. Repeated rows repeat; an id with several texts is one document with the links of all; a row without
    id links with nothing and has no component. Other columns are not read.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = checkpoint(_sketched(docs, n))
    has = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    nodes = checkpoint(
        parts.where(has).groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("s").alias("s"), F.first("b").alias("b"))
    )
    members = _members(docs, n, percent)
    # Only rows that repeat an id and its text would give a set twice.
    once = parts.where(has).groupBy("doc_id", "f1", "f2").count().where("count > 1").isEmpty()

    links = checkpoint(_verified(docs, _met(members, nodes, percent), n, percent, once))
    forest = _across(_apart(members, _named(nodes, links)), percent)
    more = links.union(checkpoint(_verified(docs, _both(forest, nodes, percent), n, percent, once)))
    families = _open_families(nodes, more, forest)
    wanted = _open_members(families, percent)
    if not wanted.isEmpty():
        more = more.union(_within(families.join(wanted.drop("rep"), ["key", "f1", "f2"]), _sets(docs, wanted, n, once), percent))
    parts_of = connected_components(more.union(_same_id(parts.where(has), nodes)))
    labels = nodes.join(parts_of.withColumnRenamed("node", "rep"), "rep", "left")
    labels = labels.where("copies > 1 OR component IS NOT NULL").select("f1", "f2", F.coalesce("component", "rep").alias("_c"))
    out = parts.select("doc_id", "n_shingles", "f1", "f2").join(labels, ["f1", "f2"], "left")
    component = F.when(has, F.coalesce("_c", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def _same_id(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): the nodes of ids with several different texts, each with the smallest one of its id."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("f1", "f2") for f in (F.min, F.max)]
    several = checkpoint(parts.groupBy("doc_id").agg(*ends).where("min_f1 < max_f1 OR min_f2 < max_f2").select("doc_id"))
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v"))
    own = parts.select("doc_id", "f1", "f2").join(broadcast_if_small(several), "doc_id").distinct()
    own = checkpoint(own.join(nodes.select("f1", "f2", "rep"), ["f1", "f2"]).select("doc_id", "rep").distinct())
    first = own.groupBy("doc_id").agg(F.min("rep").alias("u"))
    return own.join(first, "doc_id").where("u <> rep").select("u", F.col("rep").alias("v")).distinct()


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(f1, f2, rep, n, b, c) of every node: its component's number and its sketch of at most WORDS words."""
    found = connected_components(links).withColumnRenamed("node", "rep")
    number = F.xxhash64(F.coalesce("component", "rep"))  # any id type; equal components have equal numbers
    return checkpoint(nodes.join(found, "rep", "left").select("f1", "f2", "rep", "n", F.coalesce("b", "s").alias("b"), number.alias("c")))


def _apart(members: DataFrame, named: DataFrame) -> DataFrame:
    """Blocks (key, i, j, at, f1, f2, rep, n, b, c) of the keys whose members lie in different components.

    A key of more than BLOCK members is a grid of g x g blocks. Of keys with the same members one is enough.
    """
    placed = members.select("key", "f1").join(named.select("f1", "f2", "c"), "f1")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "f1", "f2")).alias(f"x{k}") for k in (1, 2)]
    keys = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), *marks).where("lo < hi")
    keys = keys.groupBy("size", "x1", "x2").agg(F.min("key").alias("key"))
    keys = checkpoint(keys.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("g")))
    cells = checkpoint(members.select("key", "f1").join(keys, "key")).join(named, "f1")
    return _grid(cells).select("key", "i", "j", "at", "f1", "f2", "rep", "n", "b", "c")


def _grid(cells: DataFrame) -> DataFrame:
    """Each row of a group of ``g`` blocks, once for every cell (i, j) that its block ``at`` belongs to."""
    cells = cells.withColumn("at", F.pmod(F.xxhash64("f1", "f2"), F.col("g")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return cells.withColumns({"i": F.least("at", "other"), "j": F.greatest("at", "other")})


def _across(cells: DataFrame, percent: int) -> DataFrame:
    """(a1, a2, u, b1, b2, v): a minimum spanning forest, over the components, of a block's pairs that may link.

    Its rows are fewer than the block's members.
    """
    kind = cells.schema["rep"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("f1", "ascending"), ("f2", "ascending")]))
        size, block = table["n"].to_numpy(), table["at"].to_numpy()
        part = np.unique(table["c"].to_numpy(), return_inverse=True)[1]
        i, j, weight = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for more in _near(size, block, part, table["b"].combine_chunks(), percent):
            i, j, weight = (np.concatenate(x) for x in zip((i, j, weight), more))
            kept = _spanning(part, i, j, weight)
            i, j, weight = i[kept], j[kept], weight[kept]
        columns = [table[name].combine_chunks().take(pa.array(end)) for end in (i, j) for name in ("f1", "f2", "rep")]
        return pa.RecordBatch.from_arrays(columns, ["a1", "a2", "u", "b1", "b2", "v"])

    schema = f"a1 long, a2 long, u {kind}, b1 long, b2 long, v {kind}"
    return checkpoint(map_cells(cells, ["key", "i", "j"], schema, solve))


def _open_families(nodes: DataFrame, links: DataFrame, forest: DataFrame) -> DataFrame:
    """(key, f1, f2, rep, n, s, c): members of families, numbered by ``key``, that still have several components ``c``."""
    number = F.xxhash64("component")
    family = connected_components(links.union(forest.select("u", "v")).distinct()).select(F.col("node").alias("rep"), number.alias("key"))
    part = connected_components(links).select(F.col("node").alias("rep"), number.alias("c"))
    placed = checkpoint(family.join(part, "rep", "left").select("rep", "key", F.coalesce("c", F.xxhash64("rep")).alias("c")))
    several = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    placed = placed.join(broadcast_if_small(several), "key")  # a family may hold most rows
    return checkpoint(placed.join(nodes.select("f1", "f2", "rep", "n", "s"), "rep").select("key", "f1", "f2", "rep", "n", "s", "c"))


def _family_cells(rows: DataFrame, size: Column) -> DataFrame:
    """``rows`` of families as cells of blocks with BLOCK members and BLOCK_BYTES of ``size`` on average."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(size) / BLOCK_BYTES)).cast("int")
    return _grid(rows.join(broadcast_if_small(rows.groupBy("key").agg(blocks.alias("g"))), "key"))


def _open_members(families: DataFrame, percent: int) -> DataFrame:
    """(key, f1, f2, rep) of the members that may, by their whole sketches, link to another component of their family."""
    kind = families.schema["rep"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.RecordBatch:
        found = np.zeros(len(table), bool)
        part = np.unique(table["c"].to_numpy(), return_inverse=True)[1]
        for i, j in _alike(table["n"].to_numpy(), table["at"].to_numpy(), part, table["s"].combine_chunks(), percent):
            found[i] = found[j] = True
        rows = table.select(["key", "f1", "f2", "rep"]).filter(pa.array(found)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in rows.columns], rows.column_names)

    cells = _family_cells(families, F.size("s") * 8).select("key", "i", "j", "at", "f1", "f2", "rep", "n", "s", "c")
    return checkpoint(map_cells(cells, ["key", "i", "j"], f"key long, f1 long, f2 long, rep {kind}", solve).distinct())


def _within(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between components of a family, as a spanning forest of each block, decided on the sets."""
    kind = members.schema["rep"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("f1", "ascending"), ("f2", "ascending")]))
        part = np.unique(table["c"].to_numpy(), return_inverse=True)[1]
        held = _Held(table["hashes"].combine_chunks())
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, j in _alike(table["n"].to_numpy(), table["at"].to_numpy(), part, table["s"].combine_chunks(), percent):
            ok = held.link(i, j, percent)
            i, j = i[ok], j[ok]
            kept = _spanning(part, i, j, np.zeros(len(i)))
            found.append((i[kept], j[kept]))
            part[:] = _joined(int(part.max()) + 1, part[i[kept]], part[j[kept]])[part]  # no more pairs of these
        rep = table["rep"].combine_chunks()
        return pa.RecordBatch.from_arrays([rep.take(pa.array(np.concatenate(x))) for x in zip(*found)], ["u", "v"])

    cells = _family_cells(members, F.col("n") * 8 + F.size("s") * 8).join(sets, ["f1", "f2"])
    cells = cells.select("key", "i", "j", "at", "f1", "f2", "rep", "n", "s", "c", "hashes")
    return checkpoint(map_cells(cells, ["key", "i", "j"], f"u {kind}, v {kind}", solve).distinct())


class _Held:
    """Sets of a block, their elements numbered."""

    def __init__(self, sets: pa.ListArray):
        self.size, self.first = sets.value_lengths().to_numpy().astype(np.int64), sets.offsets.to_numpy() - sets.offsets[0].as_py()
        self.ids = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
        self.marked = np.zeros(int(self.ids.max(initial=0)) + 1, bool)

    def link(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether the sets i and j link; quick where pairs of one i stand together."""
        out = np.zeros(len(i), bool)
        cuts = np.flatnonzero(np.diff(i, prepend=-1, append=-1)) if len(i) else []
        for lo, hi in zip(cuts, cuts[1:]):
            own = self.ids[self.first[i[lo]] : self.first[i[lo] + 1]]
            self.marked[own] = True
            for b in range(lo, hi, 256):
                other = j[b : min(b + 256, hi)]
                size = self.size[other]
                heads = np.cumsum(size) - size
                at = np.repeat(self.first[other] - heads, size) + np.arange(size.sum())
                both = np.add.reduceat(self.marked[self.ids[at]], heads, dtype=np.int64)
                out[b : b + len(other)] = both * 100 >= (len(own) + size - both) * percent
            self.marked[own] = False
        return out


def _alike(size: np.ndarray, block: np.ndarray, part: np.ndarray, sketches: pa.ListArray, percent: int):
    """Arrays (i, j), in the order of i, of pairs of different parts, and blocks if there are two, that may link by whole sketches.

    ``part`` may be joined further by the caller between two steps. Lengths of sketches differ as sizes do, so a class of
    lengths meets itself and the next ones. Unequal bits of a part of the words already bound the difference.
    """
    words = sketches.value_lengths().to_numpy().astype(np.int64)
    cross = block.min() < block.max()
    reach = math.ceil(math.log2(100 / percent))
    for w in np.unique(words):
        near = np.flatnonzero((words >= w) & (words <= w << reach))
        bits = _folded(sketches.take(pa.array(near)), int(w))
        left = np.flatnonzero(words[near] == w)
        step = max(1, 1_000_000 // len(near))
        for lo in range(0, len(left), step):
            rows = left[lo : lo + step]
            x, y = near[rows][:, None], near[None, :]
            ok = (part[x] != part[y]) & (np.minimum(size[x], size[y]) * 100 >= np.maximum(size[x], size[y]) * percent)
            ok &= (words[y] > w) | (x < y)
            if cross:
                ok &= block[x] != block[y]
            done = max(4, int(w) // 8)
            apart = np.zeros(ok.shape, np.int32)
            for v in bits[:done]:
                apart += np.bitwise_count(v[rows, None] ^ v[None, :])
            i, j = np.nonzero(ok & (apart * (100 + percent) <= (size[x] + size[y]) * (100 - percent)))
            apart, i = apart[i, j].astype(np.int64), rows[i]
            while done < w and len(i):
                for v in bits[done : 2 * done]:
                    apart += np.bitwise_count(v[i] ^ v[j])
                ok = apart * (100 + percent) <= (size[near[i]] + size[near[j]]) * (100 - percent)
                i, j, apart, done = i[ok], j[ok], apart[ok], 2 * done
            yield near[i], near[j]


def _near(size: np.ndarray, block: np.ndarray, part: np.ndarray, sketches: pa.ListArray, percent: int):
    """Arrays (i, j, share of unequal bits) of pairs i < j of different parts, and blocks if there are two, that may link."""
    words = int(sketches.value_lengths().to_numpy().min())
    bits = _folded(sketches, words)
    # A bit per element tells most pairs apart; the others are looked at in full.
    coarse = min(words, max(4, 1 << max(0, int(size.max() - 1) >> 6).bit_length()))
    brief = np.bitwise_xor.reduce(bits.reshape(-1, coarse, len(size)), axis=0)
    cross = block.min() < block.max()
    left, right = (np.flatnonzero(block == f(block)) for f in (np.min, np.max))
    step = max(1, 1_000_000 // len(right))
    for lo in range(0, len(left), step):
        rows, columns = left[lo : lo + step], right if cross else right[lo:]
        a, b = size[rows, None], size[None, columns]
        ok = (part[rows, None] != part[None, columns]) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent)
        apart = np.zeros(ok.shape, np.int32)
        for x in brief:
            apart += np.bitwise_count(x[rows, None] ^ x[None, columns])
        i, j = np.nonzero(ok & (apart * (100 + percent) <= (a + b) * (100 - percent)))
        i, j = rows[i], columns[j]
        if not cross:
            i, j = i[i < j], j[i < j]
        apart, total = np.zeros(len(i), np.int64), size[i] + size[j]
        for x in bits:
            apart += np.bitwise_count(x[i] ^ x[j])
        ok = apart * (100 + percent) <= total * (100 - percent)
        yield i[ok], j[ok], apart[ok] / total[ok]


def _spanning(part: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the edges (i, j) of a minimum spanning forest over the parts; ties go to the smaller ends."""
    order = np.lexsort((j, i, weight))
    a, b, alive = part[i[order]], part[j[order]], np.arange(len(order))
    chosen = np.zeros(len(order), bool)
    while len(alive):
        best = np.full(int(part.max()) + 1, len(order))  # the lightest edge that leaves each part
        np.minimum.at(best, a, alive)
        np.minimum.at(best, b, alive)
        picked = np.unique(best[best < len(order)])
        chosen[picked] = True
        at = np.searchsorted(alive, picked)
        root = _joined(len(best), a[at], b[at])
        a, b = root[a], root[b]
        a, b, alive = a[a != b], b[a != b], alive[a != b]
    return order[chosen]


def _joined(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest of the numbers below ``n`` that each one reaches by the edges (x, y)."""
    root = np.arange(n)
    while (root[x] != root[y]).any():
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root


def _both(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the different ones of the pairs, as far as the whole sketches allow them."""
    pairs = pairs.select("a1", "a2", "b1", "b2").distinct()
    for side in ("a", "b"):
        node = nodes.select(F.col("f1").alias(f"{side}1"), F.col("f2").alias(f"{side}2"), F.struct("f1", "f2", "rep", "n", "s").alias(side))
        pairs = pairs.join(node, [f"{side}1", f"{side}2"])
    return checkpoint(pairs.where(_may_link(percent, "a", "b")).select("a", "b"))


def _folded(column: pa.ListArray, words: int) -> np.ndarray:
    """[word, set] of sketches folded to a smaller power of two of words."""
    flat, heads = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()
    sizes = np.diff(heads)
    out = np.zeros((words, len(sizes)), np.uint64)
    for start in range(0, int(sizes.max(initial=0)), words):
        rows = np.flatnonzero(sizes > start)
        out[:, rows] ^= flat[heads[rows][None, :] + start + np.arange(words)[:, None]]
    return out


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` with one document, the one of smallest id, of each component; same columns.

    Rows without id stay. Of rows that repeat an id one stays, whichever its text.
    """
    found = checkpoint(near_duplicates(docs, n, percent))
    gone = checkpoint(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(broadcast_if_small(gone), "doc_id", "left_anti")
    again = checkpoint(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not again.isEmpty():
        again = broadcast_if_small(again)
        first = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(first)
    return kept.select(*docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a Jaccard similarity of at least 0.85."""
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
#: Components are not SQL at this size; tests/llm compares with all pairs in plain Python.
ORACLE_SQL: dict[str, str] = {}
