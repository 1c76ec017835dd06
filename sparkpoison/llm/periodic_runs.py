"""Periodic runs of words: maximal stretches in which a sequence of words repeats at least twice in a row.

Recursive frequency splitting comes first: a word of a run occurs at least twice in it, so a word that
occurs only once in its segment splits the segment, pieces too short for a run go, and the words of what
is left are counted again, until no segment changes. Only surviving segments are scanned. The scan does not
try every lag: a run of period q holds a Lyndon word of length q, the longest one at its place, under one of
the two orders of the words, so each word proposes at most two lags and those are all that a run can have.
How far a lag's equality reaches to either side is read from the names of all stretches of 1, 2, 4, ... words.
This takes n log n steps for the worst text, where trying all lags takes n squared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkpoison.llm.common import map_texts, read, text_bytes

#: white space that parts words, as a regular expression class and as bytes.split() has it
_GAP = r"[\x20\x09-\x0D]+"
#: rounds of splitting; it only prunes, so a text that needs more is scanned with what is left
_ROUNDS = 64


def dense(key: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, ... in the order of the keys, equal keys alike."""
    return np.unique(key, return_inverse=True)[1].reshape(-1)


def split_by_frequency(code: np.ndarray, segment: np.ndarray, shortest: int) -> np.ndarray:
    """Places, ascending, of the words that can lie in a run of ``shortest`` words."""
    place, kinds = np.arange(len(code)), int(code.max(initial=0)) + 1
    settled: list[np.ndarray] = []
    for _ in range(_ROUNDS):
        if not len(place):
            break
        _, inverse, count = np.unique(segment * kinds + code[place], return_inverse=True, return_counts=True)
        rare = count[inverse.reshape(-1)] < 2
        heads = np.flatnonzero(np.diff(segment, prepend=segment[0] - 1))
        size = np.diff(np.append(heads, len(place)))
        keep_all = ~np.logical_or.reduceat(rare, heads)
        stable = np.repeat(keep_all & (size >= shortest), size)
        settled.append(place[stable])
        left = ~rare & ~np.repeat(keep_all, size)
        place, segment = place[left], segment[left]
        new = np.diff(segment, prepend=-1).astype(bool) | (np.diff(place, prepend=-2) != 1)
        segment = np.cumsum(new) - 1
        if len(segment):
            long = np.bincount(segment)[segment] >= shortest
            place, segment = place[long], segment[long]
    return np.sort(np.concatenate([place, *settled]))


def _names(code: np.ndarray, segment: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... words at every place, cut at the segment's end.

    The last ranks are those of the whole rest of the segment. Later segments have the smaller ranks.
    """
    n, at = len(code), np.arange(len(code))
    names = [dense((segment.max() - segment) * (int(code.max()) + 1) + code)]
    step = 1
    while int(names[-1].max()) + 1 < n:
        last = names[-1]
        beyond = np.zeros(n, np.int64)
        inside = at + step < end
        beyond[inside] = last[at[inside] + step] + 1
        names.append(dense(last * (n + 1) + beyond))
        step *= 2
    return names


def _next_smaller(rank: np.ndarray, most: int) -> np.ndarray:
    """The next place with a smaller rank (or the end), by minima of 1, 2, 4, ... ranks."""
    n = len(rank)
    minima = [rank]
    while 1 << len(minima) <= most:
        half = 1 << len(minima) - 1
        longer = minima[-1].copy()
        longer[: n - half] = np.minimum(longer[: n - half], minima[-1][half:])
        minima.append(longer)
    found = np.arange(1, n + 1)
    for level in range(len(minima) - 1, -1, -1):
        ahead = np.flatnonzero(found + (1 << level) <= n)
        ahead = ahead[minima[level][found[ahead]] > rank[ahead]]
        found[ahead] += 1 << level
    return found


def _reach(names: list[np.ndarray], at: np.ndarray, other: np.ndarray, low: np.ndarray, high: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words from ``at`` on (or before it) equal those from ``other`` on (or before it)."""
    far = np.zeros(len(at), np.int64)
    for level in range(len(names) - 1, -1, -1):
        step = 1 << level
        here = np.flatnonzero(other + far < high) if ahead else np.flatnonzero(at - far - step >= low)
        shift = far[here] if ahead else -far[here] - step
        here = here[names[level][at[here] + shift] == names[level][other[here] + shift]]
        far[here] += step
    return far


def scan_lags(code: np.ndarray, segment: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs inside segments; segments are numbered 0, 1, ... in order."""
    size = np.bincount(segment)
    last = np.cumsum(size)
    low, high = np.repeat(last - size, size), np.repeat(last, size)
    found, names = [], None
    for turned in (code, int(code.max()) - code):
        ranks = _names(turned, segment, high)
        names = names or ranks  # equality does not depend on the order
        at = np.arange(len(code))
        period = _next_smaller(ranks[-1], int(size.max())) - at
        fits = np.flatnonzero(2 * period <= high - low)
        at, period = at[fits], period[fits]
        left = _reach(names, at, at + period, low[fits], high[fits], False)
        right = _reach(names, at, at + period, low[fits], high[fits], True)
        length = left + period + right
        good = length >= np.maximum(shortest, 2 * period)
        found.append(np.stack([at - left, length, period])[:, good])
    runs = np.unique(np.concatenate(found, axis=1), axis=1)
    return runs[0], runs[1], runs[2]


def find_runs(code: np.ndarray, owner: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of at least ``shortest`` words, by start, then period.

    ``code`` numbers the words of texts one behind the other, ``owner`` the texts; no run crosses texts.
    """
    if len(code):
        place = split_by_frequency(code, owner, shortest)
        if len(place):
            new = (np.diff(place, prepend=-2) != 1) | np.diff(owner[place], prepend=-1).astype(bool)
            start, length, period = scan_lags(dense(code[place]), np.cumsum(new) - 1, shortest)
            order = np.lexsort((period, start))
            return place[start[order]], length[order], period[order]
    return tuple(np.zeros(0, np.int64) for _ in range(3))


def _lists(heads: np.ndarray, **columns: np.ndarray) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(heads, pa.int32()), values)


def runs_step(shortest: int):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [t.split() for t in text_bytes(batch.column(batch.schema.get_field_index("text")))]
        flat = [w for ws in words for w in ws]
        numbers: dict[bytes, int] = {}
        code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in flat), np.int64, len(flat))
        count = np.array([len(ws) for ws in words], np.int64)
        first = np.cumsum(count) - count
        start, length, period = find_runs(code, np.repeat(np.arange(len(words)), count), shortest)
        doc = np.searchsorted(first, start, side="right") - 1
        heads = np.searchsorted(doc, np.arange(len(words) + 1))

        repeated = np.zeros(len(flat) + 1, np.int64)
        np.add.at(repeated, start + period, 1)
        np.add.at(repeated, start + length, -1)
        dropped = np.cumsum(repeated)[:-1] > 0
        collapsed = []
        for ws, at, n in zip(words, first.tolist(), count.tolist()):
            gone = dropped[at : at + n]
            collapsed.append(b" ".join([w for w, d in zip(ws, gone.tolist()) if not d] if gone.any() else ws))
        kept = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"}
        return pa.RecordBatch.from_pydict(kept | {
            "n_words": pa.array(count, pa.int64()),
            "runs": _lists(heads, start=start - first[doc], length=length, period=period),
            "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
        })

    return step


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", min_length: int = 12) -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` and ``collapsed`` of every row.

    ``runs`` array<struct<start, length, period>> lists every maximal stretch of at least ``min_length`` words and at
    least two whole periods, by start (from 0), then period; a text has fewer runs than words. ``collapsed`` is the text's
    words joined by one space, without those that some run contains after its first period. A null, empty or white
    text has no words, no runs and an empty ``collapsed``. Rows are handled one by one, so repeated rows give repeated
    results and an empty table an empty one; other columns are not read, and clashing names are harmless.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    schema = "".join(f"k{i} {kinds[c]}, " for i, c in enumerate(keep))
    schema += "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    out = map_texts(docs.select(*columns, F.col(f"`{text}`").alias("text")), "text", schema, lambda: runs_step(min_length))
    return out.toDF(*keep, "n_words", "runs", "collapsed")


def words_of(text: Column) -> Column:
    """The words between white space; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _GAP), lambda w: w != "")


def plant(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each tenth text, by the checksum of its id, goes on with one stretch of its words over and over."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    words = words_of(F.col("text"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words").cast("bigint"), F.floor(F.col("h") / 10).cast("bigint")
    rows = rows.withColumn("n", n).withColumn("g", g).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("transform(sequence(0L, n - 1), i -> words[CAST(IF(i < a, i, a + (i - a) % p) AS int)])")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document: their number, the longest, and digests of all of them and of the collapsed text."""
    found = periodic_runs(plant(read(spark, sf_dir, "documents", "doc_id", "text")), ["doc_id"])
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS l, -r.start AS s, -r.period AS p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("(1000 * best.l) div (-best.p)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
#: SQL cannot find periods; tests/llm compares with a scan of every lag.
ORACLE_SQL: dict[str, str] = {}
