"""Text detectors: one row in, features or findings out, no shuffle of the text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkpoison.functions import catalogue as cat, shingles as sh, textstats as ts
from sparkpoison.functions.arrays import running
from sparkpoison.functions.numeric import cap1, round_to
from sparkpoison.session import checkpoint

# --------------------------------------------------------------------------- statistics

_STATS = {
    "char_entropy": ("raw", ts.char_entropy),
    "perplexity": ("lower", lambda c: ts.bigram_perplexity(c, 3, 1.0)),
    "perplexity_edge": ("raw", lambda c: ts.bigram_perplexity(c, 2, 0.0)),
    "bigram_entropy": ("raw", ts.bigram_entropy),
    "coherence": ("raw", ts.coherence),
    "entropy_anomalies": ("raw", lambda c: c.per_doc(ts.entropy_windows(c)[0])),
    "ngram_anomalies": ("lower", lambda c: c.per_doc(ts.ngram_anomalies(c)[0])),
}
_COUNTS = ("entropy_anomalies", "ngram_anomalies")


def _id_type(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def _source(
    docs: DataFrame, text: str, doc_id: str, lower: bool, raw: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    cols = [F.col(c) for c in (doc_id, *keep)]
    if raw:
        cols.append(F.col(text).alias("raw"))
    if lower:
        cols.append(F.lower(text).alias("lower"))
    return docs.select(*cols)


def text_stats(
    docs: DataFrame, features: Sequence[str] = tuple(_STATS), text: str = "text", doc_id: str = "doc_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """The named statistics of each document, computed in one pass over its text.

    Columns named in ``keep`` pass through, so a report needs no join to bring them back.
    """
    unknown = set(features) - set(_STATS)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    kinds = {_STATS[f][0] for f in features}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            sizer = batch.column(batch.num_columns - 1)
            for lo, hi in ts.chunks(sizer):
                part = batch.slice(lo, hi - lo)
                pieces = {k: ts.Chunk(part.column(k)) for k in kinds}
                columns = [part.column(i) for i in range(1 + len(keep))]
                for f in features:
                    kind, fn = _STATS[f]
                    columns.append(pa.array(fn(pieces[kind]), pa.int64() if f in _COUNTS else pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, [doc_id, *keep, *features])

    schema = ", ".join(
        [f"{c} {_id_type(docs, c)}" for c in (doc_id, *keep)] + [f"{f} {'bigint' if f in _COUNTS else 'double'}" for f in features]
    )
    return _source(docs, text, doc_id, "lower" in kinds, "raw" in kinds, keep).mapInArrow(scan, schema)


def char_entropy(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return text_stats(docs, ["char_entropy"], text, doc_id)


def bigram_perplexity(docs: DataFrame, profile: str = "service", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    name = {"service": "perplexity", "edge": "perplexity_edge"}[profile]
    return text_stats(docs, [name], text, doc_id).withColumnRenamed(name, "perplexity")


def bigram_entropy(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: Sequence[str] = ()
) -> DataFrame:
    """Bigram entropy scaled to [0, 1]; below 0.15 is suspiciously repetitive."""
    out = text_stats(docs, ["bigram_entropy"], text, doc_id, keep)
    score = cap1(F.col("bigram_entropy") / 6.0)
    return out.select(doc_id, *keep, score.alias("perplexity_score"), (score < 0.15).alias("is_low"))


def coherence(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return text_stats(docs, ["coherence"], text, doc_id)


def entropy_windows(
    docs: DataFrame, width: int = 256, threshold: float = 2.5, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per window whose entropy is more than ``threshold`` deviations off its document's mean."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ts.chunks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                owner, start, entropy, z = ts.entropy_windows(ts.Chunk(part.column(1)), width, threshold)
                ids = part.column(0).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(start, pa.int64()), pa.array(start + width, pa.int64()),
                     pa.array(entropy, pa.float64()), pa.array(z, pa.float64())],
                    [doc_id, "start", "end", "entropy", "z_score"],
                )

    schema = f"{doc_id} {_id_type(docs, doc_id)}, start bigint, end bigint, entropy double, z_score double"
    out = _source(docs, text, doc_id, lower=False).mapInArrow(scan, schema)
    return out.withColumn("severity", F.when(F.abs("z_score") > 4.0, "high").otherwise("medium"))


def ngram_anomalies(
    docs: DataFrame, smallest: int = 2, largest: int = 4, threshold: float = 3.0,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per n-gram far more frequent than the document's own n-grams on average."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ts.chunks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                chunk = ts.Chunk(part.column(1))
                doc, n, at, freq, z, high = ts.ngram_anomalies(chunk, smallest, largest, threshold)
                grams = [chunk.text(a, k) for a, k in zip(at, n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(n, pa.int32()), pa.array(grams, pa.string()),
                     pa.array(freq, pa.float64()), pa.array(high, pa.float64()), pa.array(z, pa.float64())],
                    [doc_id, "n", "ngram", "observed_freq", "expected_high", "z_score"],
                )

    schema = (
        f"{doc_id} {_id_type(docs, doc_id)}, n int, ngram string, observed_freq double, "
        "expected_high double, z_score double"
    )
    return _source(docs, text, doc_id, lower=True, raw=False).mapInArrow(scan, schema)


# --------------------------------------------------------------------------- bands

def entropy_band(entropy: Column) -> Column:
    low, high = (F.lit(2.0) - entropy) / 2.0, (entropy - 6.0) / 2.0
    return F.when(entropy < 2.0, cap1(low)).when(entropy > 6.0, cap1(high)).otherwise(0.0)


def perplexity_band(perplexity: Column, profile: str = "edge") -> Column:
    """Edge: 0 up to 100, 1 from 600. Service: the flag for more than 80."""
    if profile == "service":
        return (perplexity > 80.0).cast("double")
    return F.when(perplexity <= 100, 0.0).when(perplexity >= 600, 1.0).otherwise((perplexity - 100.0) / 500.0)


def each(df: DataFrame, keep: Sequence[str], items: Column, name: str) -> DataFrame:
    """One row per item. The outer form keeps the optimizer from testing the array's size first,
    which would compute a costly array twice; documents without items are dropped afterwards."""
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


# --------------------------------------------------------------------------- characters

def count_points(text: Column | str, points: Iterable[int]) -> Column:
    return F.regexp_count(text, F.lit(cat.char_class(list(points))))


def _char_rows(docs: DataFrame, points: Iterable[int], text: str, doc_id: str) -> DataFrame:
    """(doc, position, character) of the given code points; documents without any are never exploded."""
    points = list(points)
    hit = docs.select(doc_id, text).where(F.col(text).rlike(cat.char_class(points)))
    chars = hit.select(doc_id, F.posexplode_outer(F.split(text, "")).alias("position", "character"))
    return chars.where(F.col("character").isin([chr(p) for p in points]))


def _codepoint(char: Column) -> Column:
    """U+XXXX of a one-character string."""
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("long")), 4, "0"))


def homoglyphs(docs: DataFrame, profile: str = "service", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per lookalike character with its position, code point and the ASCII letter it imitates."""
    table = {"service": cat.HOMOGLYPHS, "edge": cat.EDGE_HOMOGLYPHS}[profile]
    rows = _char_rows(docs, table, text, doc_id)
    lookalike = F.translate("character", "".join(map(chr, table)), "".join(table.values()))
    return rows.select(
        doc_id, F.col("position").cast("bigint").alias("position"), "character",
        _codepoint(F.col("character")).alias("codepoint"), lookalike.alias("lookalike"),
    )


def homoglyph_counts(docs: DataFrame, profile: str = "service", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    table = {"service": cat.HOMOGLYPHS, "edge": cat.EDGE_HOMOGLYPHS}[profile]
    return docs.select(doc_id, count_points(text, table).cast("bigint").alias("homoglyph_count"))


def homoglyph_summary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The edge record: total count, first 50 positions, first 10 examples."""
    rows = homoglyphs(docs, "edge", text, doc_id)
    example = F.format_string('"%s" (%s) at pos %d', "character", "codepoint", "position")
    # The chars of one document are on one task already; only its first 50 hits are kept.
    first = F.array_sort(F.collect_list(F.when(F.col("nth") <= 50, F.struct("position", example.alias("example")))))
    from pyspark.sql import Window

    w = Window.partitionBy(doc_id).orderBy("position")
    return (
        rows.withColumn("nth", F.row_number().over(w))
        .groupBy(doc_id)
        .agg(F.count("*").alias("count"), first.alias("firsts"))
        .select(
            doc_id, "count", F.col("firsts.position").alias("positions"),
            F.slice(F.col("firsts.example"), 1, 10).alias("examples"),
        )
    )


def invisible_chars(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per invisible or direction-changing character."""
    rows = _char_rows(docs, cat.INVISIBLE, text, doc_id)
    rtl = F.col("character").isin([chr(p) for p in cat.RTL_OVERRIDES])
    names = F.create_map(*[F.lit(v) for p, n in cat.INVISIBLE.items() for v in (chr(p), n)])
    return rows.select(
        doc_id, F.col("position").cast("bigint").alias("position"),
        _codepoint(F.col("character")).alias("codepoint"),
        names[F.col("character")].alias("decoded_content"),
        F.when(rtl, "rtl_override").otherwise("zero_width").alias("instruction_type"),
        F.when(rtl, "high").otherwise("medium").alias("severity"),
    )


# --------------------------------------------------------------------------- base64

BASE64_RUN = r"(?<![A-Za-z0-9+/=])([A-Za-z0-9+/]{20,}={0,3})(?![A-Za-z0-9+/=])"
EDGE_BASE64_RUN = r"[A-Za-z0-9+/]{40,}={0,2}"
#: characters neither printable nor white space
_UNPRINTABLE = r"[\p{C}&&[^\x{09}-\x{0D}\x{1C}-\x{1F}\x{85}]]"


def decoded_payload(candidate: Column) -> Column:
    """Text of a strictly valid base64 string, null otherwise."""
    valid = (F.length(candidate) % 4 == 0) & ~candidate.endswith("===")
    return F.make_valid_utf8(F.when(valid, F.try_to_binary(candidate, F.lit("base64"))).cast("string"))


def readable(decoded: Column) -> Column:
    n = F.length(decoded)
    return (n > 5) & ((n - F.regexp_count(decoded, F.lit(_UNPRINTABLE))) / n > 0.7)


def payload_list(text: Column | str) -> Column:
    """Array of (candidate, decoded) for the base64 runs of a text that decode to readable text."""
    runs = F.regexp_extract_all(text, F.lit(BASE64_RUN), F.lit(1))
    pairs = F.transform(runs, lambda c: F.struct(c.alias("candidate"), decoded_payload(c).alias("decoded")))
    return F.filter(pairs, lambda p: F.coalesce(readable(p["decoded"]), F.lit(False)))


def base64_payloads(docs: DataFrame, profile: str = "service", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Service: one row per decodable payload. Edge: candidate count and up to five samples per document."""
    if profile == "edge":
        runs = F.regexp_extract_all(text, F.lit(EDGE_BASE64_RUN), F.lit(0))
        sample = F.transform(
            F.slice(runs, 1, 5),
            lambda m: F.concat(F.substring(m, 1, 60), F.when(F.length(m) > 60, "…").otherwise("")),
        )
        return docs.select(doc_id, F.size(runs).cast("bigint").alias("base64_count"), sample.alias("samples"))
    found = each(docs.where(F.col(text).rlike(BASE64_RUN)), [doc_id], payload_list(text), "p")
    shown = F.concat(
        F.substring("p.candidate", 1, 80), F.when(F.length("p.candidate") > 80, "...").otherwise("")
    )
    return found.select(
        doc_id, F.lit("base64_payload").alias("instruction_type"), shown.alias("matched_text"),
        F.substring("p.decoded", 1, 200).alias("decoded_content"), F.lit("high").alias("severity"),
    )


# --------------------------------------------------------------------------- patterns

def java_regex(pattern: str, ignore_case: bool = True) -> str:
    """A pattern with Unicode classes, where only a newline ends a ``.``."""
    return f"(?{'i' if ignore_case else ''}Ud){pattern}"


def pattern_hits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every match of every injection pattern, with its character position.

    Patterns are literals, so each is compiled once; documents matching none are dropped
    before matches are extracted. The pieces between matches and the matches themselves come
    in the same order, so running sums of their lengths are positions: the work per document
    is proportional to its length and its matches.
    """
    found = []
    for name, kind, severity, pattern, fold in cat.INJECTION_PATTERNS:
        regex = java_regex(pattern, fold)
        found.append(
            F.when(
                F.col(text).rlike(regex),
                F.struct(
                    F.lit(name).alias("pattern"), F.lit(kind).alias("instruction_type"), F.lit(severity).alias("severity"),
                    F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("matches"),
                    F.transform(F.split(text, regex, -1), lambda piece: F.length(piece)).alias("gaps"),
                ),
            )
        )
    per_pattern = each(docs, [doc_id], F.array_compact(F.array(*found)), "hit")
    steps = F.zip_with("hit.matches", F.slice("hit.gaps", F.lit(1), F.size("hit.matches")), lambda m, gap: gap + F.length(m))
    per_pattern = running(per_pattern.withColumn("_ends", steps), "_ends")
    flat = per_pattern.select(
        doc_id, "hit.pattern", "hit.instruction_type", "hit.severity",
        F.posexplode_outer(F.arrays_zip(F.col("hit.matches").alias("match"), F.col("_ends").alias("end"))).alias("nth", "m"),
    )
    return flat.select(
        doc_id, "pattern", "instruction_type", "severity", (F.col("nth") + 1).cast("bigint").alias("nth"),
        F.col("m.match").alias("matched_text"), (F.col("m.end") - F.length("m.match")).cast("bigint").alias("position"),
    )


def first_matches(text: Column | str, patterns: Sequence[str]) -> Column:
    """First match of each pattern found, at most 80 characters of it, in catalogue order."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_compact(
        F.array(*[
            F.when(col.rlike("(?i)" + p), F.substring(F.regexp_extract(col, "(?i)" + p, 0), 1, 80)) for p in patterns
        ])
    )


def pattern_count(text: Column | str, patterns: Sequence[str]) -> Column:
    """Number of patterns that occur at least once."""
    col = F.col(text) if isinstance(text, str) else text
    return sum((F.when(col.rlike("(?i)" + p), 1).otherwise(0) for p in patterns), F.lit(0)).cast("bigint")


def match_count(text: Column | str, patterns: Sequence[tuple[str, bool]]) -> Column:
    """Total matches over all patterns."""
    return sum((F.regexp_count(text, F.lit(java_regex(p, fold))) for p, fold in patterns), F.lit(0)).cast("bigint")


def edge_hidden_instructions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    matched = first_matches(text, cat.EDGE_INJECTION_PATTERNS)
    return docs.select(doc_id, matched.alias("matched")).select(
        doc_id, F.size("matched").cast("bigint").alias("match_count"), "matched"
    )


def attack_type(text: Column | str, deviation: Column) -> Column:
    """First lexical signature present, else a geometric one, else null."""
    folded = F.lower(text)
    expr = None
    for kind, words in cat.ATTACK_KEYWORDS.items():
        test = folded.contains(words[0])
        for word in words[1:]:
            test = test | folded.contains(word)
        expr = F.when(test, kind) if expr is None else expr.when(test, kind)
    return expr.when(deviation > cat.GRADIENT_ATTACK_DEVIATION, "gradient_attack")


def heuristics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per corpus heuristic a document triggers."""
    found = []
    for name, severity, options, need_all in cat.HEURISTICS:
        tests = [F.col(text).rlike(("(?i)" if fold else "") + pattern) for pattern, fold in options]
        test = tests[0]
        for other in tests[1:]:
            test = (test & other) if need_all else (test | other)
        found.append(F.when(test, F.struct(F.lit(name).alias("type"), F.lit(severity).alias("severity"))))
    return each(docs, [doc_id], F.array_compact(F.array(*found)), "h").select(doc_id, "h.*")


# --------------------------------------------------------------------------- encodings and lexicons

def tag_smuggling(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Runs of Unicode tag characters, decoded to the ASCII text they hide."""
    tags = r"[\x{E0020}-\x{E007E}]+"
    source = "".join(chr(0xE0000 + c) for c in range(0x20, 0x7F))
    target = "".join(chr(c) for c in range(0x20, 0x7F))
    runs = docs.where(F.col(text).rlike(tags)).select(
        doc_id, F.posexplode_outer(F.regexp_extract_all(text, F.lit(tags), F.lit(0))).alias("nth", "run")
    )
    return runs.select(
        doc_id, (F.col("nth") + 1).cast("bigint").alias("nth"), F.length("run").cast("bigint").alias("length"),
        F.translate("run", source, target).alias("decoded"),
    )


def lexicon_rates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Hearsay frames, segmentation emojis and synonym-codebook words per document."""
    folded = F.lower(text)
    frames = sum((F.when(folded.contains(f.lower()), 1).otherwise(0) for f in cat.HEARSAY_FRAMES), F.lit(0))
    one = "|".join(pair[1] for pair in cat.SYNONYM_BINS)
    zero = "|".join(pair[0] for pair in cat.SYNONYM_BINS)
    words = F.regexp_count(text, F.lit(r"\S+"))
    ones, zeros = (F.regexp_count(folded, F.lit(rf"\b({alt})\b")) for alt in (one, zero))
    return docs.select(
        doc_id,
        frames.cast("bigint").alias("hearsay_frames"),
        count_points(text, cat.SEGMENTATION_EMOJIS).cast("bigint").alias("emojis"),
        zeros.cast("bigint").alias("codebook_zeros"),
        ones.cast("bigint").alias("codebook_ones"),
        round_to(F.when(words > 0, (ones + zeros) / words).otherwise(0.0), 6).alias("codebook_rate"),
    )


def content_hash(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return docs.select(doc_id, F.sha2(text, 256).alias("content_hash"))


def exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Contents occurring more than once: copies, first id. Only hashes are shuffled, combined map-side."""
    return (
        content_hash(docs, text, doc_id)
        .groupBy("content_hash")
        .agg(F.count("*").alias("copies"), F.min(doc_id).alias("first_id"))
        .where(F.col("copies") > 1)
    )


# --------------------------------------------------------------------------- propagation fingerprints

def pattern_recurrence(docs: DataFrame, group: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """How many documents of each source repeat each injection pattern."""
    tests = [
        F.when(F.col(text).rlike(java_regex(p, fold)), F.lit(name)) for name, _, _, p, fold in cat.INJECTION_PATTERNS
    ]
    hits = each(docs, [group], F.array_compact(F.array(*tests)), "pattern")
    return hits.groupBy(group, "pattern").agg(F.count("*").alias("documents"))


def shingles(docs: DataFrame, words: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Distinct word shingles of each document, as 128 bits of hash: no two of 10^13 shingles meet by chance."""
    tokens = F.filter(F.split(F.lower(text), r"[ \t\n\f\r]+"), lambda w: w != "")
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - (words - 1), F.lit(1))),
        lambda i: F.array_join(F.slice("w", i, words), " "),
    )
    # Strings are made distinct in a hash set; an array of structs would be compared pair by pair.
    pair = lambda g: F.struct(F.xxhash64(g).alias("a"), F.xxhash64(F.lit(1), g).alias("b"))
    worded = docs.select(doc_id, tokens.alias("w"))
    return each(worded, [doc_id], F.when(F.size("w") > 0, F.transform(F.array_distinct(grams), pair)), "shingle")


#: bytes of text behind one bucket of shingles
_BUCKET_BYTES = 4 << 20


def copy_recurrence(docs: DataFrame, words: int = 8, text: str = "text", doc_id: str = "doc_id", frequent: int = sh.FREQUENT) -> DataFrame:
    """Share of each document's shingles that other documents also contain.

    Hashes of the shingles are dealt to buckets as arrays and counted there; only documents of shingles met more than
    once come out. No pair of documents is ever formed, no shingle is a row, and the text is read once.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        names = checkpoint(docs.select(doc_id).distinct().withColumn("_n", F.monotonically_increasing_id()))
        numbered = docs.join(names.withColumnRenamed(doc_id, "_name"), F.col(doc_id).eqNullSafe(F.col("_name"))).select("_n", text)
        return copy_recurrence(numbered, words, text, "_n", frequent).join(names, "_n").select(doc_id, "shingles", "copied", "widest", "copied_share")
    null = F.lit(-(2**63)).cast("bigint")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = min(max(size // _BUCKET_BYTES, 16), sh.MOST_BUCKETS)
    lowered = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), null).alias("id"), F.lower(text).alias("t"))
    dealt = lowered.mapInArrow(lambda batches: sh.deal(batches, words, buckets, frequent), sh.ROW)
    found = dealt.groupBy("bucket").applyInArrow(sh.count, sh.FOUND)
    rows = found.mapInArrow(sh.spread, "id bigint, shingles bigint, copied bigint, widest bigint")
    out = rows.groupBy("id").agg(F.sum("shingles").alias("shingles"), F.sum("copied").alias("copied"), F.max("widest").alias("widest"))
    out = out.withColumn("copied_share", round_to(F.col("copied") / F.col("shingles"), 6))
    return out.select(F.nullif("id", null).cast(kind).alias(doc_id), "shingles", "copied", "widest", "copied_share")


def generation_drift(stats: DataFrame, value: str, generation: str = "generation", by: Sequence[str] = ()) -> DataFrame:
    """Change of a statistic's mean between consecutive generations."""
    from pyspark.sql import Window

    means = stats.groupBy(*by, generation).agg(F.avg(value).alias("mean"), F.count("*").alias("documents"))
    w = Window.partitionBy(*by).orderBy(generation)
    return means.withColumn("drift", F.abs(F.col("mean") - F.lag("mean").over(w)))
