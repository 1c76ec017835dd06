"""Secret scan: named patterns, and tokens that pass a battery of randomness tests.

A candidate is a long run of key characters. Its encoding (digits, hex, letters, base32,
base36 or base64) follows from the characters it uses, and three tests ask whether it could
be uniform random text of that encoding: chi-squared over the alphabet, Wald-Wolfowitz runs about the middle of the
alphabet, and lag-1 serial correlation. Their joint p-value is Bonferroni's. Over the whole
corpus, Benjamini-Hochberg per band of lengths declares candidates "not random" at a given
false-discovery rate; a candidate that is not so declared, and long enough for the
chi-squared test to have found ordinary writing, is reported. Runs without a digit or without
a letter are mostly names and long words: they have bands of their own, so that they do not
move the cuts of the others, and what is reported must also be less likely as letters of
ordinary writing than as uniform ones.

Everything on the way is DataFrame functions. p-values are counted in bins, so no task
orders them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkpoison.functions.arrays import running
from sparkpoison.llm.common import read
from sparkpoison.session import checkpoint

# Patterns of the named kinds, in the order of their names in a result.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: a candidate: a run of key characters
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: encoding: (alphabet size, characters in order of value)
ALPHABETS = {
    "hex": "0123456789abcdef",
    "digits": "0123456789",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "cased": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: p-value bins per factor of e, and their number
_FINE, _BINS = 16, 1024
#: added to the band of a candidate without a digit or without a letter
_PLAIN = 64
# Quarter bits by which a to z are more frequent in English, German and French writing than 1 / 26.
WRITING = (4, -6, -1, 1, 8, -5, -4, 0, 4, -14, -9, 1, -2, 4, 2, -5, -12, 3, 4, 4, 1, -7, -6, -17, -10, -12)
#: quarter bits from which a candidate without a digit or without a letter counts as writing
_WRITTEN = -16


def _matches(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Add array<struct(start, end, match)> of the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches themselves have the same order, so running
    sums of their lengths are positions: one pass each, with no search per match.
    """
    body = F.col(text)
    has = body.rlike(pattern)
    df = df.withColumn("_found", F.when(has, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    gaps = F.when(has, F.transform(F.split(body, pattern, -1), lambda s: F.length(s))).otherwise(F.array().cast("array<int>"))
    steps = F.zip_with("_found", F.slice(gaps, F.lit(1), F.size("_found")), lambda m, g: g + F.length(m))
    df = running(df.withColumn("_ends", steps), "_ends")
    spans = F.zip_with("_found", "_ends", lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))
    return df.withColumn(out, spans).drop("_found", "_ends")


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal by the rational approximation of erfc (error below 2e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    # Coefficients of that approximation.
    poly = reduce(lambda acc, c: (acc + F.lit(c)) * t, (-1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(1.061405429) * t)
    half = F.lit(0.5) * poly * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1.0 - half)


def _encoding(token: Column) -> Column:
    """Smallest alphabet that holds the token."""
    return (
        F.when(token.rlike("^[0-9]+$"), "digits").when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^([a-z]+|[A-Z]+)$"), "letters").when(token.rlike("^[A-Z2-7]+$"), "base32")
        .when(token.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36").when(token.rlike("^[A-Za-z]+$"), "cased").otherwise("base64")
    )


def _with_p(df: DataFrame, name: str) -> DataFrame:
    """Candidates as struct(start, end, n, bits, plain, written, p): the battery's p-value under \"uniform random text of its encoding\".

    ``plain``: without a digit or without a letter; ``written``: plain, and its letters may be ordinary writing.
    """
    sizes = lambda enc: reduce(lambda w, k: w.when(enc == k, len(ALPHABETS[k])), list(ALPHABETS)[1:], F.when(enc == "hex", 16))
    order = lambda enc: reduce(lambda w, k: w.when(enc == k, ALPHABETS[k]), list(ALPHABETS)[1:], F.when(enc == "hex", ALPHABETS["hex"]))
    plain = lambda c: F.when(c["enc"].isin("hex", "letters", "base36"), F.lower(c["match"])).otherwise(F.translate(c["match"], "-_", "+/"))
    mixed = lambda c: c["match"].rlike("[0-9]") & c["match"].rlike("[A-Za-z]")
    gain = lambda x: F.coalesce(F.get(F.array(*map(F.lit, WRITING)), F.ascii(x) - 97), F.lit(0))
    written = lambda c: F.aggregate(F.split(F.lower(c["match"]), ""), F.lit(0), lambda s, x: s + gain(x)) > _WRITTEN
    c1 = F.transform(name, lambda c: F.struct(
        c["start"], c["end"], c["match"], (~mixed(c)).alias("plain"), (~mixed(c) & written(c)).alias("written"), _encoding(c["match"]).alias("enc"),
    ))
    c2 = F.transform(c1, lambda c: F.struct(
        c["start"], c["end"], c["plain"], c["written"], sizes(c["enc"]).cast("double").alias("a"),
        F.transform(F.filter(F.split(plain(c), ""), lambda x: x != ""), lambda x: (F.position(x, order(c["enc"])) - 1).cast("double")).alias("v"),
    ))
    sum_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    rest = lambda v: F.slice(v, F.lit(2), F.size(v) - 1)
    head = lambda v: F.slice(v, F.lit(1), F.size(v) - 1)
    c3 = F.transform(c2, lambda c: F.struct(
        c["start"], c["end"], c["plain"], c["written"], c["a"], F.size(c["v"]).cast("double").alias("n"),
        sum_of(F.transform(F.array_distinct(c["v"]), lambda d: F.pow(F.size(F.filter(c["v"], lambda x: x == d)).cast("double"), F.lit(2.0)))).alias("squares"),
        sum_of(F.zip_with(head(c["v"]), rest(c["v"]), lambda x, y: F.when((x >= c["a"] / 2) != (y >= c["a"] / 2), 1.0).otherwise(0.0))).alias("turns"),
        sum_of(F.zip_with(head(c["v"]), rest(c["v"]), lambda x, y: (x - (c["a"] - 1) / 2) * (y - (c["a"] - 1) / 2))).alias("serial"),
    ))
    df_ = lambda c: c["a"] - 1
    chi = lambda c: F.pow(F.greatest(c["a"] / c["n"] * c["squares"] - c["n"], F.lit(0.0)) / df_(c), F.lit(1 / 3))
    z_chi = lambda c: (chi(c) - (1 - F.lit(2.0) / (9 * df_(c)))) / F.sqrt(F.lit(2.0) / (9 * df_(c)))
    z_runs = lambda c: (c["turns"] - (c["n"] - 1) / 2) / (F.sqrt(c["n"] - 1) / 2)
    z_serial = lambda c: c["serial"] / ((c["a"] * c["a"] - 1) / 12 * F.sqrt(c["n"] - 1))
    c4 = F.transform(c3, lambda c: F.struct(
        c["start"], c["end"], c["n"], (c["n"] * F.log2(c["a"])).alias("bits"), c["plain"], c["written"],
        F.least(F.lit(1.0), 3 * F.least(_tail(z_chi(c)), 2 * _tail(F.abs(z_runs(c))), 2 * _tail(F.abs(z_serial(c))))).alias("p"),
    ))
    return df.withColumn(name, c4)


def _band(c: Column) -> Column:
    """Lengths of one power of two are corrected together, plain candidates apart from the others."""
    return F.floor(F.log2(c["n"])).cast("int") + F.when(c["plain"], _PLAIN).otherwise(0)


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * _FINE), F.lit(_BINS - 1)).cast("int")


def with_candidates(docs: DataFrame, text: str = "text", out: tuple[str, str] = ("_base", "_candidates")) -> DataFrame:
    """Add the named spans, sorted, and the candidates of the randomness tests that overlap none of them."""
    base, cand = out
    df = docs
    for pattern, name in ((ASSIGN, "_assign"), (ACCESS, "_access"), (HEX, "_hex"), (TOKEN, cand)):
        df = _matches(df, text, pattern, name)
    kept = F.filter("_assign", lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 6)
    spans = lambda xs, k: F.transform(xs, lambda m: F.struct(m["start"], F.lit(k).alias("kind"), m["end"]))
    df = df.withColumn(base, F.array_sort(F.concat(spans(kept, 0), spans(F.col("_access"), 1), spans(F.col("_hex"), 2)))).drop("_assign", "_access", "_hex")
    apart = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return _with_p(df.withColumn(cand, F.filter(cand, apart)), cand)


def fit_cuts(scanned: DataFrame, rate: float = 0.05, cand: str = "_candidates") -> dict[int, int]:
    """{length band: first bin of p-values declared \"not random\"}, by Benjamini-Hochberg over all candidates of the band."""
    counts = (
        scanned.select(F.explode_outer(cand).alias("c")).where(F.col("c.n").isNotNull()).groupBy(_band(F.col("c")).alias("band"), _bin(F.col("c.p")).alias("bin"))
        .agg(F.count("*").alias("n")).collect()  # bands times bins at most
    )
    cuts = {}
    for band in {r["band"] for r in counts}:
        own = sorted(((r["bin"], r["n"]) for r in counts if r["band"] == band), reverse=True)
        total, seen = sum(n for _, n in own), 0
        cuts[band] = _BINS
        for at, n in own:
            seen += n
            if 2.718281828459045 ** (-at / _FINE) <= rate * seen / total:
                cuts[band] = at
    return cuts


def with_spans(scanned: DataFrame, cuts: dict[int, int], min_bits: float = 80, base: str = "_base", cand: str = "_candidates", out: str = "spans") -> DataFrame:
    """Add array<struct(start, kind, end)>: the named spans and the candidates that still count as random."""
    at = F.create_map(*[F.lit(x) for kv in (cuts or {-1: 0}).items() for x in kv])
    random = F.filter(cand, lambda c: (c["bits"] >= min_bits) & ~c["written"] & (_bin(c["p"]) < F.coalesce(at[_band(c)], F.lit(_BINS))))
    added = F.transform(random, lambda c: F.struct(c["start"], F.lit(KINDS.index("random")).alias("kind"), c["end"]))
    return scanned.withColumn(out, F.array_sort(F.concat(base, added)))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, keep: list[str], text: str = "text", rate: float = 0.05, min_bits: float = 80) -> DataFrame:
    """``keep`` columns with ``base`` and ``spans``, arrays of struct(start, kind, end) in code points, end exclusive.

    One row per input row. A null or empty text has no spans; texts are read whole; repeated rows give repeated
    results; an empty table gives an empty result. Columns beside ``keep`` and ``text`` are not read, so their names
    cannot clash.
    """
    df = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    scanned = checkpoint(with_candidates(df, "_text").drop("_text"))  # the rate needs all documents first
    spans = with_spans(scanned, fit_cuts(scanned, rate), min_bits)
    return spans.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("_base").alias("base"), "spans")


def redact(docs: DataFrame, text: str = "text", mask: str = "<secret>", rate: float = 0.05, min_bits: float = 80) -> DataFrame:
    """``docs`` with every span of every text replaced by ``mask``; overlapping spans are one. Same columns, same rows.

    A null text stays null. A first pass over the texts finds the false-discovery cuts, a second applies them.
    """
    names = docs.columns
    at = f"c{names.index(text)}"
    df = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("_text", F.coalesce(at, F.lit("")))
    scanned = with_candidates(df, "_text")
    cuts = fit_cuts(scanned.select("_candidates"), rate)
    df = with_spans(scanned, cuts, min_bits).drop("_base", "_candidates")
    # Text is kept between the furthest end so far and the next start beyond it.
    df = running(df.withColumn("_reach", F.transform("spans", lambda s: s["end"])), "_reach", lambda a, x: F.greatest(a, x))
    before = F.concat(F.array(F.lit(0)), F.col("_reach"))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("_text")))
    gaps = F.zip_with(before, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # A text that begins or ends with a span has an empty piece there; one between spans that touch is none.
    gaps = F.filter(gaps, lambda g, i: (g["a"] < g["b"]) | (i == 0) | (i == F.size("spans")))
    df = df.withColumn("_gaps", gaps)
    kept = F.transform("_gaps", lambda g: F.substring(F.col("_text"), g["a"] + 1, F.greatest(g["b"] - g["a"], F.lit(0))))
    df = df.withColumn(at, F.when(F.size("spans") > 0, F.array_join(kept, mask)).otherwise(F.col(at)))
    return df.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the named kinds and all spans."""
    found = scan_secrets(read(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"),
    )


QUERIES = {"op9_secret_scan": op9_secret_scan}
#: DuckDB gives no match positions; tests/llm compares with Python's re.
ORACLE_SQL: dict[str, str] = {}
