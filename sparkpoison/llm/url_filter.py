"""URL filter: exact membership of hosts and rules through a Bloom filter cascade.

Listed keys are known, and so is every key that can be asked for: the host suffixes and
path prefixes of the corpus. Level 1 of the cascade is a Bloom filter of the listed keys;
level 2 one of the unlisted keys that level 1 lets through; level 3 one of the listed keys
that level 2 lets through, and so on until a level lets nothing wrong through. The first
level that refuses a key decides: an odd level says unlisted, an even level says listed.
Over that key universe the answer is exact, and asking needs no join: the filters are a few
bits per listed key and travel as literals.

Everything on the way is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkpoison.llm.common import read
from sparkpoison.session import checkpoint

#: most bytes of one level's filter in a plan; more listed keys are dealt to more filters by their hash
MAX_FILTER_BYTES = 8 << 20
#: bytes of the bitmaps that bitmap_construct_agg makes
_BITMAP = 4096


@dataclass(frozen=True)
class Level:
    bits: bytes
    size: int
    hashes: int

    def lets_through(self, key: Column, level: int) -> Column:
        """Whether all bits of a key are set. Seven bits a byte, so that a byte is an ASCII character."""
        text = F.lit(self.bits)
        tests = []
        for at in _positions(key, level, self.size, self.hashes):
            byte = F.ascii(F.substring(text, (F.floor(at / 7) + 1).cast("int"), F.lit(1)).cast("string"))
            tests.append(byte.bitwiseAND(_power((at % 7).cast("int"))) != 0)
        return reduce(lambda a, b: a & b, tests)


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << i) for i in range(7)]), n + 1)


def _positions(key: Column, level: int, size: int, hashes: int) -> list[Column]:
    """Bit numbers by double hashing; the level comes first, so keys that meet in one level part in the next."""
    a, b = [F.pmod(F.xxhash64(F.lit(2 * level + i), key), F.lit(size)) for i in range(2)]
    return [(a + i * b) % size for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    """``contains(key)`` is exact for every key of the universe it was built over."""

    shards: tuple[tuple[Level, ...], ...]

    def contains(self, key: Column) -> Column:
        tests = [_decide(levels, key) for levels in self.shards]
        if len(tests) == 1:
            return tests[0]
        shard = _shard(key, len(tests))
        return F.coalesce(*[F.when(shard == i, t) for i, t in enumerate(tests)])


def _shard(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(n))


def _decide(levels: tuple[Level, ...], key: Column) -> Column:
    if not levels:
        return F.lit(False)
    # What all levels let through is listed exactly when their number is odd.
    answer = F.lit(len(levels) % 2 == 1)
    for n in range(len(levels), 0, -1):
        answer = F.when(~levels[n - 1].lets_through(key, n), F.lit(n % 2 == 0)).otherwise(answer)
    return answer


def _fill(keys: DataFrame, level: int, size: int, hashes: int) -> bytes:
    at = F.explode(F.array(*_positions(F.col("key"), level, size, hashes))).alias("at")
    bit = (F.floor(F.col("at") / 7) * 8 + F.col("at") % 7 + 1).cast("bigint")  # bit 7 of a byte stays unset
    maps = (
        keys.select(at).select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
        .collect()  # at most MAX_FILTER_BYTES
    )
    out = bytearray(_BITMAP * (size // 7 * 8 // (8 * _BITMAP) + 1))
    for row in maps:
        lo = (row["bucket"] - 1) * _BITMAP
        out[lo : lo + _BITMAP] = row["map"]
    return bytes(out[: size // 7 + 1])


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> Cascade:
    """Cascade of the keys of ``listed(key)`` over ``universe(key)``; listed keys that nobody can ask for are left out.

    Null keys are no keys. Repeated keys count once. An empty list gives a cascade that
    contains nothing. The number of filters follows from the number of listed keys, so that
    none is larger than ``max_bytes``.
    """
    tagged = (
        listed.select("key", F.lit(True).alias("listed"), F.lit(False).alias("asked"))
        .unionByName(universe.select("key", F.lit(False).alias("listed"), F.lit(True).alias("asked")))
        .where(F.col("key").isNotNull())
        .groupBy("key").agg(F.max("listed").alias("listed"), F.max("asked").alias("asked"))
        .where("asked").select("key", "listed")
    )
    tagged = checkpoint(tagged)
    counts = {r["listed"]: r["n"] for r in tagged.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    yes, no = counts.get(True, 0), counts.get(False, 0)
    if not yes:
        return Cascade(((),))
    shards = max(1, math.ceil(yes * _bits_per_key(yes, no) / 7 / max_bytes))
    built = []
    for i in range(shards):
        keys = tagged.where(_shard(F.col("key"), shards) == i) if shards > 1 else tagged
        built.append(_build_levels(keys, yes // shards + 1, no // shards + 1))
    return Cascade(tuple(built))


def _bits_per_key(yes: int, no: int) -> float:
    """Of the first level: its false positives shall be about yes / sqrt(2)."""
    rate = min(0.5, yes / (max(no, 1) * math.sqrt(2)))
    return -math.log(rate) / math.log(2) ** 2


def _build_levels(keys: DataFrame, yes: int, no: int) -> tuple[Level, ...]:
    levels: list[Level] = []
    inside, outside = keys.where("listed"), keys.where("not listed")
    n_in, per_key = yes, _bits_per_key(yes, no)
    while n_in:
        number = len(levels) + 1
        if number > 64:
            raise RuntimeError("the cascade does not shrink")
        size = max(64, math.ceil(n_in * per_key))
        hashes = max(1, round(per_key * math.log(2)))
        level = Level(_fill(inside, number, size, hashes), size, hashes)
        levels.append(level)
        # Those that pass wrongly are the next level's keys; the roles change.
        wrong = outside.where(level.lets_through(F.col("key"), number))
        outside, inside = inside, wrong
        n_in, per_key = wrong.count(), 1 / math.log(2)
    return tuple(levels)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://``, A-Z lower-cased; both empty without ``://`` or for null."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(_ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _suffixes(host: Column, labels: Iterable[int]) -> Column:
    """The host's last k labels, for each k of ``labels`` that it has."""
    n = F.size(F.split(host, r"\.", -1))
    return F.filter(F.array(*[F.when(n >= k, F.substring_index(host, ".", -k)) for k in labels]), lambda s: s.isNotNull())


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    listed: DataFrame,
    url: str = "url",
    max_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict; a column of one of these names is replaced.

    ``rules`` are (``allow`` or ``block``, host + path prefix); the longest rule that fits decides, of two equal
    texts the block. A rule fits its host and all subdomains if the path begins with the rule's. Where no rule fits,
    ``listed(key)``, a table of blocked hosts of any size that covers subdomains, decides: block, else allow.
    A null url, or one without ``://``, has empty host and path and is allowed unless a rule or the list holds the
    empty host. Rows are never dropped; an empty table stays empty.
    """
    split = [(kind, *rule.partition("/")[::2], rule) for kind, rule in rules]
    rule_labels = sorted({host.count(".") + 1 for _, host, _, _ in split}, reverse=True)
    lengths = sorted({len(path) + 1 for _, _, path, _ in split}, reverse=True)
    listed = listed.select(F.col("key").alias("key"))
    counted = listed.agg(F.array_sort(F.collect_set(F.size(F.split("key", r"\.", -1)))).alias("k")).first()["k"]
    list_labels = [k for k in counted if k > 0]  # different label numbers, not keys
    host, path = url_parts(F.col(url))
    # Other columns go by position, so none of their names meets one used here.
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    kept = [f"c{k}" for k in range(len(names))]
    judged = pages.select(*(F.col(f"`{n}`").alias(c) for n, c in zip(names, kept)), host.alias("host"), path.alias("path"))

    def rule_keys(h: Column, p: Column) -> Column:
        prefixes = [F.when(F.length(p) >= n, F.substring(p, 1, n)) for n in lengths]
        whole = F.transform(_suffixes(h, rule_labels), lambda s: F.transform(F.array(*prefixes), lambda x: F.concat(s, x)))
        return F.filter(F.flatten(whole), lambda k: k.isNotNull())

    hosts = judged.select("host").distinct()
    asked = [judged.select("host", F.substring("path", 1, max(lengths, default=0)).alias("path")).distinct()
             .select(F.explode(rule_keys(F.col("host"), F.col("path"))).alias("k"))
             .select(F.explode(F.array(F.concat(F.lit("allow "), "k"), F.concat(F.lit("block "), "k"))).alias("key"))]
    wanted = [pages.sparkSession.createDataFrame([(f"{kind} {rule}",) for kind, rule in rules] or [("",)], "key string")]
    asked.append(hosts.select(F.explode(_suffixes(F.col("host"), list_labels) if list_labels else F.array().cast("array<string>")).alias("k"))
                 .select(F.concat(F.lit("list "), "k").alias("key")))
    wanted.append(listed.select(F.concat(F.lit("list "), "key").alias("key")))
    cascade = build_cascade(reduce(DataFrame.union, wanted), reduce(DataFrame.union, asked).distinct(), max_bytes)

    def hits(kind: str, keys: Column) -> Column:
        return F.filter(keys, lambda k: cascade.contains(F.concat(F.lit(f"{kind} "), k)))

    keys = rule_keys(F.col("host"), F.col("path")) if rules else F.array().cast("array<string>")
    found = F.concat(
        F.transform(hits("allow", keys), lambda k: F.struct(F.length(k).alias("n"), F.lit("allow").alias("verdict"), k.alias("rule"))),
        F.transform(hits("block", keys), lambda k: F.struct(F.length(k).alias("n"), F.lit("block").alias("verdict"), k.alias("rule"))),
    )
    on_list = F.exists(_suffixes(F.col("host"), list_labels), lambda k: cascade.contains(F.concat(F.lit("list "), k))) if list_labels else F.lit(False)
    best = F.array_max(found)
    verdict = F.coalesce("best.verdict", F.when(on_list, "block").otherwise("allow"))
    return judged.withColumn("best", best).select(*kept, "host", "path", "best.rule", verdict).toDF(*names, "host", "path", "rule", "verdict")


#: rules of the registered query
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: host words by which the registered query makes its list of blocked hosts
LISTED_WORDS = r"(^|[.-])(spam|adult)([.-]|$)"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; the list holds the corpus's hosts with a listed word."""
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    listed = pages.select(url_parts(F.col("url"))[0].alias("key")).where(F.col("key").rlike(LISTED_WORDS)).distinct()
    return filter_urls(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op1_url_filter": op1_url_filter}

ORACLE_SQL = {"op1_url_filter": """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), parts AS (
  SELECT page_id,
    coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path
  FROM hosts
), rules(kind, rule, rule_host, rule_path) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), keyed AS (SELECT row_number() OVER () AS rid, * FROM parts),
fits AS (
  SELECT rid, max_by(kind, length(rule)) AS kind, max_by(rule, length(rule)) AS rule
  FROM keyed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY rid
)
SELECT page_id, host, path, rule,
  coalesce(kind, CASE WHEN regexp_matches(host, '(^|[.-])(spam|adult)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed LEFT JOIN fits USING (rid)
"""}
