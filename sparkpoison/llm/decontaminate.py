"""Benchmark decontamination: short test items found inside long documents.

Containment is the share of an item's distinct word shingles that a document has. The search
is by MinHash, with items partitioned by size: an item of q shingles of which a share c must
be found can lack q - ceil(c q), so one of its smallest hash values, one more than it may
lack, is in every document that contains it. Those minima are all that is looked up, each
size class with its own hash bound and its own least document size, and no document that
contains an item is missed, however long it is. Pairs found this way are verified on the
words themselves.

Everything is DataFrame functions. A text's decision is a function of the text, so texts are
known by a 128-bit key and copies are looked up once; ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkpoison.llm.common import read
from sparkpoison.session import broadcast_if_small, checkpoint

# Fixed value: what separates words, in lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: shares are compared in whole numbers of this
_PARTS = 1000


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters and digits and of everything beyond ASCII."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def text_key(text: Column) -> list[Column]:
    """128 bits of a text as columns k1, k2; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")]


def _shingle_hashes(df: DataFrame, words: str, n: int, out: str) -> DataFrame:
    """Hash of every run of ``n`` words; none if there are fewer words."""
    df = df.withColumn("_wh", F.transform(words, lambda w: F.xxhash64(w)))
    runs = F.transform("_wh", lambda h, i: F.xxhash64(h, *[F.get("_wh", i + k) for k in range(1, n)]))
    count = F.greatest(F.size("_wh") - (n - 1), F.lit(0))
    return df.withColumn(out, F.slice(runs, F.lit(1), count)).drop("_wh")


def _shingles(words: str, n: int) -> Column:
    """Distinct runs of ``n`` words as text."""
    last = F.size(words) - (n - 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))


def _minima(items: DataFrame, n: int, least: int) -> DataFrame:
    """(h, item_id, q, size_class, bound): the looked-up hashes of every item."""
    hashed = _shingle_hashes(items.withColumn("w", words_of(F.col("text"))), "w", n, "hs").select("item_id", F.array_distinct("hs").alias("hs"))
    hashed = hashed.withColumn("q", F.size("hs").cast("bigint"))
    needed = F.floor((F.col("q") * least + (_PARTS - 1)) / _PARTS)
    smallest = F.slice(F.array_sort("hs"), F.lit(1), (F.col("q") - needed + 1).cast("int"))
    # explode_outer: Spark would copy explode's own filter, with all that computes the array, into the lambdas below.
    out = hashed.select("item_id", "q", F.explode_outer(smallest).alias("h")).where(F.col("h").isNotNull())
    return out.withColumn("size_class", F.floor(F.log2("q")).cast("int"))


def candidates(docs: DataFrame, items: DataFrame, n: int = 5, least: int = 800) -> DataFrame:
    """(k1, k2, item_id) of texts that hold one of an item's minima and enough shingles to contain the item."""
    minima = checkpoint(_minima(items, n, least))
    bounds = minima.agg(F.max("h").alias("h"), F.min("q").alias("q")).first()
    if bounds["h"] is None:
        return docs.select(*text_key(F.col("text")), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")).where(F.lit(False))
    fewest = (bounds["q"] * least + _PARTS - 1) // _PARTS
    rows = _shingle_hashes(docs.select(*text_key(F.col("text")), words_of(F.col("text")).alias("w")), "w", n, "hs")
    low = F.when(F.size("hs") >= fewest, F.filter("hs", lambda h: h <= bounds["h"]))
    probes = rows.select("k1", "k2", F.size("hs").alias("m"), F.explode_outer(low).alias("h")).where(F.col("h").isNotNull())
    classes = minima.groupBy("size_class").agg(F.max("h").alias("bound"))
    side = broadcast_if_small(minima.join(F.broadcast(classes), "size_class"))  # a class per power of two
    hit = probes.join(side, "h").where((F.col("h") <= F.col("bound")) & (F.col("m") * _PARTS >= F.col("q") * least))
    return hit.select("k1", "k2", "item_id").distinct()


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    n: int = 5,
    at_least: float = 0.8,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(k1, k2, doc_id, item_id, n_shingles, n_found) of every document and item it contains, each pair once.

    A null text is empty. Texts and items of fewer than ``n`` words have no shingles and are never found;
    an item without id is not looked for.
    Repeated rows give one row; documents of one id and different texts are looked at each; an id may be null.
    Other columns are not read. Empty tables give an empty result.
    """
    least = round(at_least * _PARTS)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.col("item_id").isNotNull()).distinct()
    pairs = checkpoint(candidates(docs, items, n, least))
    keyed = docs.select("doc_id", "text", *text_key(F.col("text")))
    wanted = items.withColumn("w", words_of(F.col("text"))).select("item_id", _shingles("w", n).alias("wanted"))
    suspects = keyed.join(broadcast_if_small(pairs), ["k1", "k2"]).withColumn("w", words_of(F.col("text")))
    compared = suspects.join(wanted, "item_id").select(
        "k1", "k2", "doc_id", "item_id", F.size("wanted").cast("bigint").alias("n_shingles"),
        F.size(F.array_intersect("wanted", _shingles("w", n))).cast("bigint").alias("n_found"),
    )
    # Checked behind the distinct: a filter before it would be copied into the lambdas.
    return compared.distinct().where((F.col("n_shingles") > 0) & (F.col("n_found") * _PARTS >= F.col("n_shingles") * least))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, at_least: float = 0.8, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text contains an item; same columns, all other rows, repeated ones too.

    Items are known by their texts; ids are not read, so an item without id counts.
    """
    named = items.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("item_id"), "text")
    found = find_contained(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), named, n, at_least)
    keys = checkpoint(found.select("k1", "k2").distinct())
    # Columns go by position, so none of their names meets a key's.
    inner = [f"c{i}" for i in range(len(docs.columns))]
    k1, k2 = text_key(F.col(inner[docs.columns.index(text)]))
    kept = docs.toDF(*inner).withColumns({"k1": k1, "k2": k2}).join(broadcast_if_small(keys), ["k1", "k2"], "left_anti")
    return kept.select(*inner).toDF(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and the documents that contain at least four fifths of their 5-word shingles."""
    found = find_contained(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment")).distinct()


QUERIES = {"op8_decontaminate": op8_decontaminate}

ORACLE_SQL = {"op8_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), d AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM dw
), b AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM bw
), sizes AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, b.item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM b JOIN d USING (s) JOIN sizes ON sizes.item_id = b.item_id
GROUP BY doc_id, b.item_id, n_shingles HAVING count(*) * 10 >= n_shingles * 8
"""}
