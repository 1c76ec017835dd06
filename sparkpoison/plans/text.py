"""Text and document queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkpoison.functions import catalogue as cat
from sparkpoison.functions.numeric import round_to
from sparkpoison.operators import rag, text as tx
from sparkpoison.plans.registry import query
from sparkpoison.plans.views import r

# ---- SQL building blocks -------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chars(table: str, text: str = "text") -> str:
    """CTE: one row per character with its position (1-based)."""
    return (
        f"chars AS (SELECT doc_id, unnest(string_split({text}, '')) AS ch, "
        f"unnest(range(1, length({text}) + 1)) AS pos FROM {table} WHERE length({text}) > 0)"
    )


_ENTROPY = """
ent AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy
        FROM (SELECT doc_id, ch, count(*) AS c FROM chars GROUP BY ALL) GROUP BY doc_id)"""


def _perplexity(chars: str, name: str) -> str:
    return f"""
{name}_u AS (SELECT doc_id, ch, count(*) AS u FROM {chars} GROUP BY ALL),
{name}_v AS (SELECT doc_id, count(*) AS v FROM {name}_u GROUP BY doc_id),
{name}_b AS (SELECT doc_id, ch, nx, count(*) AS c FROM (
    SELECT doc_id, ch, lead(ch) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM {chars}) WHERE nx IS NOT NULL GROUP BY ALL),
{name} AS (SELECT doc_id, pow(2, -(sum(c * log2((c + 1.0) / (u + v))) / sum(c))) AS ppl
  FROM {name}_b JOIN {name}_u USING (doc_id, ch) JOIN {name}_v USING (doc_id) GROUP BY doc_id)"""


_COHERENCE = """
shape AS (SELECT doc_id, text, length(text) AS len, least(256, length(text) // 4) AS w FROM docs WHERE length(text) >= 50),
starts AS (SELECT doc_id, w, unnest(range(0, len - w + 1, greatest(1, w // 2))) AS s FROM shape),
wc AS (SELECT starts.doc_id, s, ch, count(*) AS c FROM starts JOIN chars ON chars.doc_id = starts.doc_id
       AND chars.pos > s AND chars.pos <= s + w GROUP BY ALL),
we AS (SELECT doc_id, s, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM wc GROUP BY ALL),
coh AS (SELECT doc_id, CASE WHEN count(*) < 2 OR avg(e) < 1e-12 THEN 1.0
        ELSE greatest(0.0, 1.0 - stddev_pop(e) / avg(e)) END AS coherence FROM we GROUP BY doc_id)"""

_WINDOWS = """
wlen AS (SELECT doc_id, length(text) AS len FROM docs WHERE length(text) >= 256),
wst AS (SELECT doc_id, unnest(range(0, len - 255, 64)) AS s FROM wlen),
blk AS (SELECT doc_id, (pos - 1) // 64 AS b, ch, count(*) AS c FROM chars GROUP BY ALL),
wcc AS (SELECT wst.doc_id, s, ch, sum(c) AS c FROM wst JOIN blk ON blk.doc_id = wst.doc_id
        AND b BETWEEN s // 64 AND s // 64 + 3 GROUP BY ALL),
wee AS (SELECT doc_id, s, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM wcc GROUP BY ALL),
wst2 AS (SELECT doc_id, s, e, avg(e) OVER d AS m, stddev_pop(e) OVER d AS sd, count(*) OVER d AS n FROM wee
         WINDOW d AS (PARTITION BY doc_id)),
wout AS (SELECT doc_id, s, e, (e - m) / sd AS z FROM wst2 WHERE n >= 3 AND sd >= 1e-12 AND abs((e - m) / sd) > 2.5)"""

_NGRAMS = """
lchars AS (SELECT doc_id, unnest(string_split(lower(text), '')) AS ch, unnest(range(1, length(lower(text)) + 1)) AS pos
           FROM docs WHERE length(text) >= 50),
lead4 AS (SELECT doc_id, ch, lead(ch) OVER o AS c2, lead(ch, 2) OVER o AS c3, lead(ch, 3) OVER o AS c4
          FROM lchars WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
grams AS (SELECT doc_id, 2 AS n, ch || c2 AS g, count(*) AS c FROM lead4 WHERE c2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT doc_id, 3, ch || c2 || c3, count(*) FROM lead4 WHERE c3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT doc_id, 4, ch || c2 || c3 || c4, count(*) FROM lead4 WHERE c4 IS NOT NULL GROUP BY ALL),
gfreq AS (SELECT doc_id, n, g, c::DOUBLE / sum(c) OVER (PARTITION BY doc_id, n) AS f FROM grams),
gstat AS (SELECT *, avg(f) OVER d AS m, stddev_pop(f) OVER d AS sd, count(*) OVER d AS k FROM gfreq
          WINDOW d AS (PARTITION BY doc_id, n)),
gout AS (SELECT doc_id, n, g, f, m + 2 * sd AS hi, (f - m) / sd AS z FROM gstat
         WHERE k >= 5 AND sd >= 1e-12 AND (f - m) / sd > 3.0)"""


def _re2(pattern: str, fold: bool = True) -> str:
    return _q(("(?i)" if fold else "") + pattern)


def _class(points) -> str:
    return "[" + "".join(f"\\x{{{p:X}}}" for p in points) + "]"


def _count(pattern_literal: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, {pattern_literal}))"


def _present(patterns, text: str = "text") -> str:
    return " + ".join(f"CAST(regexp_matches({text}, {_re2(p)}) AS BIGINT)" for p in patterns)


def _edge_risk(e: str, p: str, h: str, i: str, b: str) -> str:
    return (
        f"least(greatest(0.15 * {e} + 0.15 * {p} + 0.20 * least({h} / 5.0, 1.0) + 0.30 * least({i} / 3.0, 1.0) "
        f"+ 0.20 * least({b} / 3.0, 1.0), 0.0), 1.0)"
    )


_BAND_E = "CASE WHEN entropy < 2 THEN least((2.0 - entropy) / 2.0, 1.0) WHEN entropy > 6 THEN least((entropy - 6.0) / 2.0, 1.0) ELSE 0.0 END"
_BAND_P = "CASE WHEN ppl <= 100 THEN 0.0 WHEN ppl >= 600 THEN 1.0 ELSE (ppl - 100.0) / 500.0 END"

# ---- queries -------------------------------------------------------------------------


@query("R-2 R-3", "documents", f"""
WITH {_chars("documents")}, {_ENTROPY}
SELECT doc_id, {r("entropy")} AS entropy, {r(_BAND_E)} AS band FROM ent""")
def text_entropy(documents: DataFrame) -> DataFrame:
    e = tx.char_entropy(documents)
    return e.select("doc_id", round_to("char_entropy", 6).alias("entropy"),
                    round_to(tx.entropy_band(F.col("char_entropy")), 6).alias("band"))


@query("R-4 R-5", "docs", f"""
WITH lc AS (SELECT doc_id, lower(text) AS text FROM docs), {_chars("lc")}, {_perplexity("chars", "pp")}
SELECT d.doc_id, {r("CASE WHEN length(d.text) < 3 THEN 1.0 ELSE ppl END")} AS perplexity,
  CASE WHEN length(d.text) >= 3 AND ppl > 80 THEN 1 ELSE 0 END AS is_high
FROM docs d LEFT JOIN pp USING (doc_id)""")
def text_perplexity(docs: DataFrame) -> DataFrame:
    p = tx.bigram_perplexity(docs)
    return p.select("doc_id", round_to("perplexity", 6).alias("perplexity"),
                    tx.perplexity_band(F.col("perplexity"), "service").cast("int").alias("is_high"))


@query("R-4 R-5", "documents", f"""
WITH {_chars("documents")}, {_perplexity("chars", "pp")}
SELECT doc_id, {r("ppl")} AS perplexity, {r(_BAND_P)} AS band FROM
  (SELECT doc_id, CASE WHEN length(text) < 2 THEN 0.0 ELSE ppl END AS ppl FROM documents LEFT JOIN pp USING (doc_id))""")
def text_perplexity_edge(documents: DataFrame) -> DataFrame:
    p = tx.bigram_perplexity(documents, "edge")
    return p.select("doc_id", round_to("perplexity", 6).alias("perplexity"),
                    round_to(tx.perplexity_band(F.col("perplexity")), 6).alias("band"))


@query("R-6", "documents", f"""
WITH {_chars("documents")},
big AS (SELECT doc_id, ch, nx, count(*) AS c FROM (SELECT doc_id, ch, lead(ch) OVER (PARTITION BY doc_id ORDER BY pos) AS nx
        FROM chars) WHERE nx IS NOT NULL GROUP BY ALL),
h AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM big GROUP BY doc_id)
SELECT d.doc_id, {r("least(coalesce(e, 0.0) / 6.0, 1.0)")} AS perplexity_score, coalesce(e, 0.0) / 6.0 < 0.15 AS is_low
FROM documents d LEFT JOIN h USING (doc_id)""")
def text_bigram_entropy(documents: DataFrame) -> DataFrame:
    return tx.bigram_entropy(documents).withColumn("perplexity_score", round_to("perplexity_score", 6))


@query("R-7", "documents", f"""
WITH docs AS (SELECT * FROM documents), {_chars("docs")}, {_COHERENCE}
SELECT d.doc_id, {r("coalesce(coherence, 1.0)")} AS coherence FROM documents d LEFT JOIN coh USING (doc_id)""")
def text_coherence(documents: DataFrame) -> DataFrame:
    return tx.coherence(documents).withColumn("coherence", round_to("coherence", 6))


@query("R-8", "docs", f"""
WITH {_chars("docs")}, {_WINDOWS}
SELECT doc_id, s AS "start", s + 256 AS "end", {r("e")} AS entropy, {r("z")} AS z_score,
  CASE WHEN abs(z) > 4 THEN 'high' ELSE 'medium' END AS severity FROM wout""")
def text_entropy_windows(docs: DataFrame) -> DataFrame:
    return tx.entropy_windows(docs).withColumns(
        {"entropy": round_to("entropy", 6), "z_score": round_to("z_score", 6)})


@query("R-9", "documents", f"""
WITH docs AS (SELECT * FROM documents), {_NGRAMS}
SELECT doc_id, n, g AS ngram, {r("f")} AS observed_freq, {r("hi")} AS expected_high, {r("z")} AS z_score FROM gout""")
def text_ngram_anomalies(documents: DataFrame) -> DataFrame:
    return tx.ngram_anomalies(documents).withColumns(
        {c: round_to(c, 6) for c in ("observed_freq", "expected_high", "z_score")})


def _lookalike_sql(table: dict[int, str]) -> str:
    rows = ", ".join(f"({_q(chr(p))}, {_q(a)}, 'U+{p:04X}')" for p, a in table.items())
    return f"""
WITH {_chars("docs")}, map(ch, lookalike, codepoint) AS (VALUES {rows})
SELECT doc_id, pos - 1 AS position, ch AS character, codepoint, lookalike FROM chars JOIN map USING (ch)"""


@query("R-10", "docs", _lookalike_sql(cat.HOMOGLYPHS))
def text_homoglyphs(docs: DataFrame) -> DataFrame:
    return tx.homoglyphs(docs)


@query("R-10", "docs", f"""
WITH {_chars("docs")},
hit AS (SELECT doc_id, pos - 1 AS pos, ch, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM chars
        WHERE ch IN ({", ".join(_q(chr(p)) for p in cat.EDGE_HOMOGLYPHS)}))
SELECT doc_id, count(*) AS count, string_agg(CASE WHEN k <= 50 THEN CAST(pos AS VARCHAR) END, ',' ORDER BY pos) AS positions,
  string_agg(CASE WHEN k <= 10 THEN '"' || ch || '" (U+' || upper(lpad(to_hex(unicode(ch)), 4, '0')) || ') at pos ' || pos END, '; ' ORDER BY pos) AS examples
FROM hit GROUP BY doc_id""")
def text_homoglyphs_edge(docs: DataFrame) -> DataFrame:
    return tx.homoglyph_summary(docs).select(
        "doc_id", "count", F.array_join("positions", ",").alias("positions"),
        F.array_join("examples", "; ").alias("examples"))


@query("R-11", "docs", f"""
WITH {_chars("docs")}, map(ch, name, codepoint) AS (VALUES {", ".join(f"({_q(chr(p))}, {_q(n)}, 'U+{p:04X}')" for p, n in cat.INVISIBLE.items())})
SELECT doc_id, pos - 1 AS position, codepoint, name AS decoded_content,
  CASE WHEN codepoint IN ({", ".join(f"'U+{p:04X}'" for p in cat.RTL_OVERRIDES)}) THEN 'rtl_override' ELSE 'zero_width' END AS instruction_type,
  CASE WHEN codepoint IN ({", ".join(f"'U+{p:04X}'" for p in cat.RTL_OVERRIDES)}) THEN 'high' ELSE 'medium' END AS severity
FROM chars JOIN map USING (ch)""")
def text_invisible_chars(docs: DataFrame) -> DataFrame:
    return tx.invisible_chars(docs)


@query("R-12", "docs", None)
def text_base64_payloads(docs: DataFrame) -> DataFrame:
    return tx.base64_payloads(docs)


@query("R-13", "docs", f"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, {_q(tx.EDGE_BASE64_RUN)}) AS runs FROM docs)
SELECT doc_id, len(runs) AS base64_count, array_to_string(list_transform(runs[1:5], lambda x:
  left(x, 60) || CASE WHEN length(x) > 60 THEN '…' ELSE '' END), ' ') AS samples FROM m""")
def text_base64_edge(docs: DataFrame) -> DataFrame:
    return tx.base64_payloads(docs, "edge").withColumn("samples", F.array_join("samples", " "))


def _hits_sql() -> str:
    parts = []
    for name, kind, severity, pattern, fold in cat.INJECTION_PATTERNS:
        gap = _q(f"((?s:.*?))({'(?i:' if fold else '(?:'}{pattern}))")
        parts.append(f"""
SELECT doc_id, {_q(name)} AS pattern, {_q(kind)} AS instruction_type, {_q(severity)} AS severity,
  regexp_extract_all(text, {gap}, 1) AS gaps, regexp_extract_all(text, {gap}, 2) AS hits
FROM docs WHERE regexp_matches(text, {_re2(pattern, fold)})""")
    return f"""
WITH raw AS ({" UNION ALL ".join(parts)}),
flat AS (SELECT doc_id, pattern, instruction_type, severity, unnest(range(1, len(hits) + 1)) AS nth, unnest(gaps) AS gap, unnest(hits) AS hit FROM raw)
SELECT doc_id, pattern, instruction_type, severity, nth, hit AS matched_text,
  sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, pattern ORDER BY nth) - length(hit) AS position FROM flat"""


@query("R-14", "docs", _hits_sql())
def text_injection_patterns(docs: DataFrame) -> DataFrame:
    return tx.pattern_hits(docs)


@query("R-14", "docs", f"""
SELECT doc_id, {_present(cat.EDGE_INJECTION_PATTERNS)} AS match_count,
  concat_ws('; ', {", ".join(f"CASE WHEN regexp_matches(text, {_re2(p)}) THEN left(regexp_extract(text, {_re2(p)}), 80) END" for p in cat.EDGE_INJECTION_PATTERNS)}) AS matched
FROM docs""")
def text_injection_edge(docs: DataFrame) -> DataFrame:
    return tx.edge_hidden_instructions(docs).withColumn("matched", F.array_join("matched", "; "))


def _attack_sql(deviation: str) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), {_q(w)})" for w in words) + f" THEN {_q(kind)}"
        for kind, words in cat.ATTACK_KEYWORDS.items())
    return f"CASE {arms} WHEN {deviation} > 0.6 THEN 'gradient_attack' END"


@query("R-15", "pages", f"""
WITH d AS (SELECT page_id AS doc_id, html AS text, CAST(page_id % 100 AS DOUBLE) / 100 AS dev FROM pages)
SELECT doc_id, {_attack_sql("dev")} AS attack_type FROM d""")
def text_attack_type(pages: DataFrame) -> DataFrame:
    dev = (F.col("page_id") % 100).cast("double") / 100
    return pages.select(F.col("page_id").alias("doc_id"), tx.attack_type("html", dev).alias("attack_type"))


def _heuristic_sql() -> str:
    parts = []
    for name, severity, options, need_all in cat.HEURISTICS:
        test = (" AND " if need_all else " OR ").join(
            f"regexp_matches(text, {_re2(p, fold)})" for p, fold in options)
        parts.append(f"SELECT doc_id, {_q(name)} AS type, {_q(severity)} AS severity FROM docs WHERE {test}")
    return " UNION ALL ".join(parts)


@query("R-16", "docs", _heuristic_sql())
def text_heuristics(docs: DataFrame) -> DataFrame:
    return tx.heuristics(docs)


@query("R-20", "documents", """
SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents
GROUP BY 1 HAVING count(*) > 1""")
def text_exact_copies(documents: DataFrame) -> DataFrame:
    return tx.exact_copies(documents)


_TAGS = r"[\x{E0020}-\x{E007E}]+"


@query("R-21", "docs", f"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, {_q(_TAGS)})) AS run,
  unnest(range(1, len(regexp_extract_all(text, {_q(_TAGS)})) + 1)) AS nth FROM docs)
SELECT doc_id, nth, length(run) AS length, array_to_string(list_transform(string_split(run, ''),
  lambda c: chr(unicode(c) - 917504)), '') AS decoded FROM runs""")
def text_tag_smuggling(docs: DataFrame) -> DataFrame:
    return tx.tag_smuggling(docs)


def _lexicon_sql() -> str:
    frames = " + ".join(f"CAST(contains(lower(text), {_q(f.lower())}) AS BIGINT)" for f in cat.HEARSAY_FRAMES)
    zero, one = ("|".join(p[i] for p in cat.SYNONYM_BINS) for i in (0, 1))
    z, o = (_count(_q(rf"\b({alt})\b"), "lower(text)") for alt in (zero, one))
    return f"""
WITH c AS (SELECT doc_id, {frames} AS hearsay_frames, {_count(_q(_class(cat.SEGMENTATION_EMOJIS)))} AS emojis,
  {z} AS codebook_zeros, {o} AS codebook_ones, {_count(_q(r"\S+"))} AS words FROM docs)
SELECT doc_id, hearsay_frames, emojis, codebook_zeros, codebook_ones,
  {r("CASE WHEN words > 0 THEN CAST(codebook_ones + codebook_zeros AS DOUBLE) / words ELSE 0 END")} AS codebook_rate FROM c"""


@query("R-22", "docs", _lexicon_sql())
def text_lexicons(docs: DataFrame) -> DataFrame:
    return tx.lexicon_rates(docs)


_SHINGLES = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT sh, count(*) AS k FROM s GROUP BY sh)"""


@query("R-23", "documents", f"""
WITH {_SHINGLES}
SELECT doc_id, count(*) AS shingles, count_if(k > 1) AS copied, max(k) AS widest,
  {r("count_if(k > 1)::DOUBLE / count(*)")} AS copied_share FROM s JOIN n USING (sh) GROUP BY doc_id""")
def text_copy_recurrence(documents: DataFrame) -> DataFrame:
    return tx.copy_recurrence(documents)


@query("R-23", "docs", " UNION ALL ".join(
    f"SELECT source, {_q(n)} AS pattern, count(*) AS documents FROM docs WHERE regexp_matches(text, {_re2(p, fold)}) GROUP BY source"
    for n, _, _, p, fold in cat.INJECTION_PATTERNS))
def text_pattern_recurrence(docs: DataFrame) -> DataFrame:
    return tx.pattern_recurrence(docs)


@query("R-23", "documents", f"""
WITH {_chars("documents")}, {_ENTROPY},
m AS (SELECT lang, doc_id // 100 AS generation, avg(entropy) AS mean, count(*) AS documents FROM ent JOIN documents USING (doc_id) GROUP BY ALL)
SELECT lang, generation, {r("mean")} AS mean, documents,
  {r("abs(mean - lag(mean) OVER (PARTITION BY lang ORDER BY generation))")} AS drift FROM m""")
def text_generation_drift(documents: DataFrame) -> DataFrame:
    stats = tx.char_entropy(documents).join(
        documents.select("doc_id", "lang", F.floor(F.col("doc_id") / 100).alias("generation")), "doc_id")
    out = tx.generation_drift(stats, "char_entropy", by=["lang"])
    return out.withColumns({"mean": round_to("mean", 6), "drift": round_to("drift", 6)})


@query("R-3 R-5 R-18", "docs", f"""
WITH {_chars("docs")}, {_ENTROPY}, {_perplexity("chars", "pp")},
f AS (SELECT d.doc_id, entropy, coalesce(ppl, 0) AS ppl, {_BAND_E} AS ea, {_BAND_P} AS pa,
  {_count(_q(_class(cat.EDGE_HOMOGLYPHS)))} AS h, {_present(cat.EDGE_INJECTION_PATTERNS)} AS i,
  {_count(_q(tx.EDGE_BASE64_RUN))} AS b FROM docs d JOIN ent USING (doc_id) LEFT JOIN pp USING (doc_id)),
s AS (SELECT *, {_edge_risk("ea", "pa", "h", "i", "b")} AS risk FROM f)
SELECT doc_id, {r("entropy")} AS entropy, {r("ppl")} AS perplexity, {r("ea")} AS entropy_anomaly, {r("pa")} AS perplexity_anomaly,
  h AS homoglyph_count, i AS hidden_instruction_count, b AS base64_count, {r("risk")} AS risk_score,
  CASE WHEN risk >= 0.6 THEN 'poisoned' WHEN risk >= 0.3 THEN 'suspicious' ELSE 'clean' END AS verdict FROM s""")
def rag_risk_edge(docs: DataFrame) -> DataFrame:
    out = rag.rag_scan(docs, "edge")
    return out.withColumns({c: round_to(c, 6) for c in
                            ("entropy", "perplexity", "entropy_anomaly", "perplexity_anomaly", "risk_score")})


@query("R-1 R-17", "docs vectors", None)
def rag_risk_service(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    from sparkpoison.operators import vectors as vc

    scored = rag.cosine_deviation(vectors.withColumnRenamed("vec_id", "doc_id"), vc.centroid(vectors))
    out = rag.service_scan(docs, scored.select("doc_id", "cosine_deviation"))
    return out.select(
        "doc_id", *[round_to(c, 6).alias(c) for c in ("cosine_deviation", "perplexity", "coherence", "risk_score")],
        "hidden", "homoglyphs", "entropy_anomalies", "ngram_anomalies",
        F.array_join("signals", ",").alias("signals"), "is_suspicious")


@query("R-19", "docs", f"""
WITH {_chars("docs")},
big AS (SELECT doc_id, ch, nx, count(*) AS c FROM (SELECT doc_id, ch, lead(ch) OVER (PARTITION BY doc_id ORDER BY pos) AS nx
        FROM chars) WHERE nx IS NOT NULL GROUP BY ALL),
h AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM big GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(d.doc_id % 100 AS DOUBLE) / 100 AS dev, least(coalesce(e, 0.0) / 6.0, 1.0) AS pp, text FROM docs d LEFT JOIN h USING (doc_id)),
s AS (SELECT *, {_attack_sql("dev")} AS attack FROM f),
k AS (SELECT *, least(CAST(0.5 AS DOUBLE) * dev + CAST(0.3 AS DOUBLE) * (1.0 - pp) + CASE WHEN attack IS NOT NULL THEN CAST(0.2 AS DOUBLE) ELSE 0 END, 1.0) AS risk FROM s)
SELECT doc_id, {r("dev")} AS cosine_deviation, {r("pp")} AS perplexity_score, attack AS attack_type,
  dev > CAST(1.0 AS DOUBLE) - CAST(0.85 AS DOUBLE) OR pp < 0.15 OR attack IS NOT NULL AS is_flagged, {r("risk")} AS risk_score,
  CASE WHEN risk >= 0.7 THEN 'poisoned' WHEN risk >= 0.3 THEN 'suspicious' ELSE 'clean' END AS verdict FROM k""")
def rag_risk_router(docs: DataFrame) -> DataFrame:
    dev = (F.col("doc_id") % 100).cast("double") / 100
    out = rag.rag_scan(docs.withColumn("dev", dev), "router", "dev")
    return out.withColumns({c: round_to(c, 6) for c in ("cosine_deviation", "perplexity_score", "risk_score")})
