"""Tool-registry queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkpoison.functions import catalogue as cat
from sparkpoison.functions.numeric import round_to
from sparkpoison.operators import mcp
from sparkpoison.operators.text import EDGE_BASE64_RUN
from sparkpoison.plans.registry import query
from sparkpoison.plans.views import r


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _count(patterns: list[str], column: str, flags: str = "(?i)") -> str:
    return " + ".join(f"len(regexp_extract_all({column}, {_q(flags + p)}))" for p in patterns)


def _class(points) -> str:
    return _q("[" + "".join(f"\\x{{{p:X}}}" for p in points) + "]")


def _present(patterns: list[str], column: str) -> str:
    return " + ".join(f"CAST(regexp_matches({column}, {_q('(?i)' + p)}) AS BIGINT)" for p in patterns)


_NODES = r"""
jt AS (SELECT t.tool_id, replace(j.fullkey, '"', '') AS path, j.type AS jtype, j.key AS jkey, json_extract_string(j.atom, '$') AS txt
  FROM tools t, json_tree(t.schema_json) j),
nodes AS (SELECT *, len(regexp_extract_all(path, '[.\[]')) AS level, len(regexp_extract_all(path, '\.')) AS dots FROM jt),
leaves AS (SELECT tool_id, '$.name' AS path, name AS txt FROM tools UNION ALL SELECT tool_id, '$.description', description FROM tools
  UNION ALL SELECT tool_id, '$.schema' || path[2:], txt FROM nodes WHERE jtype = 'VARCHAR'
  UNION ALL SELECT tool_id, '$.parameters' || path[13:], txt FROM nodes WHERE jtype = 'VARCHAR' AND starts_with(path, '$.properties.')),
specs AS (SELECT t.tool_id, p.key AS pname, p.value AS spec, coalesce(json_extract_string(p.value, '$.type'), '') AS typ, json_keys(p.value) AS ks
  FROM tools t, json_each(json_extract(t.schema_json, '$.properties')) p)"""

_HID, _BEH = _count(cat.TOOL_HIDDEN_PATTERNS, "description"), _count(cat.TOOL_BEHAVIOUR_PATTERNS, "description")
_INV = f"len(regexp_extract_all(txt, {_class(cat.INVISIBLE)}))"
_B64TOK = "list_filter(regexp_extract_all(txt, '[A-Za-z0-9+/=]+'), lambda x: regexp_full_match(x, '[A-Za-z0-9+/]{20,}={0,3}') AND length(x) % 4 = 0 AND NOT ends_with(x, '==='))"


def _has(keys: list[str]) -> str:
    return "list_has_any(ks, [" + ", ".join(_q(k) for k in keys) + "])"


_FINDINGS = f"""
dm AS (SELECT tool_id, name, length(description) AS n, {_HID} AS hid, {_BEH} AS beh, len(regexp_extract_all(description, {_class(cat.INVISIBLE)})) AS inv, description FROM tools),
fi AS (
SELECT tool_id, 'description_anomaly' AS category, CASE WHEN n <= 4000 THEN 'medium' ELSE 'high' END AS severity,
  (n > 2000)::INT + (inv > 0)::INT + (hid > 0)::INT + (beh > 0)::INT AS k FROM dm
UNION ALL SELECT tool_id, 'base64_payload', 'high', sum(len({_B64TOK})) FROM leaves GROUP BY tool_id
UNION ALL SELECT tool_id, 'hidden_instruction', 'critical', hid FROM dm
UNION ALL SELECT tool_id, 'behavioral_instruction', 'medium', beh FROM dm
UNION ALL SELECT tool_id, 'known_malicious_pattern', 'critical', {_present(cat.TOOL_NAME_PATTERNS, "name")} FROM dm
UNION ALL SELECT tool_id, 'invisible_unicode', 'high', count_if({_INV} > 0) FROM leaves GROUP BY tool_id
UNION ALL SELECT tool_id, 'schema_violation', 'medium', (coalesce(json_extract_string(schema_json, '$.type'), '') <> 'object')::INT FROM tools
UNION ALL SELECT tool_id, 'schema_violation', 'high', coalesce((json_extract(schema_json, '$.additionalProperties')::VARCHAR = 'true')::INT, 0) FROM tools
UNION ALL SELECT tool_id, 'schema_violation', 'high', count_if(regexp_full_match(path, '\\$(\\.properties\\.[^.]+){{6}}') AND jtype = 'OBJECT') FROM nodes GROUP BY tool_id
UNION ALL SELECT tool_id, 'depth_violation', 'high', (max(CASE WHEN jtype = 'OBJECT' THEN dots END) + max(CASE WHEN jtype = 'OBJECT' AND ends_with(path, ']') THEN 0 ELSE 0 END) > 5)::INT FROM nodes GROUP BY tool_id
UNION ALL SELECT tool_id, 'type_confusion', 'medium', sum((typ = 'string' AND {_has(mcp._NUMERIC_KEYS)})::INT + (typ IN ('integer', 'number') AND {_has(mcp._STRING_KEYS)})::INT + (typ <> 'array' AND {_has(mcp._ARRAY_KEYS)})::INT) FROM specs GROUP BY tool_id
UNION ALL SELECT tool_id, 'type_confusion', 'high', count_if(typ = 'integer' AND json_extract(spec, '$.enum') IS NOT NULL AND list_contains(list_transform(CAST(json_extract(spec, '$.enum') AS JSON[]), lambda v: json_type(v)), 'VARCHAR')) FROM specs GROUP BY tool_id
UNION ALL SELECT tool_id, 'rug_pull_indicator', 'critical', count_if(jkey = '$ref' AND (starts_with(txt, 'http://') OR starts_with(txt, 'https://'))) + count_if(jkey = 'default' AND regexp_matches(txt, {_q("(?i)(" + "|".join(cat.EXECUTABLE_DEFAULTS) + ")")})) FROM nodes GROUP BY tool_id
UNION ALL SELECT b.tool_id, 'rug_pull_indicator', 'high', count(*) FROM nodes b WHERE b.jtype = 'OBJECT' AND regexp_matches(b.path, '(oneOf|anyOf)\\[\\d+\\]$')
  AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.tool_id = b.tool_id AND c.path IN (b.path || '.type', b.path || '.properties', b.path || '.$ref')) GROUP BY b.tool_id),
fs AS (SELECT tool_id, category, severity, sum(k)::BIGINT AS findings FROM fi GROUP BY ALL HAVING sum(k) > 0)"""


@query("M-0", "tools", f"""
WITH {_NODES} SELECT tool_id, path, level, CASE jtype WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'integer' END AS kind,
  CASE WHEN jtype = 'VARCHAR' THEN txt END AS text FROM nodes""")
def tool_schema_nodes(tools: DataFrame) -> DataFrame:
    return mcp.flatten_schema(tools).select("tool_id", "path", "level", "kind", "text")


@query("M-1 M-2 M-3 M-4 M-5 M-6 M-7 M-8 M-9 M-10 M-11", "tools", f"WITH {_NODES}, {_FINDINGS} SELECT * FROM fs")
def tool_findings(tools: DataFrame) -> DataFrame:
    return mcp.audit_findings(tools).groupBy("tool_id", "category", "severity").agg(F.count("*").alias("findings"))


@query("M-12", "tools", f"""
WITH {_NODES}, {_FINDINGS},
c AS (SELECT t.tool_id, t.name, coalesce(sum(findings), 0)::BIGINT AS n, coalesce(sum(CASE WHEN severity = 'critical' THEN findings END), 0)::BIGINT AS cr,
  coalesce(sum(CASE WHEN severity = 'high' THEN findings END), 0)::BIGINT AS hi, coalesce(sum(CASE WHEN severity = 'medium' THEN findings END), 0)::BIGINT AS me
  FROM tools t LEFT JOIN fs USING (tool_id) GROUP BY ALL),
k AS (SELECT *, {r("tanh(CAST(0.4 AS DOUBLE) * cr + CAST(0.2 AS DOUBLE) * hi + CAST(0.08 AS DOUBLE) * me)", 4)} AS risk FROM c)
SELECT tool_id, name, risk AS risk_score, n AS total_findings, cr AS critical_count, hi AS high_count, CASE WHEN cr > 0 THEN 'REJECT -- critical security findings'
  WHEN hi >= 3 THEN 'REJECT -- multiple high-severity findings' WHEN risk > 0.7 THEN 'REJECT -- high composite risk score'
  WHEN risk > 0.4 THEN 'REVIEW -- moderate risk, manual inspection recommended' WHEN n > 0 THEN 'CAUTION -- minor findings detected' ELSE 'PASS -- no findings' END AS verdict FROM k""")
def tool_report(tools: DataFrame) -> DataFrame:
    return mcp.audit_report(tools)


@query("M-13", "tools", f"""
WITH {_NODES},
p AS (SELECT tool_id, string_agg(txt, ' ' ORDER BY path) AS ptext FROM nodes WHERE jtype = 'VARCHAR' GROUP BY tool_id),
d AS (SELECT tool_id, max(level) AS depth FROM nodes GROUP BY tool_id),
c AS (SELECT t.tool_id, name, length(description) AS dl, len(regexp_extract_all(description, {_q(EDGE_BASE64_RUN)})) + len(regexp_extract_all(schema_json, {_q(EDGE_BASE64_RUN)})) AS b,
  {_present(cat.EDGE_TOOL_PATTERNS, "description")} + {_present(cat.EDGE_TOOL_PATTERNS, "coalesce(ptext, '')")} AS h, depth,
  coalesce(len(json_keys(schema_json, '$.properties')), 0) AS pc,
  len(regexp_extract_all(description, {_class(cat.EDGE_INVISIBLE)})) + len(regexp_extract_all(schema_json, {_class(cat.EDGE_INVISIBLE)})) AS iv
  FROM tools t LEFT JOIN p USING (tool_id) LEFT JOIN d USING (tool_id)),
k AS (SELECT *, least(greatest(CAST(0.3 AS DOUBLE) * CASE WHEN dl > 2000 THEN least((dl - 2000) / 3000.0, 1.0) ELSE 0 END + CAST(0.25 AS DOUBLE) * least(b / 3.0, 1.0)
  + CAST(0.25 AS DOUBLE) * least(h / 3.0, 1.0) + CAST(0.1 AS DOUBLE) * greatest(CASE WHEN depth > 5 THEN least((depth - 5) / 5.0, 1.0) ELSE 0 END, CASE WHEN pc > 50 THEN least((pc - 50) / 50.0, 1.0) ELSE 0 END)
  + CAST(0.1 AS DOUBLE) * least(iv / 5.0, 1.0), 0.0), 1.0) AS risk FROM c)
SELECT tool_id, name, dl AS description_length, b AS base64_count, h AS hidden_count, depth AS schema_depth, pc AS param_count, iv AS invisible_count, {r("risk")} AS risk_score,
  CASE WHEN risk >= 0.5 THEN 'malicious' WHEN risk >= 0.2 THEN 'suspicious' ELSE 'clean' END AS verdict FROM k""")
def tool_report_edge(tools: DataFrame) -> DataFrame:
    return mcp.audit_report(tools, "edge").withColumn("risk_score", round_to("risk_score", 6))


_LEAF = "count_if(jtype NOT IN ('OBJECT', 'ARRAY')) + count_if(hollow)"


@query("M-14", "tools", f"""
WITH {_NODES},
hn AS (SELECT n.*, n.jtype = 'OBJECT' AND NOT EXISTS (SELECT 1 FROM nodes m WHERE m.tool_id = n.tool_id AND m.jtype <> 'ARRAY'
  AND (starts_with(m.path, n.path || '.') OR starts_with(m.path, n.path || '['))) AS hollow FROM nodes n),
lf AS (SELECT tool_id, max(level) AS depth, (count_if(level > 0 AND jtype NOT IN ('OBJECT', 'ARRAY')) + count_if(level > 0 AND hollow))
  + (count_if(starts_with(path, '$.properties.') AND jtype NOT IN ('OBJECT', 'ARRAY')) + count_if(starts_with(path, '$.properties.') AND hollow)) AS fc FROM hn GROUP BY tool_id),
tk AS (SELECT *, list_filter(regexp_split_to_array(description, '\\s+'), lambda x: x <> '') AS w FROM tools),
c AS (SELECT tk.tool_id, name, length(description) AS dl, len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z0-9+/]{{20,}}={{0,2}}'))) / len(w) AS ratio,
  {_count(cat.ROUTER_TOOL_PATTERNS, "description", "(?is)")} AS h, depth, fc FROM tk JOIN lf USING (tool_id)),
k AS (SELECT *, least(CASE WHEN dl > 2000 THEN least(CAST(0.2 AS DOUBLE), CAST(0.2 AS DOUBLE) * (dl - 2000) / 2000) ELSE 0 END + CASE WHEN ratio >= 0.3 THEN least(CAST(0.35 AS DOUBLE), ratio) ELSE 0 END
  + CAST(0.4 AS DOUBLE) * h + CASE WHEN depth > 5 THEN least(CAST(0.15 AS DOUBLE), CAST(0.15 AS DOUBLE) * depth / 5) ELSE 0 END
  + CASE WHEN fc > 50 THEN least(CAST(0.1 AS DOUBLE), CAST(0.1 AS DOUBLE) * fc / 50) ELSE 0 END, 1.0) AS risk FROM c)
SELECT tool_id, name, dl AS description_length, {r("ratio")} AS base64_ratio, h AS hidden_count, depth AS schema_depth, fc AS field_count, {r("risk")} AS risk_score,
  CASE WHEN risk >= 0.7 OR h > 0 THEN 'critical' WHEN risk >= 0.3 THEN 'warning' ELSE 'safe' END AS verdict FROM k""")
def tool_report_router(tools: DataFrame) -> DataFrame:
    out = mcp.audit_report(tools, "router")
    return out.withColumns({c: round_to(c, 6) for c in ("base64_ratio", "risk_score")})


@query("M-15", "registry_old registry_new", """
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM registry_old a FULL JOIN registry_new b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.description <> b.description OR a.schema_json <> b.schema_json""")
def tool_registry_diff(registry_old: DataFrame, registry_new: DataFrame) -> DataFrame:
    return mcp.registry_diff(registry_old, registry_new)
