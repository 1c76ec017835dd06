"""Audit of a tool registry: every schema is flattened once, every check is a filter on its nodes.

``tools(tool_id, name, description, schema_json)``; a tool's parameters are its schema's
``properties``. Flattening happens inside the tool's row, so nothing is shuffled: JSON of
unknown depth is walked by a small Arrow-batched helper, and the checks are column expressions.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkpoison.functions import catalogue as cat
from sparkpoison.functions.numeric import banded, cap1, clip01, round_to, share
from sparkpoison.operators import text as tx

MAX_DESCRIPTION = 2000
MAX_DEPTH = 5
MAX_FIELDS = 50

# --- fixed values: schema keywords
_NUMERIC_KEYS = ["minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"]
_STRING_KEYS = ["minLength", "maxLength", "pattern", "format"]
_ARRAY_KEYS = ["minItems", "maxItems", "uniqueItems", "items"]
_SEVERITY_WEIGHTS = {"critical": 0.40, "high": 0.20, "medium": 0.08, "low": 0.03}


# --------------------------------------------------------------------------- flattening

_NODE = (
    "path string, parent string, key string, level int, depth int, role string, sdepth int, kind string, "
    "text string, keys array<string>, top string, hollow boolean"
)


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (shape == "VOID"), "null").when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean")
        .when(shape == "BIGINT", "integer").otherwise("number")
    )


def _as_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _json_kind(value: object) -> str:
    for kind, test in (("object", dict), ("array", list), ("string", str), ("boolean", bool), ("integer", int)):
        if isinstance(value, test):
            return kind
    return "null" if value is None else "number"


def _place(parent: dict, key: str | None, kind: str) -> dict:
    """Depths of a child: ``depth`` counts objects only, ``role``/``sdepth`` follow schema keywords."""
    holder = parent["kind"]
    if parent["depth"] < 0 or (kind == "array" and holder == "array"):
        depth = -1
    else:
        depth = parent["depth"] + (kind == "object")
    role, is_object = "none", kind == "object"
    if parent["role"] == "schema" and key == "properties" and is_object:
        role = "props"
    elif parent["role"] == "schema" and key in ("oneOf", "anyOf", "allOf") and kind == "array":
        role = "list"
    elif is_object and (parent["role"] in ("props", "list") or (parent["role"] == "schema" and key in ("items", "additionalProperties"))):
        role = "schema"
    return {"depth": depth, "role": role, "sdepth": parent["sdepth"] + (role == "schema")}


def _walk(document: str | None) -> list[dict] | None:
    """Every node of one JSON document, parents before children; null when it does not parse."""
    try:
        value = json.loads(document)
    except (TypeError, ValueError, RecursionError):
        return None
    root = {"path": "$", "parent": None, "key": None, "level": 0, "depth": 0, "role": "schema", "sdepth": 0,
            "kind": _json_kind(value), "top": None}
    nodes, waiting = [], [(root, value)]
    while waiting:
        node, value = waiting.pop()
        node["text"] = value if isinstance(value, str) else None
        node["keys"] = list(value) if isinstance(value, dict) else None
        nodes.append(node)
        if isinstance(value, dict):
            below = [(k, f"{node['path']}.{k}", v) for k, v in value.items()]
        elif isinstance(value, list):
            below = [(node["key"], f"{node['path']}[{i}]", v) for i, v in enumerate(value)]
        else:
            continue
        for key, path, v in below:
            kind = _json_kind(v)
            child = {"path": path, "parent": node["path"], "key": key, "level": node["level"] + 1, "kind": kind,
                     "top": node["top"] or key, **_place(node, key, kind)}
            waiting.append((child, v))
    # An object is hollow when nothing but empty lists is below it.
    by_path, filled = {n["path"]: n for n in nodes}, set()
    for node in nodes:
        up = node["parent"] if node["kind"] != "array" else None
        while up is not None and up not in filled:
            filled.add(up)
            up = by_path[up]["parent"]
    for node in nodes:
        node["hollow"] = node["kind"] == "object" and node["path"] not in filled
    return nodes


def _walk_batch(documents: pa.Array) -> pa.Array:
    fields = [tuple(f.strip().split(" ")) for f in _NODE.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
    node = pa.struct([(n, kinds[t]) for n, t in fields])
    return pa.array([_walk(d) for d in documents.to_pylist()], pa.list_(node))


def with_nodes(tools: DataFrame, column: str = "schema_json") -> DataFrame:
    """Adds ``schema`` (parsed) and ``nodes``, the array of all its nodes at any depth."""
    walk = F.arrow_udf(_walk_batch, f"array<struct<{_NODE.replace(' ', ':').replace(',:', ',')}>>")
    nodes = F.coalesce(walk(column), F.array().cast(f"array<struct<{_NODE.replace(' ', ':').replace(',:', ',')}>>"))
    return tools.withColumn("schema", F.try_parse_json(column)).withColumn("nodes", nodes)


def flatten_schema(tools: DataFrame) -> DataFrame:
    """One row per schema node: path, parent, key, level, depths, kind, string value."""
    return tx.each(with_nodes(tools), ["tool_id"], F.col("nodes"), "n").select("tool_id", "n.*").drop("top")


def _leaves() -> Column:
    """Array of (path, text): the tool's name, description, schema strings and parameter strings."""
    strings = F.filter("nodes", lambda n: n["kind"] == "string")
    pair = lambda path, text: F.struct(path.alias("path"), text.alias("text"))
    schema = F.transform(strings, lambda n: pair(F.concat(F.lit("$.schema"), F.substr(n["path"], F.lit(2))), n["text"]))
    params = F.transform(
        F.filter(strings, lambda n: n["path"].startswith("$.properties.")),
        lambda n: pair(F.concat(F.lit("$.parameters"), F.substr(n["path"], F.lit(13))), n["text"]),
    )
    own = F.array(pair(F.lit("$.name"), F.col("name")), pair(F.lit("$.description"), F.col("description")))
    return F.concat(own, schema, params)


# --------------------------------------------------------------------------- findings

def _finding(category: str, severity: Column | str, description: Column, path: Column | str, evidence: Column | None = None) -> Column:
    return F.struct(
        F.lit(category).alias("category"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        description.alias("description"), (F.lit(path) if isinstance(path, str) else path).alias("field_path"),
        (evidence if evidence is not None else F.lit("")).alias("evidence"),
    )


def _matches(patterns: list[str], text: str, make) -> Column:
    return F.concat(*[
        F.transform(F.regexp_extract_all(text, F.lit(tx.java_regex(p)), F.lit(0)), make) for p in patterns
    ])


def _description_findings() -> Column:
    text = F.col("description")
    n = F.length(text)
    hidden = tx.match_count("description", [(p, True) for p in cat.TOOL_HIDDEN_PATTERNS])
    directives = tx.match_count("description", [(p, True) for p in cat.TOOL_BEHAVIOUR_PATTERNS])
    invisible = tx.count_points("description", cat.INVISIBLE)
    newlines = n - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    severity = F.when(n <= 2 * MAX_DESCRIPTION, "medium").otherwise("high")
    reasons = F.array_compact(F.array(
        F.when(n > MAX_DESCRIPTION, F.format_string(f"Description length %d exceeds maximum {MAX_DESCRIPTION}", n)),
        F.when(invisible > 0, F.format_string("%d invisible Unicode characters detected", invisible)),
        F.when(hidden > 0, F.format_string("%d hidden instruction patterns detected", hidden)),
        F.when(directives > 0, F.format_string("%d behavioral directives detected", directives)),
        F.when((newlines / F.greatest(n, F.lit(1)) > 0.3) & (n > 100), F.lit("Excessive newlines suggest content-hiding padding")),
    ))
    return F.transform(reasons, lambda r: _finding("description_anomaly", severity, r, "description"))


def _payload_findings() -> Column:
    found = F.transform(F.col("leaves"), lambda leaf: F.transform(
        tx.payload_list(leaf["text"]),
        lambda p: _finding(
            "base64_payload", "high",
            F.concat(F.lit("Base64 payload in "), leaf["path"], F.lit(": "), F.substring(p["decoded"], 1, 60)),
            leaf["path"], F.substring(p["candidate"], 1, 80),
        ),
    ))
    return F.flatten(found)


def _invisible_findings() -> Column:
    count = lambda text: F.regexp_count(text, F.lit(cat.char_class(cat.INVISIBLE)))
    return F.transform(
        F.filter("leaves", lambda leaf: count(leaf["text"]) > 0),
        lambda leaf: _finding(
            "invisible_unicode", "high",
            F.format_string("%d invisible Unicode characters in %s", count(leaf["text"]), leaf["path"]), leaf["path"],
        ),
    )


def _structure_findings() -> Column:
    """Root type, field count, open schema, structural depth, object depth."""
    kind = F.coalesce(F.try_variant_get("schema", "$.type", "string"), F.lit("missing"))
    fields = F.coalesce(F.size(F.try_variant_get("schema", "$.properties", "map<string,variant>")), F.lit(0))
    is_open = F.col("schema").isNotNull() & (_kind(F.try_variant_get("schema", "$.additionalProperties", "variant")) == "boolean") & (
        F.try_variant_get("schema", "$.additionalProperties", "boolean")
    )
    depth = F.array_max(F.transform(F.filter("nodes", lambda n: n["kind"] == "object"), lambda n: n["depth"]))
    single = F.array_compact(F.array(
        F.when(kind != "object", _finding(
            "schema_violation", "medium",
            F.concat(F.lit("MCP tool schema root must be 'object', got '"), kind, F.lit("'")), "$")),
        F.when(fields > MAX_FIELDS, _finding(
            "schema_violation", "medium",
            F.format_string(f"Schema has %d fields, exceeding limit of {MAX_FIELDS}", fields), "$.properties")),
        F.when(is_open, _finding(
            "schema_violation", "high",
            F.lit("Schema allows arbitrary additional properties -- potential injection vector"), "$.additionalProperties")),
        F.when(depth > MAX_DEPTH, _finding(
            "depth_violation", "high",
            F.format_string(f"Schema nesting depth %d exceeds limit {MAX_DEPTH}", depth), "schema")),
    ))
    deep = F.transform(
        F.filter("nodes", lambda n: (n["role"] == "schema") & (n["sdepth"] == MAX_DEPTH + 1)),
        lambda n: _finding(
            "schema_violation", "high",
            F.lit(f"Schema depth {MAX_DEPTH + 1} exceeds limit {MAX_DEPTH}"), n["path"]),
    )
    return F.concat(single, deep)


def _type_findings() -> Column:
    """Constraints or enum values at odds with a parameter's declared type."""
    params = F.map_entries(F.try_variant_get("schema", "$.properties", "map<string,variant>"))
    specs = F.filter(params, lambda e: _kind(e["value"]) == "object")

    def check(e: Column) -> Column:
        spec, name = e["value"], e["key"]
        keys = F.map_keys(_as_map(spec))
        declared = F.coalesce(F.try_variant_get(spec, "$.type", "string"), F.lit(""))
        clash = lambda known: F.array_sort(F.array_intersect(keys, F.array(*map(F.lit, known))))
        where = F.concat(F.lit("parameters."), name)

        def constraint(test: Column, known: list[str], label: str) -> Column:
            text = F.concat(F.lit("Parameter '"), name, F.lit("' declared as "), declared, F.lit(f" but has {label} constraints: "),
                            F.array_join(clash(known), ", "))
            return F.when(test & (F.size(clash(known)) > 0), _finding("type_confusion", "medium", text, where))

        kinds = F.transform(F.try_variant_get(spec, "$.enum", "array<variant>"), _kind)
        allowed = (
            F.when(declared == "string", F.array(F.lit("string")))
            .when(declared == "integer", F.array(F.lit("integer"), F.lit("boolean")))
            .when(declared == "number", F.array(F.lit("integer"), F.lit("number"), F.lit("boolean")))
            .when(declared == "boolean", F.array(F.lit("boolean")))
        )
        wrong = F.size(F.array_except(kinds, allowed)) > 0
        enum = F.when(allowed.isNotNull() & kinds.isNotNull() & wrong, _finding(
            "type_confusion", "high",
            F.concat(F.lit("Parameter '"), name, F.lit("' enum contains values incompatible with declared type '"), declared, F.lit("'")),
            F.concat(where, F.lit(".enum"))))
        return F.array_compact(F.array(
            constraint(declared == "string", _NUMERIC_KEYS, "numeric"),
            constraint(declared.isin("integer", "number"), _STRING_KEYS, "string"),
            constraint(declared != "array", _ARRAY_KEYS, "array"), enum,
        ))

    return F.flatten(F.transform(specs, check))


def _rug_pull_findings() -> Column:
    """External references, branches that accept anything, executable defaults."""
    alive = lambda n: (n["depth"] >= 0) & (n["depth"] <= 20)
    outside = F.transform(
        F.filter("nodes", lambda n: alive(n) & (n["key"] == "$ref") & ~n["path"].endswith("]")
                 & (n["text"].startswith("http://") | n["text"].startswith("https://"))),
        lambda n: _finding("rug_pull_indicator", "critical",
                           F.concat(F.lit("External $ref '"), F.substring(n["text"], 1, 100), F.lit("' -- schema content can change after approval")),
                           n["parent"]),
    )
    bare = ["type", "properties", "$ref"]
    wildcard = F.transform(
        F.filter("nodes", lambda n: (n["kind"] == "object") & alive(n) & n["key"].isin("oneOf", "anyOf") & n["path"].endswith("]")
                 & ~F.arrays_overlap(n["keys"], F.array(*map(F.lit, bare)))),
        lambda n: _finding("rug_pull_indicator", "high",
                           F.concat(F.lit("Unconstrained branch in "), n["key"], F.lit(" -- accepts any input")), n["path"]),
    )
    runs = "(?i)(" + "|".join(cat.EXECUTABLE_DEFAULTS) + ")"
    default = F.transform(
        F.filter("nodes", lambda n: alive(n) & (n["key"] == "default") & ~n["path"].endswith("]") & n["text"].rlike(runs)),
        lambda n: _finding("rug_pull_indicator", "critical",
                           F.concat(F.lit("Default value contains executable pattern: '"), F.substring(n["text"], 1, 60), F.lit("'")), n["path"]),
    )
    return F.concat(outside, wildcard, default)


def _name_findings() -> Column:
    return F.array_compact(F.array(*[
        F.when(F.col("name").rlike(tx.java_regex(p)), _finding(
            "known_malicious_pattern", "critical",
            F.concat(F.lit("Tool name '"), F.col("name"), F.lit("' matches known malicious pattern")), "name", F.col("name")))
        for p in cat.TOOL_NAME_PATTERNS
    ]))


def with_findings(tools: DataFrame) -> DataFrame:
    """Adds ``findings``, the array of everything the ten checks report about a tool."""
    hidden = _matches(cat.TOOL_HIDDEN_PATTERNS, "description", lambda m: _finding(
        "hidden_instruction", "critical", F.concat(F.lit("Suspicious instruction pattern: '"), m, F.lit("'")), "description", m))
    directives = _matches(cat.TOOL_BEHAVIOUR_PATTERNS, "description", lambda m: _finding(
        "behavioral_instruction", "medium", F.concat(F.lit("Behavioral directive: '"), F.substring(m, 1, 80), F.lit("'")),
        "description", F.substring(m, 1, 120)))
    flat = with_nodes(tools).withColumn("leaves", _leaves())
    parts = [_description_findings(), _payload_findings(), hidden, _structure_findings(), _type_findings(),
             _invisible_findings(), directives, _name_findings(), _rug_pull_findings()]
    empty = F.slice(_name_findings(), 1, 0)
    return flat.withColumn("findings", F.concat(*[F.coalesce(p, empty) for p in parts])).drop("leaves")


def audit_findings(tools: DataFrame) -> DataFrame:
    """One row per finding of every tool."""
    return tx.each(with_findings(tools), ["tool_id", "name"], F.col("findings"), "f").select("tool_id", "name", "f.*")


# --------------------------------------------------------------------------- reports

def audit_report(tools: DataFrame, profile: str = "service") -> DataFrame:
    """One row per tool with counts, risk and verdict; everything is computed in the tool's own row."""
    return {"service": _service, "edge": _edge, "router": _router}[profile](tools)


def _service(tools: DataFrame) -> DataFrame:
    of = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s))
    counts = with_findings(tools).select("tool_id", "name", F.size("findings").alias("n"), *[of(s).alias(s) for s in _SEVERITY_WEIGHTS])
    raw = sum((F.col(s) * w for s, w in _SEVERITY_WEIGHTS.items()), F.lit(0.0))
    verdict = (
        F.when(F.col("critical") > 0, "REJECT -- critical security findings")
        .when(F.col("high") >= 3, "REJECT -- multiple high-severity findings")
        .when(F.col("risk_score") > 0.7, "REJECT -- high composite risk score")
        .when(F.col("risk_score") > 0.4, "REVIEW -- moderate risk, manual inspection recommended")
        .when(F.col("n") > 0, "CAUTION -- minor findings detected").otherwise("PASS -- no findings")
    )
    return counts.withColumn("risk_score", round_to(F.tanh(raw), 4)).select(
        "tool_id", "name", "risk_score", verdict.alias("verdict"), F.col("n").cast("bigint").alias("total_findings"),
        F.col("critical").cast("bigint").alias("critical_count"), F.col("high").cast("bigint").alias("high_count"),
    )


def _edge(tools: DataFrame) -> DataFrame:
    words = F.array_sort(F.transform(F.filter("nodes", lambda n: n["kind"] == "string"), lambda n: F.struct(n["path"], n["text"])))
    df = with_nodes(tools).withColumn("param_text", F.array_join(F.transform(words, lambda w: w["text"]), " "))
    base64 = sum(F.regexp_count(c, F.lit(tx.EDGE_BASE64_RUN)) for c in ("description", "schema_json"))
    hidden = sum(tx.pattern_count(c, cat.EDGE_TOOL_PATTERNS) for c in ("description", "param_text"))
    invisible = sum(tx.count_points(c, cat.EDGE_INVISIBLE) for c in ("description", "schema_json"))
    counts = df.select(
        "tool_id", "name", F.length("description").cast("bigint").alias("description_length"),
        base64.cast("bigint").alias("base64_count"), hidden.cast("bigint").alias("hidden_count"),
        F.coalesce(F.array_max(F.transform("nodes", lambda n: n["level"])), F.lit(0)).cast("bigint").alias("schema_depth"),
        F.coalesce(F.size(F.try_variant_get("schema", "$.properties", "map<string,variant>")), F.lit(0)).cast("bigint").alias("param_count"),
        invisible.cast("bigint").alias("invisible_count"),
    )
    over = lambda c, limit, scale: F.when(F.col(c) > limit, cap1((F.col(c) - limit) / scale)).otherwise(0.0)
    risk = clip01(
        0.30 * over("description_length", MAX_DESCRIPTION, 3000.0) + 0.25 * cap1(F.col("base64_count") / 3.0)
        + 0.25 * cap1(F.col("hidden_count") / 3.0)
        + 0.10 * F.greatest(over("schema_depth", MAX_DEPTH, 5.0), over("param_count", 50, 50.0))
        + 0.10 * cap1(F.col("invisible_count") / 5.0)
    )
    return counts.withColumn("risk_score", risk).withColumn(
        "verdict", banded(F.col("risk_score"), (0.5, "malicious"), (0.2, "suspicious"), otherwise="clean")
    )


def leaf_fields(nodes: Column) -> Column:
    """Scalars, plus objects that hold no more than empty lists."""
    return F.size(F.filter(nodes, lambda n: n["hollow"] | ~n["kind"].isin("object", "array")))


def _router(tools: DataFrame) -> DataFrame:
    df = with_nodes(tools)
    params = F.coalesce(F.map_keys(F.try_variant_get("schema", "$.properties", "map<string,variant>")), F.array().cast("array<string>"))
    # Parameters are laid over the schema's own keys before fields are counted.
    kept = F.filter("nodes", lambda n: (n["level"] > 0) & ~F.array_contains(params, n["top"]))
    inner = F.filter("nodes", lambda n: n["path"].startswith("$.properties."))
    tokens = F.filter(F.split("description", r"\s+"), lambda w: w != "")
    coded = F.filter(tokens, lambda w: w.rlike(r"^[A-Za-z0-9+/]{20,}={0,2}$"))
    hits = sum((F.regexp_count("description", F.lit("(?is)" + p)) for p in cat.ROUTER_TOOL_PATTERNS), F.lit(0))
    counts = df.select(
        "tool_id", "name", F.length("description").cast("bigint").alias("description_length"),
        share(F.size(coded), F.size(tokens)).alias("base64_ratio"), hits.cast("bigint").alias("hidden_count"),
        F.coalesce(F.array_max(F.transform("nodes", lambda n: n["level"])), F.lit(0)).cast("bigint").alias("schema_depth"),
        (leaf_fields(kept) + leaf_fields(inner)).cast("bigint").alias("field_count"),
    )
    length, ratio, depth, fields = (F.col(c) for c in ("description_length", "base64_ratio", "schema_depth", "field_count"))
    some = lambda test, value: F.when(test, value).otherwise(0.0)
    risk = cap1(
        some(length > MAX_DESCRIPTION, F.least(F.lit(0.2), 0.2 * (length - MAX_DESCRIPTION) / MAX_DESCRIPTION))
        + some(ratio >= 0.3, F.least(F.lit(0.35), ratio)) + 0.4 * F.col("hidden_count")
        + some(depth > MAX_DEPTH, F.least(F.lit(0.15), 0.15 * depth / MAX_DEPTH))
        + some(fields > MAX_FIELDS, F.least(F.lit(0.1), 0.1 * fields / MAX_FIELDS))
    )
    verdict = F.when((F.col("risk_score") >= 0.7) | (F.col("hidden_count") > 0), "critical").when(F.col("risk_score") >= 0.3, "warning")
    return counts.withColumn("risk_score", risk).withColumn("verdict", verdict.otherwise("safe"))


def registry_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tools added, removed or modified between two snapshots ``(name, description, schema_json)``."""
    stamp = F.sha2(F.concat_ws("\x1f", F.coalesce("description", F.lit("")), F.coalesce("schema_json", F.lit(""))), 256)
    a = old.select("name", stamp.alias("before"))
    b = new.select("name", stamp.alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified")
    return a.join(b, "name", "full_outer").withColumn("change", change).where(F.col("change").isNotNull()).select("name", "change")
