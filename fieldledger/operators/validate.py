"""JSON Schema (a draft-07 subset) compiled to Columns: each raw JSON text gets its list of errors.

A schema with a keyword the compiler cannot enforce is refused, never half applied. Raw text is
parsed once into a VARIANT, so integers, numbers, strings, booleans, objects, arrays and null
stay apart (true is no integer, 3.5 is no integer). A wrong type hides further errors at its
place. Errors are 'path: what', in the order of the schema. Null or unreadable text is one error.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = {
    "type", "enum", "const", "minLength", "maxLength", "pattern", "format", "minimum", "maximum", "required", "properties", "additionalProperties",
    "items", "minItems", "maxItems", "$ref", "definitions", "$schema", "$id", "title", "description", "default",
}
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
DAY = r"^\d{4}-\d{2}-\d{2}$"


class SchemaError(ValueError):
    """The schema itself uses what the compiler cannot enforce."""


@functools.lru_cache(64)
def _checked(text: str) -> None:
    """A contract is looked through once, however often it is compiled; what refuses it is not remembered."""
    check_schema(json.loads(text))


def check_schema(schema: dict, at: str = "$") -> None:
    if not isinstance(schema, dict):
        return
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise SchemaError(f"{at}: cannot enforce {sorted(unknown)}")
    if schema.get("format") not in (None, "date-time", "date"):
        raise SchemaError(f"{at}: cannot enforce format {schema['format']}")
    for group in ("properties", "definitions"):
        for k, v in schema.get(group, {}).items():
            check_schema(v, f"{at}.{k}")
    for k in ("items", "additionalProperties"):
        if isinstance(schema.get(k), dict):
            check_schema(schema[k], f"{at}.{k}")


def _kind(v: Column) -> Column:
    """JSON type of a variant: null, boolean, integer, number, string, array, object; 'absent' for SQL null."""
    t = F.upper(F.schema_of_variant(v))
    whole = (F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double"))) & ~t.contains("E")
    return (
        F.when(v.isNull(), "absent").when(t == "VOID", "null").when(t == "BOOLEAN", "boolean").when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), F.when(t.startswith("DECIMAL") & t.endswith(",0)") & whole, "integer").otherwise("number"))
        .when(t == "STRING", "string").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("other")
    )


def _resolve(schema: dict, root: dict) -> dict:
    while "$ref" in schema:
        node = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            node = node[part]
        schema = node
    return schema


def _json(value) -> str:
    import json

    return json.dumps(value, separators=(",", ":"))


def _let(value: Column, body) -> Column:
    """`body` with `value` computed once and bound to a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _inner(schema: dict, root: dict, path: str, depth: int):
    """Errors of a property, none where it is absent."""
    return lambda c: F.when(c.isNotNull(), _errors(c, schema, root, path, depth)).otherwise(F.array().cast("array<string>"))


def _errors(v: Column, schema: dict, root: dict, path: str, depth: int = 0) -> Column:
    """array<string> of the errors of variant `v`; empty where it is absent."""
    if depth > 12:
        raise SchemaError("schema nests too deeply")
    return _let(_kind(v), lambda kind: _errors_of_kind(v, kind, _resolve(schema, root), root, path, depth))


def _errors_of_kind(v: Column, kind: Column, schema: dict, root: dict, path: str, depth: int) -> Column:
    none = F.array().cast("array<string>")
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    is_num, is_str, is_arr, is_obj = kind.isin("integer", "number"), kind == "string", kind == "array", kind == "object"
    one = lambda bad, what: F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(f"{path}: {what}"))).otherwise(none)
    parts = []
    if "enum" in schema:
        plain = [x for x in schema["enum"] if isinstance(x, str)]
        ok = (is_str & text.isin(plain)) if plain else F.lit(False)
        if None in schema["enum"]:
            ok = ok | (kind == "null")
        for x in schema["enum"]:
            if isinstance(x, (int, float)) and not isinstance(x, bool):
                ok = ok | (is_num & (number == float(x)))
            if isinstance(x, bool):
                ok = ok | ((kind == "boolean") & (text == str(x).lower()))
        parts.append(one(~ok, "not an allowed value"))
    if "const" in schema:
        parts.append(one(F.to_json(v) != _json(schema["const"]), "not the constant"))
    if "minLength" in schema:
        parts.append(one(is_str & (F.length(text) < schema["minLength"]), "too short"))
    if "maxLength" in schema:
        parts.append(one(is_str & (F.length(text) > schema["maxLength"]), "too long"))
    if "pattern" in schema:
        parts.append(one(is_str & ~text.rlike(schema["pattern"]), "pattern"))
    if schema.get("format") == "date-time":
        parts.append(one(is_str & ~(text.rlike(INSTANT) & F.try_to_timestamp(text).isNotNull()), "no instant"))
    if schema.get("format") == "date":
        parts.append(one(is_str & ~(text.rlike(DAY) & F.try_to_date(text).isNotNull()), "no date"))
    if "minimum" in schema:
        parts.append(one(is_num & (number < schema["minimum"]), "too small"))
    if "maximum" in schema:
        parts.append(one(is_num & (number > schema["maximum"]), "too large"))
    props = schema.get("properties", {})
    if "required" in schema or props or "additionalProperties" in schema:
        keys = F.coalesce(F.json_object_keys(F.to_json(v)), none)
        for k in schema.get("required", []):
            parts.append(F.when(is_obj & ~F.array_contains(keys, k), F.array(F.lit(f"{path}: lacks {k}"))).otherwise(none))
        for k, sub in props.items():
            child = F.when(is_obj, F.try_variant_get(v, f"$['{k}']", "variant"))
            parts.append(_let(child, _inner(sub, root, f"{path}.{k}", depth + 1)))
        extra = F.array_except(keys, F.array(*[F.lit(k) for k in props]).cast("array<string>"))
        if schema.get("additionalProperties") is False:
            parts.append(F.when(is_obj, F.transform(F.array_sort(extra), lambda k: F.concat(F.lit(f"{path}: unknown "), k))).otherwise(none))
    if "minItems" in schema or "maxItems" in schema or "items" in schema:
        items = F.try_variant_get(v, "$", "array<variant>")
        if "minItems" in schema:
            parts.append(one(is_arr & (F.size(items) < schema["minItems"]), "too few items"))
        if "maxItems" in schema:
            parts.append(one(is_arr & (F.size(items) > schema["maxItems"]), "too many items"))
        if "items" in schema:
            inner = F.flatten(F.transform(items, lambda x: _errors(x, schema["items"], root, f"{path}[]", depth + 1)))
            parts.append(F.when(is_arr, F.coalesce(inner, none)).otherwise(none))
    found = F.concat(*parts) if parts else none
    if "type" in schema:
        wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        allowed = {"number": ["integer", "number"]}
        names = [n for w in wanted for n in allowed.get(w, [w])]
        found = F.when(~kind.isin(names), F.array(F.lit(f"{path}: not {'/'.join(wanted)}"))).otherwise(found)
    return F.when(kind == "absent", none).otherwise(found)


def errors_of(raw: str | Column, schema: dict) -> Column:
    """array<string>: what is wrong with the JSON text in `raw`; empty if nothing."""
    _checked(json.dumps(schema))
    raw = F.col(raw) if isinstance(raw, str) else raw
    return _let(F.try_parse_json(raw), lambda v: F.when(v.isNull(), F.array(F.lit("$: unreadable"))).otherwise(_errors(v, schema, schema, "$")))


def validate(rows: DataFrame, raw: str, schema: dict, out: str = "errors") -> DataFrame:
    return rows.withColumn(out, errors_of(raw, schema))


def repeated_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, n) of ids met more than once."""
    return rows.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).filter("n > 1")
