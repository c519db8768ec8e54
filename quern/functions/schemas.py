"""JSON Schemas as Column expressions over VARIANT: what is wrong with a value, as an array of `keyword:path`.

Keywords: type, enum, const, required, properties, additionalProperties (false or a schema), items, minItems, maxItems, uniqueItems, minLength, maxLength, pattern,
minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, if/then/else, allOf, anyOf, oneOf, not, and $ref to a place in the schema. Those that only describe
are passed over, and any other stops the compilation rather than be left out. A keyword for another type than the value's says nothing, as the standard has it.

A missing field is a SQL null and has no faults by itself; a JSON null is a value of type null. Numbers without a fraction are integers however they are written.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

DESCRIBING = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
NUMBERS = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"
ASSERTIONS = {
    "type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "uniqueItems", "minLength", "maxLength", "pattern", "minimum", "maximum",
    "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "if", "then", "else", "allOf", "anyOf", "oneOf", "not", "$ref",
}


def _double(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_type(v: Column, name: str) -> Column:
    """Whether a value is of a type; null where it is missing."""
    kind = _kind(v)
    number = F.regexp_like(kind, F.lit(NUMBERS))
    if name == "integer":
        return number & (_double(v) == F.floor(_double(v)))
    plain = {"object": F.startswith(kind, F.lit("OBJECT")), "array": F.startswith(kind, F.lit("ARRAY")), "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID", "number": number}
    return plain[name]


def _equals(v: Column, wanted) -> Column:
    """Whether a value is a JSON value."""
    if isinstance(wanted, bool):
        return F.coalesce(is_type(v, "boolean") & (F.try_variant_get(v, "$", "boolean") == wanted), F.lit(False))
    if wanted is None:
        return is_type(v, "null")
    if isinstance(wanted, (int, float)):
        return F.coalesce(is_type(v, "number") & (_double(v) == float(wanted)), F.lit(False))
    if isinstance(wanted, str):
        return F.coalesce(is_type(v, "string") & (F.try_variant_get(v, "$", "string") == wanted), F.lit(False))
    return F.coalesce(F.to_json(v) == json.dumps(wanted, ensure_ascii=False, sort_keys=True, separators=(",", ":")), F.lit(False))


def _child(v: Column, key: str) -> Column:
    # an object's fields as a map: a key may hold what a path could not
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))


# functions of one or two columns: a lambda's own parameters tell Spark what it takes


def _unlike(known: list[str]):
    return lambda k, _: ~k.isin(*known) if known else F.lit(True)


def _prefixed(start: str):
    return lambda k: F.concat(F.lit(start), k)


def _each(schema, path: str, root):
    return lambda x: faults(schema, x, path, root)


def _resolved(schema, root):
    while isinstance(schema, dict) and "$ref" in schema:
        ref = schema["$ref"]
        if not ref.startswith("#"):
            raise ValueError(f"a schema elsewhere: {ref}")
        at = root
        for part in ref[1:].strip("/").split("/") if ref != "#" else []:
            at = at[part.replace("~1", "/").replace("~0", "~")]
        schema = at
    return schema


def faults(schema, value: Column, path: str = "$", root=None) -> Column:
    """array<string> of what is wrong with a value, in the order of the schema's keywords; empty if it is valid."""
    root = schema if root is None else root
    schema = _resolved(schema, root)
    none = F.array().cast("array<string>")
    if schema is True or schema == {}:
        return none
    if schema is False:
        return F.when(value.isNotNull(), F.array(F.lit(f"false:{path}"))).otherwise(none)
    if unknown := set(schema) - ASSERTIONS - DESCRIBING:
        raise ValueError(f"keywords that are not known: {sorted(unknown)}")
    there = value.isNotNull()
    single: list[Column] = []  # a reason or null
    several: list[Column] = []  # arrays of reasons

    def unless(keyword: str, ok: Column, at: str = path) -> None:
        single.append(F.when(there & ~ok, F.lit(f"{keyword}:{at}")))

    def valid(inner) -> Column:
        return F.size(faults(inner, value, path, root)) == 0

    text, number, kinds = F.try_variant_get(value, "$", "string"), _double(value), {k: is_type(value, k) for k in ("object", "array", "string", "number")}
    members = F.when(kinds["array"], F.try_variant_get(value, "$", "array<variant>"))
    for keyword, wanted in schema.items():
        if keyword == "type":
            ok = F.lit(False)
            for name in [wanted] if isinstance(wanted, str) else wanted:
                ok = ok | F.coalesce(is_type(value, name), F.lit(False))
            unless(keyword, ok)
        elif keyword in ("enum", "const"):
            ok = F.lit(False)
            for w in wanted if keyword == "enum" else [wanted]:
                ok = ok | _equals(value, w)
            unless(keyword, ok)
        elif keyword == "required":
            for key in wanted:
                single.append(F.when(there & kinds["object"] & _child(value, key).isNull(), F.lit(f"{keyword}:{path}.{key}")))
        elif keyword == "properties":
            several += [faults(inner, _child(value, key), f"{path}.{key}", root) for key, inner in wanted.items()]
        elif keyword == "additionalProperties":
            known = list(schema.get("properties", {}))
            fields = F.map_filter(F.when(kinds["object"], F.try_variant_get(value, "$", "map<string,variant>")), _unlike(known))
            if wanted is False:
                several.append(F.transform(F.array_sort(F.map_keys(fields)), _prefixed(f"{keyword}:{path}.")))
            else:
                several.append(F.array_distinct(F.flatten(F.transform(F.map_values(fields), _each(wanted, f"{path}.*", root)))))
        elif keyword == "items":
            several.append(F.array_distinct(F.flatten(F.transform(members, _each(wanted, f"{path}[]", root)))))
        elif keyword in ("minItems", "maxItems"):
            unless(keyword, ~kinds["array"] | ((F.size(members) >= wanted) if keyword == "minItems" else (F.size(members) <= wanted)))
        elif keyword == "uniqueItems":
            if wanted:
                written = F.transform(members, lambda x: F.to_json(x))
                unless(keyword, ~kinds["array"] | (F.size(F.array_distinct(written)) == F.size(written)))
        elif keyword in ("minLength", "maxLength"):
            unless(keyword, ~kinds["string"] | ((F.length(text) >= wanted) if keyword == "minLength" else (F.length(text) <= wanted)))
        elif keyword == "pattern":
            unless(keyword, ~kinds["string"] | F.regexp_like(text, F.lit(wanted)))
        elif keyword in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
            ok = {"minimum": number >= wanted, "maximum": number <= wanted, "exclusiveMinimum": number > wanted, "exclusiveMaximum": number < wanted}[keyword]
            unless(keyword, ~kinds["number"] | ok)
        elif keyword == "multipleOf":
            unless(keyword, ~kinds["number"] | (number / wanted == F.floor(number / wanted)))
        elif keyword == "allOf":
            several += [faults(inner, value, path, root) for inner in wanted]
        elif keyword in ("anyOf", "oneOf"):
            count = sum((valid(inner).cast("int") for inner in wanted), F.lit(0))
            unless(keyword, count >= 1 if keyword == "anyOf" else count == 1)
        elif keyword == "not":
            unless(keyword, ~valid(wanted))
        elif keyword == "if":
            holds = valid(wanted)
            if "then" in schema:
                several.append(F.when(holds, faults(schema["then"], value, path, root)))
            if "else" in schema:
                several.append(F.when(~holds, faults(schema["else"], value, path, root)))
    found = [F.array_compact(F.array(*single))] if single else []
    found += [F.coalesce(a, none) for a in several]
    return F.concat(*found) if found else none


def checked(value: Column, schema) -> Column:
    """What is wrong with a JSON text; `json:$` if it is none."""
    v = F.try_parse_json(value)
    return F.when(v.isNull(), F.array(F.lit("json:$"))).otherwise(F.array_distinct(faults(schema, v)))
