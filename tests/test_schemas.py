"""The schema compiler against a plain checker, digests of tables, and chunks from a table function."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.functions.chunks import chunk_rows, cut, pieces, prepared
from quern.functions.schemas import checked
from quern.sources.digests import lineage, set_digests


def plain(schema, v, path="$", root=None):
    root = schema if root is None else root
    if "$ref" in schema:
        schema = root["$defs"][schema["$ref"].rsplit("/", 1)[-1]]
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    kinds = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and v == int(v)}
    same = lambda a, b: json.dumps(float(a) if isinstance(a, (int, float)) and not isinstance(a, bool) else a, sort_keys=True) == json.dumps(float(b) if isinstance(b, (int, float)) and not isinstance(b, bool) else b, sort_keys=True)
    out = []
    for k, w in schema.items():
        bad = False
        if k == "type":
            bad = not any(kinds[t] for t in ([w] if isinstance(w, str) else w))
        elif k in ("enum", "const"):
            bad = not any(same(v, x) for x in (w if k == "enum" else [w]))
        elif k == "required" and kinds["object"]:
            out += [f"{k}:{path}.{x}" for x in w if x not in v]
        elif k == "properties" and kinds["object"]:
            for name, inner in w.items():
                out += plain(inner, v[name], f"{path}.{name}", root) if name in v else []
        elif k == "additionalProperties" and kinds["object"]:
            extra = sorted(set(v) - set(schema.get("properties", {})))
            out += [f"{k}:{path}.{x}" for x in extra] if w is False else [r for x in extra for r in plain(w, v[x], f"{path}.*", root)]
        elif k == "items" and kinds["array"]:
            out += [r for x in v for r in plain(w, x, f"{path}[]", root)]
        elif k in ("minItems", "maxItems") and kinds["array"]:
            bad = len(v) < w if k == "minItems" else len(v) > w
        elif k == "uniqueItems" and kinds["array"]:
            bad = w and len({json.dumps(x, sort_keys=True) for x in v}) < len(v)
        elif k in ("minLength", "maxLength") and kinds["string"]:
            bad = len(v) < w if k == "minLength" else len(v) > w
        elif k == "pattern" and kinds["string"]:
            import re

            bad = not re.search(w, v)
        elif k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf") and number:
            bad = {"minimum": lambda: v < w, "maximum": lambda: v > w, "exclusiveMinimum": lambda: v <= w, "exclusiveMaximum": lambda: v >= w, "multipleOf": lambda: v % w != 0}[k]()
        elif k == "allOf":
            out += [r for inner in w for r in plain(inner, v, path, root)]
        elif k in ("anyOf", "oneOf"):
            n = sum(not plain(inner, v, path, root) for inner in w)
            bad = n == 0 if k == "anyOf" else n != 1
        elif k == "not":
            bad = not plain(w, v, path, root)
        elif k == "if":
            out += plain(schema.get("then", {}) if not plain(w, v, path, root) else schema.get("else", {}), v, path, root)
        if bad:
            out.append(f"{k}:{path}")
    return out


SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "title": "a record",
    "type": "object",
    "required": ["id", "kind"],
    "properties": {
        "id": {"type": "string", "minLength": 2, "maxLength": 6, "pattern": "^[a-z]"},
        "kind": {"enum": ["A", "B", 3, None, True]},
        "level": {"oneOf": [{"type": "integer", "minimum": 0, "maximum": 3}, {"type": "string", "enum": ["L0", "L1"]}]},
        "share": {"type": ["number", "null"], "exclusiveMinimum": 0, "exclusiveMaximum": 1},
        "list": {"type": "array", "items": {"type": "string", "minLength": 1}, "minItems": 1, "maxItems": 3, "uniqueItems": True},
        "part": {"$ref": "#/$defs/part"},
        "odd key": {"not": {"const": "NONE"}},
        "steps": {"multipleOf": 5},
        "status": {"const": "gold"},
    },
    "additionalProperties": False,
    "allOf": [
        {"if": {"properties": {"kind": {"const": "B"}}, "required": ["kind"]}, "then": {"required": ["list", "level"], "properties": {"list": {"minItems": 2}}}, "else": {"properties": {"steps": {"maximum": 50}}}},
        {"anyOf": [{"required": ["share"]}, {"required": ["part"]}, {"properties": {"kind": {"const": "A"}}}]},
    ],
    "$defs": {"part": {"type": "object", "properties": {"n": {"type": "integer"}, "sub": {"type": "array", "items": {"$ref": "#/$defs/leaf"}}}, "additionalProperties": {"type": "boolean"}}, "leaf": {"type": "object", "required": ["x"]}},
}


def record(rng):
    pick = rng.choice
    fields = {
        "id": lambda: pick(["ab", "a", "abcdefg", "Ab", 5, None, ""]), "kind": lambda: pick(["A", "B", "B", "C", 3, 3.0, None, True, 1]), "level": lambda: pick([0, 2, 3.0, 4, "L1", "L9", None, 2.5]),
        "share": lambda: pick([0, 0.5, 1, None, "x", 0.25]), "list": lambda: pick([[], ["a"], ["a", "b"], ["a", "a"], ["a", "", 3], ["a", "b", "c", "d"], "no", None]), "odd key": lambda: pick(["NONE", "x", 1]),
        "part": lambda: pick([{}, {"n": 1}, {"n": 1.5, "z": 1}, {"sub": [{"x": 1}, {}], "y": True}, 7]), "steps": lambda: pick([5, 7, 55, 60, "5"]), "status": lambda: pick(["gold", "lead"]), "extra": lambda: pick([1, None]),
    }
    return {k: f() for k, f in fields.items() if rng.random() < 0.7} if rng.random() < 0.97 else pick([[], "text", 5, None, True])


def test_like_a_plain_checker(spark):
    rng = random.Random(1)
    rows = [json.dumps(record(rng), ensure_ascii=False) for _ in range(400)] + ["{", ""]
    df = spark.createDataFrame([(t,) for t in rows], "t string").withColumn("r", checked(F.col("t"), SCHEMA))
    for r in df.collect():
        try:
            want = sorted(set(plain(SCHEMA, json.loads(r.t))))
        except ValueError:
            want = ["json:$"]
        assert sorted(r.r) == want, r.t


def test_unknown_keywords_stop(spark):
    with pytest.raises(ValueError, match="prefixItems"):
        checked(F.col("t"), {"prefixItems": []})


def test_digests_do_not_depend_on_order_and_find_changes(spark):
    rows = [(i % 7 or None, f"t{i % 50}", "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "n int, t string, split string")
    first = set_digests(df).first()
    assert first.n == 300 and set_digests(df.repartition(5, "t").select("t", "split", "n")).first() == first
    other = spark.createDataFrame([*rows[:-1], (rows[-1][0], "changed", rows[-1][2])], df.schema)
    twice = spark.createDataFrame([*rows[:-1], rows[0]], df.schema)
    kind = df.withColumn("n", F.col("n").cast("string"))
    assert len({set_digests(x).first().digest for x in (df, other, twice, kind)}) == 4
    assert set_digests(df.limit(0)).first().n == 0
    found = {(r.role, r["name"]): r.digest for r in lineage(df, {"same": df, "other": other}, "split").collect()}
    assert found["input", "input"] == found["output", "same"] != found["output", "other"]
    assert found["split", "same/a"] != found["split", "same/b"] and sum(found["split", f"same/{s}"] == found["split", f"other/{s}"] for s in "ab") == 1


def test_chunks_come_one_by_one(spark):
    texts = ["", None, "short", "First. " * 300, "句。" * 700, "a\n\n\nb " * 400, "x" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r.place, r.chunk) for r in chunk_rows(df, "text", 100, 20).collect())
    assert got == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(cut(t, 100, 20))]
    assert next(iter(pieces("One. " * 1000, 50, 5))) == cut("One. " * 1000, 50, 5)[0]
    ids = [r.evidence_id for r in prepared(spark.createDataFrame([("s", "f.md", "Word. " * 60)], "source_id string, file string, text string"), 100, 10).orderBy("evidence_id").collect()]
    assert ids[0] == "s_0001" and len(ids) == len(cut("Word. " * 60, 100, 10))
