"""Schemas as expressions: a broken text for each keyword, by path."""

import json

import pytest
from pyspark.sql import functions as F

from skein.plans import contracts

SCHEMA = {
    "type": "object", "required": ["a"], "additionalProperties": {"type": "string"}, "dependentRequired": {"b": ["c"]},
    "properties": {
        "a": {"$ref": "#/$defs/small"}, "b": {"const": {"x": 1, "w": [True, None]}}, "c": {"enum": ["p", 2, None]}, "d": {"type": ["number", "null"], "multipleOf": 0.5},
        "e": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "object", "properties": {"n": {"type": "integer", "maximum": 9}}}},
        "f": {"anyOf": [{"type": "string", "pattern": "^z"}, {"type": "boolean"}]}, "g": {"oneOf": [{"type": "integer"}, {"type": "number", "minimum": 5}]}, "h": {"not": {"type": "string"}},
        "i": {"allOf": [{"type": "string"}, {"minLength": 2, "maxLength": 3}]}, "j": {"if": {"type": "string"}, "then": {"maxLength": 1}, "else": {"type": "integer"}}, "k": False,
    },
    "$defs": {"small": {"type": "integer", "minimum": 0, "description": "a number"}},
}
CASES = [
    ({"a": 1}, None), ({"a": 1.0, "d": None, "z": "s"}, None), ({"a": 1, "b": {"w": [True, None], "x": 1}, "c": 2.0, "d": 1.5, "e": [{"n": 1}, {"n": 2, "m": "x"}], "f": "zz", "g": 2, "h": 1, "i": "ab", "j": 3}, None), ({"a": 0, "f": False, "g": 5.5, "j": "x", "c": None}, None),
    ([], "$: type"), ({}, "$.a: required"), ({"a": "1"}, "$.a: type"), ({"a": 1.5}, "$.a: type"), ({"a": -1}, "$.a: minimum"), ({"a": 1, "zz": 1, "y": 2}, "$.y: type"), ({"a": 1, "b": {"w": [True, None], "x": 1}}, "$.c: dependentRequired"),
    ({"a": 1, "c": "p", "b": {"x": 2}}, "$.b: const"), ({"a": 1, "c": "q"}, "$.c: enum"), ({"a": 1, "c": "2"}, "$.c: enum"), ({"a": 1, "d": 0.3}, "$.d: multipleOf"), ({"a": 1, "d": True}, "$.d: type"),
    ({"a": 1, "e": []}, "$.e: minItems"), ({"a": 1, "e": [{}, {"n": 1}, {"n": 2}, {"n": 3}]}, "$.e: maxItems"), ({"a": 1, "e": [{"n": 1}, {"n": 1}]}, "$.e: uniqueItems"), ({"a": 1, "e": [{}, {"n": 10}]}, "$.e[1].n: maximum"), ({"a": 1, "e": [{}, 3]}, "$.e[1]: type"), ({"a": 1, "e": {}}, "$.e: type"),
    ({"a": 1, "f": "az"}, "$.f: anyOf"), ({"a": 1, "g": 6}, "$.g: oneOf"), ({"a": 1, "g": 1.5}, "$.g: oneOf"), ({"a": 1, "h": ""}, "$.h: not"), ({"a": 1, "i": "a"}, "$.i: minLength"), ({"a": 1, "i": "abcd"}, "$.i: maxLength"), ({"a": 1, "i": 3}, "$.i: type"), ({"a": 1, "j": "xy"}, "$.j: maxLength"), ({"a": 1, "j": 1.5}, "$.j: type"),
    ({"a": 1, "k": 1}, "$.k: false"),
]


def test_each_keyword(spark):
    rows = [(i, json.dumps(x)) for i, (x, _) in enumerate(CASES)] + [(900, "{"), (901, None), (902, "")]
    got = {r["i"]: r["e"] for r in spark.createDataFrame(rows, "i int, x string").select("i", contracts.schema_error(F.col("x"), SCHEMA).alias("e")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(CASES)} | dict.fromkeys((900, 901, 902), "$: json")


@pytest.mark.parametrize(("schema", "why"), [({"type": "object", "contains": {}}, "not known: contains"), ({"properties": {"a": {"$ref": "#"}}}, "holds itself")])
def test_schemas_that_cannot_be_compiled(spark, schema, why):
    with pytest.raises(ValueError, match=why):
        contracts.schema_error(F.lit("{}"), schema)


def test_own_contracts(spark):
    page = {"endpoint": "issues:a/b", "page": 1, "status": 200, "fetched_at": "2024-01-01T00:00:00Z", "etag": None, "items": ["{}"]}
    query = {"query": "x", "limit": 5, "label": ["a", "b"], "max_age": "3mo", "state": "open", "repo": "a/b", "issue": 3}
    rows = [(1, page, None), (1, page | {"status": 99}, "$.status: minimum"), (1, page | {"more": 1}, "$.more: additionalProperties"), (1, page | {"items": [1]}, "$.items[0]: type"), (2, query, None), (2, query | {"label": "a"}, None), (2, query | {"label": ["a", "a"]}, "$.label: anyOf"), (2, {"query": "x", "issue": 1}, "$.repo: dependentRequired"), (2, query | {"limit": 0}, "$.limit: minimum"), (2, query | {"max_age": "3y"}, "$.max_age: pattern")]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x, _ in rows], "k int, x string").coalesce(1)
    error = F.when(F.col("k") == 1, contracts.schema_error(F.col("x"), contracts.LANDED_PAGE)).otherwise(contracts.schema_error(F.col("x"), contracts.QUERY))
    assert [r[0] for r in df.select(error).collect()] == [e for *_, e in rows]
