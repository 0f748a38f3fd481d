"""JSON Schemas as column expressions: the path and keyword of the first thing that is wrong, a text per row.

A schema is compiled to one expression over VARIANT, so a table of JSON texts is checked where it is, without Python
workers. Keywords of which a schema knows none that are not here: unknown ones are an error when it is compiled."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that say nothing about what is valid.
ANNOTATIONS = {"$schema", "$id", "$comment", "$defs", "title", "description", "format", "default", "examples"}
#: References inside references, at most: a schema that holds itself is none for a plan of fixed size.
MOST_NESTED = 40

_TIME = {"type": "string", "pattern": r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"}
_STRINGS = {"type": "array", "items": {"type": "string", "minLength": 1}, "uniqueItems": True}
#: What this library hands out and takes in.
RESULT = {
    "type": "object", "required": ["source_id", "rank"],
    "properties": {"rank": {"type": "integer", "minimum": 1}, "kind": {"enum": ["exact", "bm25", "hybrid"]}, "fusion_score": {"type": ["number", "null"], "minimum": 0}, "labels": _STRINGS},
}
ENVELOPE = {
    "type": "object", "required": ["schema_version", "ok", "data", "warnings", "meta"], "additionalProperties": False,
    "properties": {
        "schema_version": {"const": "skein.v1"}, "ok": {"const": True}, "data": {"type": "array", "items": {"$ref": "#/$defs/result"}}, "warnings": _STRINGS,
        "meta": {"type": "object", "required": ["results"], "properties": {"results": {"type": "integer", "minimum": 0}}},
    },
    "$defs": {"result": RESULT},
}
QUERY = {
    "type": "object", "required": ["query"], "additionalProperties": False, "dependentRequired": {"issue": ["repo"]},
    "properties": {
        "query": {"type": "string", "minLength": 1, "maxLength": 1000}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}, "repo": {"type": "string", "pattern": "^[^/]+/[^/]+$"}, "issue": {"type": "integer", "minimum": 1},
        "state": {"enum": ["open", "closed", "all"]}, "label": {"anyOf": [{"type": "string"}, _STRINGS]}, "max_age": {"type": "string", "pattern": "^[0-9]+(s|m|h|d|mo)$"}, "require_fresh": {"type": "boolean"},
    },
}
LANDED_PAGE = {
    "type": "object", "required": ["endpoint", "page", "status", "fetched_at"], "additionalProperties": False,
    "properties": {
        "endpoint": {"type": "string", "pattern": "^(issues|repo-comments|comments|history):"}, "repo": {"type": ["string", "null"]}, "host": {"type": ["string", "null"]}, "page": {"type": "integer", "minimum": 1},
        "status": {"type": "integer", "minimum": 100, "maximum": 599}, "etag": {"type": ["string", "null"]}, "link": {"type": ["string", "null"]}, "remaining": {"type": ["integer", "null"], "minimum": 0},
        "items": {"type": ["array", "null"], "items": {"type": "string"}}, "fetched_at": _TIME,
    },
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _first(errors: list[Column]) -> Column:
    return F.coalesce(*errors) if errors else F.lit(None).cast("string")


class _Compiler:
    def __init__(self, root: dict):
        self.root, self.depth = root, 0

    def check(self, schema: dict | bool, v: Column, path: Column) -> Column:
        """The first error of the variant ``v``; null if it is valid."""
        if isinstance(schema, bool):
            return F.lit(None).cast("string") if schema else F.concat(path, F.lit(": false"))
        if extra := {k for k in schema if not hasattr(self, f"do_{k.strip('$')}")} - ANNOTATIONS - {"then", "else"}:
            raise ValueError(f"keywords that are not known: {', '.join(sorted(extra))}")
        self.depth += 1
        if self.depth > MOST_NESTED:
            raise ValueError("the schema holds itself")
        order = ("$ref", "type", "const", "enum")
        keys = sorted((k for k in schema if k not in ANNOTATIONS | {"then", "else"}), key=lambda k: (k not in order, order.index(k) if k in order else 0))
        made = _let(v, lambda x: _let(self._kind(x), lambda kind: _first([getattr(self, f"do_{k.strip('$')}")(schema[k], x, kind, path, schema) for k in keys])))
        self.depth -= 1
        return made

    @staticmethod
    def _kind(v: Column) -> Column:
        """object, array, string, boolean, null, integer or number."""
        said = F.schema_of_variant(v)
        whole = F.try_variant_get(v, "$", "double") % 1 == 0
        return (
            F.when(F.startswith(said, F.lit("OBJECT")), "object").when(F.startswith(said, F.lit("ARRAY")), "array").when(said == "STRING", "string").when(said == "BOOLEAN", "boolean")
            .when(said == "VOID", "null").when(said == "BIGINT", "integer").when(whole, "integer").otherwise("number")
        )

    @staticmethod
    def _wrong(bad: Column, path: Column, keyword: str) -> Column:
        return F.when(bad, F.concat(path, F.lit(f": {keyword}")))

    # -- any value
    def do_ref(self, name: str, v, kind, path, schema) -> Column:
        at: Any = self.root
        for part in name.removeprefix("#/").split("/") if name != "#" else []:
            at = at[part]
        return self.check(at, v, path)

    def do_type(self, want, v, kind, path, schema) -> Column:
        names = {want} if isinstance(want, str) else set(want)
        return self._wrong(~kind.isin(*names, *(["integer"] if "number" in names else [])), path, "type")

    def _equal(self, value, v: Column, kind: Column) -> Column:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return kind.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == float(value))
        return F.to_json(v) == json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    def do_const(self, value, v, kind, path, schema) -> Column:
        return self._wrong(~self._equal(value, v, kind), path, "const")

    def do_enum(self, values, v, kind, path, schema) -> Column:
        fits = F.lit(False)
        for value in values:
            fits = fits | self._equal(value, v, kind)
        return self._wrong(~fits, path, "enum")

    def do_allOf(self, parts, v, kind, path, schema) -> Column:  # noqa: N802
        return _first([self.check(p, v, path) for p in parts])

    def _fitting(self, parts, v) -> Column:
        return sum((self.check(p, v, F.lit("")).isNull().cast("int") for p in parts), F.lit(0))

    def do_anyOf(self, parts, v, kind, path, schema) -> Column:  # noqa: N802
        return self._wrong(self._fitting(parts, v) == 0, path, "anyOf")

    def do_oneOf(self, parts, v, kind, path, schema) -> Column:  # noqa: N802
        return self._wrong(self._fitting(parts, v) != 1, path, "oneOf")

    def do_not(self, part, v, kind, path, schema) -> Column:
        return self._wrong(self._fitting([part], v) == 1, path, "not")

    def do_if(self, part, v, kind, path, schema) -> Column:
        fits = self._fitting([part], v) == 1
        return F.when(fits, self.check(schema.get("then", True), v, path)).otherwise(self.check(schema.get("else", True), v, path))

    # -- numbers and strings
    def _number(self, bad: Callable[[Column], Column], v, kind, path, keyword) -> Column:
        return self._wrong(kind.isin("integer", "number") & bad(F.try_variant_get(v, "$", "double")), path, keyword)

    def do_minimum(self, least, v, kind, path, schema) -> Column:
        return self._number(lambda x: x < least, v, kind, path, "minimum")

    def do_maximum(self, most, v, kind, path, schema) -> Column:
        return self._number(lambda x: x > most, v, kind, path, "maximum")

    def do_multipleOf(self, of, v, kind, path, schema) -> Column:  # noqa: N802
        return self._number(lambda x: x / of != F.round(x / of), v, kind, path, "multipleOf")

    def _string(self, bad: Callable[[Column], Column], v, kind, path, keyword) -> Column:
        return self._wrong((kind == "string") & bad(F.try_variant_get(v, "$", "string")), path, keyword)

    def do_minLength(self, n, v, kind, path, schema) -> Column:  # noqa: N802
        return self._string(lambda x: F.length(x) < n, v, kind, path, "minLength")

    def do_maxLength(self, n, v, kind, path, schema) -> Column:  # noqa: N802
        return self._string(lambda x: F.length(x) > n, v, kind, path, "maxLength")

    def do_pattern(self, pattern, v, kind, path, schema) -> Column:
        return self._string(lambda x: ~x.rlike(pattern), v, kind, path, "pattern")

    # -- arrays
    def _array(self, body: Callable[[Column], Column], v, kind) -> Column:
        return F.when(kind == "array", _let(F.try_variant_get(v, "$", "array<variant>"), body))

    def do_minItems(self, n, v, kind, path, schema) -> Column:  # noqa: N802
        return self._array(lambda a: self._wrong(F.size(a) < n, path, "minItems"), v, kind)

    def do_maxItems(self, n, v, kind, path, schema) -> Column:  # noqa: N802
        return self._array(lambda a: self._wrong(F.size(a) > n, path, "maxItems"), v, kind)

    def do_uniqueItems(self, on, v, kind, path, schema) -> Column:  # noqa: N802
        same = lambda a: F.size(F.array_distinct(F.transform(a, lambda x: F.to_json(x)))) < F.size(a)
        return self._array(lambda a: self._wrong(same(a), path, "uniqueItems"), v, kind) if on else F.lit(None).cast("string")

    def do_items(self, part, v, kind, path, schema) -> Column:
        each = lambda x, i: self.check(part, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        return self._array(lambda a: F.get(F.filter(F.transform(a, each), lambda e: e.isNotNull()), 0), v, kind)

    # -- objects
    def _object(self, body: Callable[[Column], Column], v, kind) -> Column:
        return F.when(kind == "object", _let(F.try_variant_get(v, "$", "map<string,variant>"), body))

    def _has(self, m: Column, name: str) -> Column:
        return F.map_contains_key(m, F.lit(name))

    def _below(self, path: Column, name: str) -> Column:
        return F.concat(path, F.lit(f".{name}"))

    def do_required(self, names, v, kind, path, schema) -> Column:
        return self._object(lambda m: _first([self._wrong(~self._has(m, n), self._below(path, n), "required") for n in names]), v, kind)

    def do_dependentRequired(self, rules, v, kind, path, schema) -> Column:  # noqa: N802
        return self._object(lambda m: _first([self._wrong(self._has(m, k) & ~self._has(m, n), self._below(path, n), "dependentRequired") for k, names in rules.items() for n in names]), v, kind)

    def do_properties(self, parts, v, kind, path, schema) -> Column:
        return self._object(lambda m: _first([F.when(self._has(m, n), self.check(p, m[n], self._below(path, n))) for n, p in parts.items()]), v, kind)

    def do_additionalProperties(self, part, v, kind, path, schema) -> Column:  # noqa: N802
        own = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")

        def rest(m: Column) -> Column:
            names = F.array_sort(F.array_except(F.map_keys(m), own))
            at = lambda n: F.concat(path, F.lit("."), n)
            if part is False:
                return F.when(F.size(names) > 0, F.concat(at(F.get(names, 0)), F.lit(": additionalProperties")))
            return F.get(F.filter(F.transform(names, lambda n: self.check(part, m[n], at(n))), lambda e: e.isNotNull()), 0)

        return self._object(rest, v, kind)


def schema_error(text: Column, schema: dict) -> Column:
    """``path: keyword`` of the first thing in a JSON text that the schema does not allow; ``$: json`` where it is none
    or is null; null where all is well. A value's own keywords go in the schema's order, its type before all."""
    made = _Compiler(schema).check(schema, F.try_parse_json(text), F.lit("$"))
    return F.when(F.try_parse_json(F.coalesce(text, F.lit(""))).isNull(), "$: json").otherwise(made)
