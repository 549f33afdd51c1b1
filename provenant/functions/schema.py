"""Conformance of JSON values to the part of JSON Schema that records and exports use."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A judgement record's fields and kinds.
KINDS = ("rhetorical", "correlated-with", "crux-of", "calibration", "status", "edge", "faithfulness", "faithfulness-pass")
_TEXT, _TEXTS = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
RECORD = {
    "type": "object",
    "additionalProperties": False,
    "required": ["kind", "id", "subject", "grounding", "assessed_date", "assessor", "assessor_tool", "assess_version", "body_sha256", "record_sha256"],
    "properties": {
        "kind": {"type": "string", "enum": list(KINDS)}, "id": _TEXT, "subject": _TEXT, "grounding": _TEXTS, "span": _TEXT, "disputes": _TEXTS, "reviews": _TEXTS,
        "assessed_date": {"type": "string", "pattern": "^[0-9]{8}$"}, "assessor": _TEXT, "assessor_tool": _TEXT, "assess_version": _TEXT, "body_sha256": _TEXT, "record_sha256": _TEXT,
    },
}
_TYPES = {"null": type(None), "string": str, "integer": int, "boolean": bool, "array": list, "object": dict}
_LACKS = object()


def _kinds(schema: dict) -> list[str]:
    return [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])


def _typed(value: object, schema: dict) -> bool:
    kinds = _kinds(schema)
    return not kinds or any(type(value) is _TYPES.get(k) for k in kinds)


#: What each keyword finds fault with: of a value and the schema's word for it, one message a fault.
_FAULTS = {
    "type": lambda value, _, schema: [] if _typed(value, schema) else [f"not {' or '.join(_kinds(schema))}"],
    "enum": lambda value, words, _: [] if value in words else ["not one of the values"],
    "pattern": lambda value, pattern, _: ["not of the pattern"] if isinstance(value, str) and not re.search(pattern, value) else [],
    "required": lambda value, names, _: [f"{n} is missing" for n in names if n not in value] if isinstance(value, dict) else [],
    "additionalProperties": lambda value, more, schema: [f"{n} is unknown" for n in value if n not in schema.get("properties", {})] if isinstance(value, dict) and more is False else [],
}


def _parts(value: object, schema: dict) -> list[tuple[str, object, dict]]:
    """The path, value and schema of a value and of all within it that its schema speaks of; of what has the wrong type only itself."""
    found, todo = [], [("$", value, schema)]
    while todo:
        path, v, s = todo.pop()
        found.append((path, v, s))
        if not _typed(v, s):
            continue
        named = [(f"{path}.{n}", v.get(n, _LACKS), sub) for n, sub in s.get("properties", {}).items()] if isinstance(v, dict) else []
        listed = [(f"{path}[{i}]", x, s["items"]) for i, x in enumerate(v)] if isinstance(v, list) and "items" in s else []
        todo += [part for part in reversed(named + listed) if part[1] is not _LACKS]
    return found


def errors(value: object, schema: dict) -> list[str]:
    """path: what is wrong there, for each fault, by keyword and in the order of the schema; a wrong type is told alone."""
    told = []
    for path, v, s in _parts(value, schema):
        words = ["type"] if not _typed(v, s) else [k for k in _FAULTS if k in s]
        told += [f"{path}: {fault}" for k in words for fault in _FAULTS[k](v, s.get(k), s)]
    return told


def _of_text(value: Column, rules: dict, path: Column) -> Column:
    """Faults of a value, a variant or null, that has to be a text."""
    text = F.try_variant_get(value, "$", "string")
    right = F.schema_of_variant(value) == "STRING"
    told = [F.when(~right, F.concat(path, F.lit(": not string")))]
    if "enum" in rules:
        told.append(F.when(right & ~text.isin(rules["enum"]), F.concat(path, F.lit(": not one of the values"))))
    if "pattern" in rules:
        told.append(F.when(right & ~text.rlike(rules["pattern"]), F.concat(path, F.lit(": not of the pattern"))))
    return F.array_compact(F.array(*told))


def schema_errors(text: Column, schema: dict = RECORD) -> Column:
    """The errors of a JSON text by a schema of an object of texts and of lists of texts, without Python.

    One, not JSON, if it can't be read: a null one too, and an object that has a name twice.
    """
    whole = F.try_parse_json(text)
    none = F.array().cast("array<string>")
    fields = F.coalesce(F.try_variant_get(whole, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    names = F.map_keys(fields)
    lit = lambda values: F.array(*map(F.lit, values))
    parts = [F.transform(F.array_except(lit(schema["required"]), names), lambda n: F.concat(F.lit("$: "), n, F.lit(" is missing")))]
    if schema.get("additionalProperties") is False:
        parts.append(F.transform(F.array_except(names, lit(schema["properties"])), lambda n: F.concat(F.lit("$: "), n, F.lit(" is unknown"))))
    for name, rules in schema["properties"].items():
        value, path = F.try_element_at(fields, F.lit(name)), F.lit(f"$.{name}")
        if rules["type"] == "string":
            told = _of_text(value, rules, path)
        else:
            told = _of_list(value, rules["items"], path)
        parts.append(F.when(F.array_contains(names, name), told).otherwise(none))
    shape = F.schema_of_variant(whole)
    return F.when(whole.isNull(), lit(["$: not JSON"])).when(~shape.startswith("OBJECT"), lit(["$: not object"])).otherwise(F.concat(*parts))


def _of_list(value: Column, rules: dict, path: Column) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    each = F.transform(items, lambda v, i: _of_text(v, rules, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.flatten(each)).otherwise(F.array(F.concat(path, F.lit(": not array"))))
