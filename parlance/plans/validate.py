"""The subset of JSON Schema that steps declare: type, items, required, properties."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: schema_of_variant's types by the names that schemas use; JSON numbers are all 'number'.
_KIND = (
    ("null", "^VOID$"), ("string", "^STRING$"), ("boolean", "^BOOLEAN$"), ("array", "^ARRAY"), ("object", "^OBJECT"),
)


def value_type(v: Column) -> Column:
    shape = F.schema_of_variant(v)
    out = F.when(shape.isNull(), "undefined")
    for name, pattern in _KIND:
        out = out.when(shape.rlike(pattern), name)
    return out.otherwise("number")


def _under(v: Column, name: str) -> Column:
    return F.try_variant_get(v, '$["' + name.replace('"', '\\"') + '"]', "variant")


def errors_of(v: Column, schema: dict, path: Column) -> Column:
    """array<string> of what of the variant v breaks schema. A wrong type ends the descent."""
    nothing = F.array().cast("array<string>")
    deeper = nothing
    items = schema.get("items")
    if isinstance(items, dict):
        each = F.try_variant_get(v, "$", "array<variant>")
        found = F.flatten(F.transform(each, lambda x, i: errors_of(x, items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        deeper = F.concat(deeper, F.when(value_type(v) == "array", F.coalesce(found, nothing)).otherwise(nothing))
    properties = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
    objects = []
    for name in schema.get("required") or []:
        if not isinstance(name, str):
            continue
        kind = properties.get(name, {}).get("type") if isinstance(properties.get(name), dict) else None
        told = f".{name}: expected {kind}, got undefined (required)" if isinstance(kind, str) else f".{name}: expected required field, got undefined"
        objects.append(F.when(_under(v, name).isNull(), F.array(F.concat(path, F.lit(told)))).otherwise(nothing))
    for name, inner in properties.items():
        if isinstance(inner, dict):
            objects.append(F.when(_under(v, name).isNotNull(), errors_of(_under(v, name), inner, F.concat(path, F.lit(f".{name}")))).otherwise(nothing))
    if objects:
        deeper = F.concat(deeper, F.when(value_type(v) == "object", F.concat(*objects)).otherwise(nothing))
    expected = schema.get("type")
    if not isinstance(expected, str):
        return deeper
    actual = value_type(v)
    return F.when(actual != expected, F.array(F.concat(path, F.lit(f": expected {expected}, got "), actual))).otherwise(deeper)


def validate_segments(segments: Column, schema: dict) -> Column:
    """Errors of a chunk's segments, a variant; [] if they fit."""
    return errors_of(segments, schema, F.lit("segments"))
