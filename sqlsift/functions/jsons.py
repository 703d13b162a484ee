"""Containment of JSON documents, and removal of a path, as Catalyst expressions on variants.

A part that is known when the query is planned becomes an expression of its own shape, so documents of any depth are tested without
Python. A part that is a column has no shape to plan for: it is tested by a small recursion in an Arrow UDF.

A document contains another as `@>` has it: an object if it has every key with a value that contains the key's value, an array
if each element of the other is contained in one of its own (order and number do not count), a scalar if it is equal; an array also contains
its scalar elements, at the top. Nulls give null, texts that are no JSON, too.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _value(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _all(tests: list[Column], first: Column) -> Column:
    return reduce(lambda a, b: a & b, tests, first)


def _some(items: Column, part) -> Column:
    return F.exists(items, lambda x: _within(x, part))


def _within(v: Column, part, top: bool = False) -> Column:
    """Whether the variant `v` contains `part` (as json.loads gives it); false for a missing variant."""
    if isinstance(part, dict):
        fields = _value(v, "map<string, variant>")
        found = _all([_within(F.try_element_at(fields, F.lit(k)), p) for k, p in part.items()], F.startswith(_kind(v), F.lit("OBJECT")))
    elif isinstance(part, list):
        items = _value(v, "array<variant>")
        found = _all([_some(items, p) for p in part], F.startswith(_kind(v), F.lit("ARRAY")))
    else:
        if part is None:
            found = F.is_variant_null(v)
        elif isinstance(part, bool):
            found = (_kind(v) == "BOOLEAN") & (_value(v, "boolean") == F.lit(part))
        elif isinstance(part, str):
            found = (_kind(v) == "STRING") & (_value(v, "string") == F.lit(part))
        else:
            number = F.regexp_like(_kind(v), F.lit("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"))
            same = _value(v, "decimal(38, 0)") == F.lit(part).cast("decimal(38, 0)") if isinstance(part, int) and abs(part) < 10**38 else F.lit(True)
            found = number & (_value(v, "double") == F.lit(float(part))) & F.coalesce(same, F.lit(True))
        if top:
            found = found | (F.startswith(_kind(v), F.lit("ARRAY")) & _some(_value(v, "array<variant>"), part))
    return F.coalesce(found, F.lit(False))


def within(whole, part, top: bool = True) -> bool:
    """The same on values of json.loads."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and within(whole[k], p, False) for k, p in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(within(w, p, False) for w in whole) for p in part)
    if top and isinstance(whole, list):
        return any(within(w, part, False) for w in whole)
    return isinstance(whole, bool) == isinstance(part, bool) and not isinstance(whole, (dict, list)) and (whole == part and (whole is None) == (part is None))


def _within_text(whole: str | None, part: str | None) -> bool | None:
    if whole is None or part is None:
        return None
    try:
        return within(json.loads(whole), json.loads(part))
    except ValueError:
        return None


def json_contains(column: Column, part: Column | str) -> Column:
    """`column @> part`: JSON texts; `part` is a text or a column of texts."""
    if isinstance(part, str):
        v = F.try_parse_json(column)
        return F.when(v.isNotNull(), _within(v, json.loads(part), True))
    return F.udf(_within_text, "boolean", useArrow=True)(column, part)


def json_contained(column: Column, whole: Column | str) -> Column:
    """`column <@ whole`."""
    return json_contains(F.lit(whole) if isinstance(whole, str) else whole, column)


def _without(v: Column, path: tuple[str, ...]) -> Column:
    first, rest = path[0], path[1:]
    fields, items = _value(v, "map<string, variant>"), _value(v, "array<variant>")
    if rest:
        cut = F.transform_values(fields, lambda k, x: F.when(k == first, _without(x, rest)).otherwise(x))
    else:
        cut = F.map_filter(fields, lambda k, x: k != first)
    out = F.when(F.startswith(_kind(v), F.lit("OBJECT")), F.to_variant_object(cut))
    if first.lstrip("-").isdigit():
        at = F.lit(int(first)) if int(first) >= 0 else F.size(items) + int(first)
        cut = F.transform(items, lambda x, k: F.when(k == at, _without(x, rest)).otherwise(x)) if rest else F.filter(items, lambda x, k: k != at)
        out = out.when(F.startswith(_kind(v), F.lit("ARRAY")), F.to_variant_object(cut))
    return out.otherwise(v)


def json_delete_path(column: Column, *path: str) -> Column:
    """`column #- path`: the document without what stands at a path of keys and positions (from the end if negative); itself if nothing does."""
    v = F.try_parse_json(column)
    return F.to_json(_without(v, path) if path else v)


def json_path(column: Column, *path: str) -> Column:
    """`column #>> path`: the value at a path of keys and positions, as text."""
    return F.get_json_object(column, "$" + "".join(f"[{x}]" if x.isdigit() else f"['{x}']" for x in path))


def json_has(column: Column, keys: list[str], every: bool) -> Column:
    """`column ?& keys` (every key) or `column ?| keys` (one of them): keys of an object, strings of an array, a string itself."""
    v = F.try_parse_json(column)
    kind = _kind(v)
    strings = F.transform(F.filter(_value(v, "array<variant>"), lambda x: _kind(x) == "STRING"), lambda x: _value(x, "string"))
    found = F.when(F.startswith(kind, F.lit("OBJECT")), F.map_keys(_value(v, "map<string, variant>"))).when(F.startswith(kind, F.lit("ARRAY")), strings).when(kind == "STRING", F.array(_value(v, "string"))).otherwise(F.array().cast("array<string>"))
    wanted = F.array(*[F.lit(k) for k in keys]).cast("array<string>")
    return F.when(v.isNotNull(), F.size(F.array_except(wanted, found)) == 0 if every else F.arrays_overlap(found, wanted))


def json_without(column: Column, key: str) -> Column:
    """`column - key` of a JSON object."""
    return F.to_json(F.map_filter(F.from_json(column, "map<string, variant>"), lambda k, v: k != key))
