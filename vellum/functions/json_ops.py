"""JSON documents as strings: field access by name at the top level, comparison, mutation."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.common import column

U64 = 2**64
_INT = "^[+-]?[0-9]{1,19}$"


def _path(name: str) -> str:
    if "'" in name:
        raise ValueError(f"field name with a quote: {name!r}")
    return f"$['{name}']"


def field(doc: Column | str, name: str) -> Column:
    """A top-level field as text; '' for a missing field, a JSON null or a text that is no JSON."""
    return F.coalesce(F.get_json_object(column(doc), _path(name)), F.lit(""))


def string_field(doc: Column | str, name: str) -> Column:
    """A top-level field if its value is a JSON string, else null."""
    value = F.try_variant_get(F.try_parse_json(column(doc)), f'$["{name}"]', "variant")
    return let(value, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def field_eq(doc: Column | str, name: str, value: Any) -> Column:
    """Text equality of a field with a JSON scalar."""
    return field(doc, name) == F.lit(scalar_text(value))


def field_ge(doc: Column | str, name: str, value: Any) -> Column:
    """Numbers if both sides are 64-bit integers, else text by bytes."""
    bound = scalar_text(value)
    try:
        number = int(bound) if bound.strip() == bound else None
    except ValueError:
        number = None
    if number is None or not -(2**63) <= number < 2**63:
        return field(doc, name) >= F.lit(bound)
    number_of = lambda t: F.when(t.rlike(_INT), t.try_cast("bigint") >= F.lit(number))
    return let(field(doc, name), lambda t: F.coalesce(number_of(t), t >= F.lit(bound)))


def scalar_text(value: Any) -> str:
    """A JSON scalar as the text that fields are compared with."""
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def u64(text: Column) -> Column:
    """Text as an unsigned 64-bit number: 0 if it is none, the largest if it is beyond."""
    largest = F.lit(str(U64 - 1)).cast("decimal(20,0)")
    number = lambda t: F.when(t.rlike("^[0-9]+$"), F.coalesce(F.least(t.try_cast("decimal(38,0)"), largest), largest)).otherwise(F.lit(0))
    return let(text, number).cast("decimal(20,0)")


def wrap_u64(n: Column) -> Column:
    return F.pmod(n.cast("decimal(38,0)"), F.lit(str(U64)).cast("decimal(38,0)")).cast("decimal(20,0)")


def project(doc: Column | str, names: Sequence[str]) -> Column:
    """The listed top-level fields that exist, keys sorted; any other text passes through; no names: the whole."""
    if not names:
        return column(doc)
    kept = F.map_filter(as_map(doc), lambda k, _: k.isin(*names))
    return F.coalesce(F.to_json(let(kept, sorted_map)), column(doc))


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), 0)


def as_map(doc: Column | str) -> Column:
    """A JSON object as a map of variants; null for anything else."""
    return F.try_variant_get(F.try_parse_json(column(doc)), "$", "map<string,variant>")


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("key"), F.element_at(m, k).alias("value"))))


def set_field(m: Column, name: str, value: Any) -> Column:
    new = F.create_map(F.lit(name), F.parse_json(F.lit(json.dumps(value))))
    return F.map_concat(F.map_filter(m, lambda k, _: k != name), new)


def set_if_absent(m: Column, name: str, value: Any) -> Column:
    return F.when(F.map_contains_key(m, name), m).otherwise(set_field(m, name, value))


def incr_u64(m: Column, name: str, by: int) -> Column:
    """Add to a field modulo 2^64; one that is no unsigned number counts as 0."""
    old = F.when(F.map_contains_key(m, name), F.to_json(F.create_map(F.lit("v"), F.element_at(m, F.lit(name)))))
    n = wrap_u64(u64(F.coalesce(F.regexp_extract(old, r'^\{"v":([0-9]+)\}$', 1), F.lit(""))) + F.lit(str(by % U64)).cast("decimal(20,0)"))
    return F.map_concat(F.map_filter(m, lambda k, _: k != name), F.create_map(F.lit(name), F.parse_json(n.cast("string"))))


def clear_field(m: Column, name: str) -> Column:
    return F.map_filter(m, lambda k, _: k != name)


#: Codes of the mutation operations.
MUTATIONS = {1: set_field, 2: set_if_absent, 3: incr_u64, 8: clear_field}


def _step(op: dict):
    return lambda m: clear_field(m, op["f"]) if op["op"] == 8 else MUTATIONS[op["op"]](m, op["f"], op.get("v"))


def mutate(doc: Column | str, ops: Sequence[dict]) -> Column:
    """Apply {op, f, v} operations in order; the result's keys are sorted. Null if doc is no object."""
    m = as_map(doc)
    for op in ops:
        if not op.get("f"):
            raise ValueError("a mutation names its field")
        if op.get("op") not in MUTATIONS:
            raise ValueError(f"no such mutation: {op.get('op')}")
        m = let(m, _step(op))
    return F.to_json(let(m, sorted_map))


def filter_column(doc: Column | str, spec: Any) -> Column:
    """A filter {eq: [f, v], ge: [f, v], and: [...]}; none: everything; malformed: nothing."""
    if spec is None:
        return F.lit(True)
    if not isinstance(spec, dict) or set(spec) - {"eq", "ge", "and"}:
        return F.lit(False)
    out = F.lit(True)
    for sub in spec.get("and") or []:
        out &= filter_column(doc, sub)
    for name, test in (("eq", field_eq), ("ge", field_ge)):
        args = spec.get(name)
        if args:
            if not isinstance(args, list) or len(args) != 2 or not isinstance(args[0], str):
                return F.lit(False)
            out &= test(doc, *args)
    return out
