"""Property bags: JSON objects as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipewright.functions.arrays import _string, json_value
from pipewright.functions.base import QueryError, Val, function


def entries(json_text: Column) -> Column:
    """map<string,string> of an object's members; strings are unquoted, other values JSON text."""
    return F.from_json(json_text, "map<string,string>")


def raw_entries(json_text: Column) -> Column:
    """map<string,variant>: keeps the members' types."""
    return F.from_json(json_text, "map<string,variant>")


def from_pairs(pairs: list[tuple[Column, Column]]) -> Column:
    """An object from (key text, JSON value text)."""
    if not pairs:
        return F.lit("{}")
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(_string(k), F.lit(":"), v) for k, v in pairs]), F.lit("}"))


@function("bag_pack pack pack_dictionary", 2, None)
def _bag_pack(frame, *xs):
    if len(xs) % 2:
        raise QueryError("bag_pack takes pairs of a key and a value")
    return Val(from_pairs([(k.s, json_value(v)) for k, v in zip(xs[::2], xs[1::2], strict=True)]), frame, json=True)


@function("parse_json todynamic toobject", 1)
def _parse_json(frame, s):
    if s.is_array or s.json:
        return s
    return Val(F.when(F.try_parse_json(s.s).isNotNull(), s.s), frame, json=True)


@function("dynamic_to_json", 1)
def _dynamic_to_json(_, d):
    return F.to_json(F.try_parse_json(d.json_text))


@function("bag_keys treepath", 1)
def _bag_keys(_, d):
    return F.json_object_keys(d.json_text)


@function("bag_has_key", 2)
def _bag_has_key(_, d, k):
    return F.coalesce(F.array_contains(F.json_object_keys(d.json_text), k.s), F.lit(False))


def merge(bags: list[Column]) -> Column:
    """Members of all bags; the first bag that has a key wins, null bags are ignored."""
    empty = F.lit("{}")
    lists = [F.map_entries(raw_entries(F.coalesce(b, empty))) for b in bags]
    everything = F.concat(*lists) if len(lists) > 1 else lists[0]
    names = F.array_distinct(F.transform(everything, lambda e: e["key"]))
    first = lambda n: F.get(F.filter(everything, lambda e: e["key"] == n), 0)["value"]
    return F.to_json(F.map_from_arrays(names, F.transform(names, first)))


@function("bag_merge", 1, None)
def _bag_merge(frame, *bags):
    return Val(merge([b.json_text for b in bags]), frame, json=True)


@function("bag_remove_keys", 2, None)
def _bag_remove_keys(frame, d, *keys):
    gone = keys[0].arr if len(keys) == 1 and (keys[0].is_array or keys[0].json) else F.array(*[k.s for k in keys])
    return Val(F.to_json(F.map_filter(raw_entries(d.json_text), lambda k, v: ~F.array_contains(gone, k))), frame, json=True)


@function("bag_set_key", 3)
def _bag_set_key(frame, d, k, v):
    rest = F.map_filter(raw_entries(F.coalesce(d.json_text, F.lit("{}"))), lambda name, _v: name != k.s)
    added = F.map_from_arrays(F.array(k.s), F.array(F.parse_json(json_value(v))))
    return Val(F.to_json(F.map_concat(rest, added)), frame, json=True)


@function("extract_json extractjson", 2, 3)
def _extract_json(frame, path, s, kind=None):
    p = path.const("the path")
    return Val(F.get_json_object(s.json_text, p if p.startswith("$") else "$." + p), frame, json=True)
