"""Arrays and sets."""

from __future__ import annotations



from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.functions.base import Val, bound, function


@function("pack_array", 1, None)
def _pack_array(frame, *xs):
    if all(x.is_array for x in xs):
        return F.concat(*[x.col for x in xs])
    kinds = {type(x.type) for x in xs if not isinstance(x.type, T.NullType)}
    if len(kinds) <= 1 or all(K.is_number(x.type) for x in xs):
        return F.array(*[x.col for x in xs])
    return Val(json_list(list(xs)), frame, json=True)


def json_value(x: Val) -> Column:
    """A value as JSON text."""
    if x.json:
        return F.coalesce(F.when(x.col.rlike(r'^\s*[\[{"]|^\s*(-?\d[\d.eE+-]*|true|false|null)\s*$'), x.col).otherwise(_string(x.col)), F.lit("null"))
    if isinstance(x.type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.to_json(x.col), F.lit("null"))
    if isinstance(x.type, T.BooleanType) or K.is_number(x.type):
        return F.coalesce(x.col.cast("string"), F.lit("null"))
    if isinstance(x.type, T.NullType):
        return F.lit("null")
    return F.when(x.col.isNull(), "null").otherwise(_string(x.s))


def _string(c: Column) -> Column:
    """A JSON string: the text in a one-element array, without the brackets."""
    j = F.to_json(F.array(c))
    return F.substr(j, F.lit(2), F.char_length(j) - 2)


def json_list(xs: list[Val]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[json_value(x) for x in xs]), F.lit("]"))


@function("strcat_array", 2)
def _strcat_array(_, a, d):
    return F.array_join(F.transform(a.arr, lambda x: x.cast("string")), d.const("the delimiter"))


@function("array_length", 1)
def _array_length(_, a):
    if a.is_array:
        return F.when(a.col.isNotNull(), F.size(a.col)).cast("long")
    return F.json_array_length(a.s).cast("long")


def _like(a: Val, v: Val) -> Column:
    """``v`` as an element of ``a``."""
    kind = a.type.elementType if a.is_array else T.StringType()
    return v.s if isinstance(kind, T.StringType) else v.num.cast(kind) if K.is_number(kind) else v.col.cast(kind)


@function("array_index_of", 2, 5)
def _array_index_of(_, a, v, *_rest):
    return F.coalesce(F.array_position(a.arr, _like(a, v)), F.lit(0)).cast("long") - 1


@function("array_sort_asc", 1, None)
def _sort_asc(_, a, *_rest):
    return F.array_sort(a.arr)


@function("array_sort_desc", 1, None)
def _sort_desc(_, a, *_rest):
    return F.sort_array(a.arr, asc=False)


def _alike(xs: tuple[Val, ...]) -> list[Column]:
    """Arrays of one element type."""
    kinds = {x.type.elementType.simpleString() if x.is_array else "string" for x in xs}
    if len(kinds) == 1 or kinds <= {"int", "bigint", "double"}:
        return [x.arr for x in xs]
    return [F.transform(x.arr, lambda e: e.cast("string")) for x in xs]


@function("array_concat", 1, None)
def _array_concat(_, *xs):
    return F.concat(*_alike(xs))


@function("array_reverse", 1)
def _array_reverse(_, a):
    return F.reverse(a.arr)


@function("array_slice", 3)
def _array_slice(_, a, start, end):
    x = a.arr
    n = F.size(x)
    at = lambda v: F.when(v.int < 0, n + v.int).otherwise(v.int)
    first = F.greatest(at(start), F.lit(0))
    size = at(end) - first + 1
    return F.when(size > 0, F.slice(x, first + 1, size)).otherwise(F.slice(x, F.lit(1), F.lit(0)))


@function("array_sum", 1)
def _array_sum(_, a):
    return F.aggregate(a.reals, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


@function("array_avg", 1)
def _array_avg(_, a):
    x = F.filter(a.reals, lambda e: e.isNotNull())
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda acc, e: acc + e) / F.size(x))


def _member(other: Column, wanted: bool):
    """A predicate of one argument: Spark takes a second one for the index."""
    return lambda e: F.coalesce(F.array_contains(other, e), F.lit(False)) == F.lit(wanted)


@function("set_difference", 2, None)
def _set_difference(_, *xs):
    cols = _alike(xs)
    out = cols[0]
    for other in cols[1:]:
        out = F.filter(out, _member(other, False))
    return out


@function("set_intersect", 2, None)
def _set_intersect(_, *xs):
    cols = _alike(xs)
    out = cols[0]
    for other in cols[1:]:
        out = F.filter(out, _member(other, True))
    return out


@function("set_union", 1, None)
def _set_union(_, *xs):
    return F.array_distinct(F.concat(*_alike(xs)))


@function("set_has_element", 2)
def _set_has_element(_, a, v):
    return F.coalesce(F.array_contains(a.arr, _like(a, v)), F.lit(False))


@function("jaccard_index", 2)
def _jaccard_index(_, a, b):
    x, y = _alike((a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union)


@function("zip", 2, None)
def _zip(_, *xs):
    cols = _alike(xs)
    n = F.greatest(*[F.size(c) for c in cols])
    rows = bound(F.struct(*[c.alias(f"x{k}") for k, c in enumerate(cols)], n.alias("n")), lambda z: F.transform(F.sequence(F.lit(0), z["n"] - 1), lambda i: F.array(*[F.get(z[f"x{k}"], i) for k in range(len(cols))])))
    return F.when(n > 0, rows)


@function("array_iff array_when", 3)
def _array_iff(_, c, t, f):
    cond = c.arr if c.is_array and isinstance(c.type.elementType, T.BooleanType) else F.transform(c.arr, lambda e: F.lower(e.cast("string")).isin("true", "1"))
    a = t.arr if t.is_array or t.json else None
    b = f.arr if f.is_array or f.json else None
    pick = lambda whole, v, i: F.get(whole, i) if whole is not None else v.col
    return F.transform(cond, lambda e, i: F.when(e, pick(a, t, i)).when(~e, pick(b, f, i)))


def _rotate(a: Val, n: Column) -> Column:
    x = a.arr
    size = F.size(x)
    k = F.pmod(n, F.greatest(size, F.lit(1)))
    return F.when(size > 0, F.concat(F.slice(x, k + 1, size), F.slice(x, F.lit(1), k))).otherwise(x)


@function("array_rotate_left", 2)
def _rotate_left(_, a, n):
    return _rotate(a, n.int)


@function("array_rotate_right", 2)
def _rotate_right(_, a, n):
    return _rotate(a, -n.int)


def _shift(a: Val, n: Column, fill: Val | None) -> Column:
    """Positive: to the left."""
    kind = a.type.elementType if a.is_array else T.StringType()
    empty = F.lit(None).cast(kind) if fill is None else fill.col.cast(kind)
    return bound(F.struct(a.arr.alias("x"), n.alias("n")), lambda z: F.transform(z["x"], lambda e, i: F.when((i + z["n"] >= 0) & (i + z["n"] < F.size(z["x"])), F.get(z["x"], i + z["n"])).otherwise(empty)))


@function("array_shift_left", 2, 3)
def _shift_left(_, a, n, fill=None):
    return _shift(a, n.int, fill)


@function("array_shift_right", 2, 3)
def _shift_right(_, a, n, fill=None):
    return _shift(a, -n.int, fill)


@function("array_split", 2)
def _array_split(_, a, at):
    x = a.arr
    size = F.size(x)
    cuts = F.transform(at.arr, lambda e: e.cast("int")) if at.is_array or at.json else F.array(at.int)
    cuts = F.transform(cuts, lambda c: F.greatest(F.least(F.when(c < 0, size + c).otherwise(c), size), F.lit(0)))
    begins, ends = F.concat(F.array(F.lit(0)), cuts), F.concat(cuts, F.array(size))
    return F.zip_with(begins, ends, lambda b, e: F.slice(x, b + 1, F.greatest(e - b, F.lit(0))))


@function("range", 2, 3)
def _range(_, a, b, step=None):
    if K.is_time(a.type):
        s = step.span
        forward = (b.t >= a.t) == (K.span_micros(s) > 0)
        return F.when(forward, F.sequence(a.t, b.t, s)).otherwise(F.array().cast("array<timestamp_ntz>"))
    whole = all(K.is_integral(x.type) for x in (a, b, *([step] if step else [])))
    if whole:
        s = F.lit(1).cast("long") if step is None else step.long
        return F.when((b.long - a.long) * s >= 0, F.sequence(a.long, b.long, s)).otherwise(F.array().cast("array<bigint>"))
    s = F.lit(1.0) if step is None else step.real
    n = F.floor((b.real - a.real) / s + 1e-9).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: a.real + i * s)).otherwise(F.array().cast("array<double>"))


