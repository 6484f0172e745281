"""String functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipewright.functions.base import Val, function
from pipewright.types import text


def java_regex(pattern: str) -> str:
    """A pattern as Java wants it: named groups without P."""
    return pattern.replace("(?P<", "(?<")


def java_replacement(text: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", text.replace("$", r"\$"))


def quote_regex(x: Val) -> Column:
    """The pattern that matches the text ``x`` itself."""
    if x.is_const:
        return F.lit(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", str(x.value)))
    return F.regexp_replace(x.s, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def pattern_of(x: Val) -> Column:
    return F.lit(java_regex(x.value)) if x.is_const else x.s


@function("tolower", 1)
def _tolower(_, s):
    return F.lower(s.s)


@function("toupper", 1)
def _toupper(_, s):
    return F.upper(s.s)


@function("strlen", 1)
def _strlen(_, s):
    return F.char_length(s.s).cast("long")


@function("strcat", 1, None)
def _strcat(_, *xs):
    return F.concat(*[text(x.col, x.type) for x in xs])


@function("strcat_delim", 2, None)
def _strcat_delim(_, d, *xs):
    return F.concat_ws(d.value, *[x.s for x in xs]) if d.is_const else F.array_join(F.array(*[x.s for x in xs]), d.s)


@function("replace_string replace", 3)
def _replace_string(_, s, a, b):
    return F.replace(s.s, a.s, b.s)


@function("replace_strings", 3)
def _replace_strings(_, s, a, b):
    pairs = F.arrays_zip(a.arr.alias("a"), b.arr.alias("b"))
    return F.aggregate(pairs, s.s, lambda acc, p: F.replace(acc, p["a"], F.coalesce(p["b"], F.lit(""))))


@function("replace_regex", 3)
def _replace_regex(_, s, r, b):
    return F.regexp_replace(s.s, pattern_of(r), F.lit(java_replacement(b.value)) if b.is_const else b.s)


@function("indexof", 2, 4)
def _indexof(_, s, sub, start=None, length=None):
    if start is None:
        return (F.instr(s.s, sub.value) if sub.is_const else F.call_function("locate", sub.s, s.s)).cast("long") - 1
    return F.call_function("locate", sub.s, s.s, start.int + 1).cast("long") - 1


@function("countof", 2, 3)
def _countof(_, s, sub, kind=None):
    if kind is not None and kind.value == "regex":
        return F.coalesce(F.regexp_count(s.s, pattern_of(sub)), F.lit(0)).cast("long")
    size = F.char_length(sub.s)
    return F.when(size > 0, F.floor((F.char_length(s.s) - F.char_length(F.replace(s.s, sub.s, F.lit("")))) / size)).otherwise(F.lit(0)).cast("long")


@function("reverse", 1)
def _reverse(_, s):
    return F.reverse(s.s)


@function("split", 2, 3)
def _split(_, s, d, at=None):
    parts = F.split(s.s, quote_regex(d)) if not (d.is_const and d.value == "") else F.array(s.s)
    if at is None:
        return parts
    one = F.get(parts, at.int)
    return F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


@function("substring", 2, 3)
def _substring(_, s, start, length=None):
    x = s.s
    n = F.char_length(x)
    at = start.int if not start.is_const else F.lit(int(start.value))
    first = F.when(at < 0, F.greatest(n + at, F.lit(0))).otherwise(at) if not (start.is_const and start.value >= 0) else at
    if length is None:
        return F.substr(x, first + 1)
    return F.when(length.int <= 0, "").otherwise(F.substr(x, first + 1, length.int))


@function("trim", 2)
def _trim(_, r, s):
    return F.regexp_replace(F.regexp_replace(s.s, _anchored(r, start=True), ""), _anchored(r, start=False), "")


@function("trim_start", 2)
def _trim_start(_, r, s):
    return F.regexp_replace(s.s, _anchored(r, start=True), "")


@function("trim_end", 2)
def _trim_end(_, r, s):
    return F.regexp_replace(s.s, _anchored(r, start=False), "")


def _anchored(r: Val, start: bool) -> Column:
    if r.is_const:
        return F.lit(f"^(?:{java_regex(r.value)})" if start else f"(?:{java_regex(r.value)})$")
    return F.concat(F.lit("^(?:"), r.s, F.lit(")")) if start else F.concat(F.lit("(?:"), r.s, F.lit(")$"))


@function("extract", 3, 4)
def _extract(_, r, g, s, kind=None):
    return F.regexp_extract(s.s, java_regex(r.const("the pattern")), int(g.const("the group")))


@function("extract_all", 2, 3)
def _extract_all(_, r, a, b=None):
    s = b if b is not None else a
    pattern = java_regex(r.const("the pattern"))
    found = re.compile(pattern.replace("(?<", "(?P<") if "(?<=" not in pattern and "(?<!" not in pattern else pattern).groups
    groups = list(range(1, found + 1)) if b is None or not a.is_const else [int(g) for g in a.value]
    groups = groups or [0]
    if len(groups) == 1:
        return F.regexp_extract_all(s.s, F.lit(pattern), F.lit(groups[0]))
    lists = [F.regexp_extract_all(s.s, F.lit(pattern), F.lit(g)) for g in groups]
    return F.when(F.size(lists[0]) > 0, F.transform(lists[0], lambda _x, i: F.array(*[F.get(x, i) for x in lists]))).otherwise(F.array().cast("array<array<string>>"))


@function("translate", 3)
def _translate(_, a, b, s):
    return F.translate(s.s, a.const("the search list"), b.const("the replacement list"))


@function("strcmp", 2)
def _strcmp(_, a, b):
    return F.when(a.s < b.s, -1).when(a.s == b.s, 0).otherwise(1).cast("long")


@function("string_size", 1)
def _string_size(_, s):
    return F.octet_length(s.s).cast("long")


@function("repeat strrep", 2, 3)
def _repeat(_, s, n, d=None):
    if d is None:
        return F.repeat(s.s, n.int)
    return F.array_join(F.array_repeat(s.s, n.int), d.const("the delimiter"))


@function("unicode", 1)
def _unicode(_, s):
    return F.ascii(s.s).cast("long")


@function("make_string", 1, None)
def _make_string(_, *xs):
    # Code points as UTF-32 are decoded by the JVM: no Python worker.
    one = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "utf-32")
    if len(xs) == 1 and xs[0].is_array:
        return F.array_join(F.transform(xs[0].arr, lambda c: one(c.cast("long"))), "")
    return F.concat(*[one(x.long) for x in xs])


@function("url_encode url_encode_component", 1)
def _url_encode(_, s):
    return F.replace(F.url_encode(s.s), F.lit("+"), F.lit("%20"))


@function("url_decode url_decode_component", 1)
def _url_decode(_, s):
    return F.try_url_decode(s.s)


@function("base64_encode_tostring base64_encode_fromarray base64_encode_fromguid", 1)
def _base64_encode(_, s):
    return F.base64(F.encode(s.s, "utf-8"))


@function("base64_decode_tostring base64_decode_toguid", 1)
def _base64_decode(_, s):
    return F.decode(F.unbase64(s.s), "utf-8")


@function("base64_decode_toarray", 1)
def _base64_decode_toarray(_, s):
    h = F.hex(F.unbase64(s.s))
    n = F.floor(F.char_length(h) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substr(h, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


@function("parse_path", 1)
def _parse_path(_, s):
    return F.regexp_extract(s.s, r"([^/\\]+)$", 1)


@function("to_utf8", 1)
def _to_utf8(_, s):
    return F.encode(s.s, "utf-8")


@function("parse_csv", 1)
def _parse_csv(_, s):
    return F.split(s.s, ",")


@function("tohex", 1, 2)
def _tohex(_, n, width=None):
    h = F.lower(F.hex(n.long))
    return h if width is None else F.when(F.char_length(h) < width.int, F.lpad(h, int(width.const("the width")), "0")).otherwise(h)


@function("has_any_index", 2)
def _has_any_index(_, s, terms):
    low = F.lower(s.s)
    hits = F.transform(terms.arr, lambda t: F.contains(low, F.lower(t.cast("string"))))
    return F.coalesce(F.array_position(hits, F.lit(True)), F.lit(0)).cast("long") - 1


@function("parse_version", 1)
def _parse_version(_, s):
    return F.split(s.s, r"[.]")
