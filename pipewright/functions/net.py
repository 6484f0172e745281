"""Hashes, URLs and IPv4 addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipewright.functions.bags import from_pairs
from pipewright.functions.arrays import _string
from pipewright.functions.base import Val, function


@function("hash hash_xxhash64", 1, 2)
def _hash(_, x, mod=None):
    h = F.xxhash64(x.col)
    return h if mod is None else F.pmod(h, mod.long)


@function("hash_md5", 1)
def _md5(_, s):
    return F.md5(s.s)


@function("hash_sha1", 1)
def _sha1(_, s):
    return F.sha1(s.s)


@function("hash_sha256", 1)
def _sha256(_, s):
    return F.sha2(s.s, 256)


@function("hash_combine", 2, None)
def _hash_combine(_, *xs):
    out = F.xxhash64(xs[0].col)
    for x in xs[1:]:
        out = out.bitwiseXOR(F.xxhash64(x.col))
    return out


@function("hash_many", 1, None)
def _hash_many(_, *xs):
    return F.xxhash64(*[x.col for x in xs])


def url_parts(s: Column) -> dict[str, Column]:
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?(?:[^@/?#]*@)?([^/:?#]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    names = ("Scheme", "Host", "Port", "Path", "Query", "Fragment")
    return {n: F.regexp_extract(s, pattern, k + 1) for k, n in enumerate(names)}


@function("parse_url", 1)
def _parse_url(frame, s):
    """A bag of Scheme, Host, Port and Path."""
    p = url_parts(s.s)
    return Val(from_pairs([(F.lit(n), _string(p[n])) for n in ("Scheme", "Host", "Port", "Path")]), frame, json=True)


@function("parse_urlquery", 1)
def _parse_urlquery(frame, s):
    return Val(from_pairs([(F.lit("Query"), _string(F.regexp_extract(s.s, r"\?(.+)", 1)))]), frame, json=True)


def address(s: Column) -> Column:
    """The number of a dotted address (a ``/n`` is ignored); null if it is none."""
    bare = F.split_part(F.trim(s), F.lit("/"), F.lit(1))
    parts = F.split(bare, r"\.")
    n = lambda k: F.get(parts, k).try_cast("long")
    fine = bare.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (n(0) < 256) & (n(1) < 256) & (n(2) < 256) & (n(3) < 256)
    return F.when(fine, n(0) * 16777216 + n(1) * 65536 + n(2) * 256 + n(3))


def suffix(s: Column) -> Column:
    """The prefix length of ``a.b.c.d/n``, 32 without one."""
    return F.when(F.contains(s, F.lit("/")), F.split_part(s, F.lit("/"), F.lit(2)).try_cast("int")).otherwise(F.lit(32))


def mask(n: Column, bits: Column) -> Column:
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    return n - F.pmod(n, size)


def dotted(n: Column) -> Column:
    return F.concat_ws(".", *[F.pmod(F.floor(n / d).cast("long"), F.lit(256)).cast("string") for d in (16777216, 65536, 256, 1)])


@function("parse_ipv4", 1)
def _parse_ipv4(_, s):
    return mask(address(s.s), suffix(s.s))


@function("parse_ipv4_mask", 2)
def _parse_ipv4_mask(_, s, bits):
    return mask(address(s.s), bits.int)


@function("ipv4_compare", 2, 3)
def _ipv4_compare(_, a, b, bits=None):
    x, y = address(a.s), address(b.s)
    n = F.least(suffix(a.s), suffix(b.s)) if bits is None else F.least(suffix(a.s), suffix(b.s), bits.int)
    return F.signum(mask(x, n) - mask(y, n)).cast("long")


@function("ipv4_is_match", 2, 3)
def _ipv4_is_match(_, a, b, bits=None):
    n = F.least(suffix(a.s), suffix(b.s)) if bits is None else F.least(suffix(a.s), suffix(b.s), bits.int)
    return mask(address(a.s), n) == mask(address(b.s), n)


@function("ipv4_is_in_range", 2)
def _ipv4_is_in_range(_, ip, cidr):
    n = suffix(cidr.s)
    return mask(address(ip.s), n) == mask(address(cidr.s), n)


@function("ipv4_is_private", 1)
def _ipv4_is_private(_, ip):
    n = address(ip.s)
    return n.between(167772160, 184549375) | n.between(2886729728, 2887778303) | n.between(3232235520, 3232301055)


@function("ipv4_netmask_suffix", 1)
def _netmask_suffix(_, s):
    return suffix(s.s).cast("long")


def _number(x: Val) -> Column:
    return address(x.s) if x.is_string else x.long


@function("format_ipv4", 1, 2)
def _format_ipv4(_, n, bits=None):
    return dotted(_number(n) if bits is None else mask(_number(n), bits.int))


@function("format_ipv4_mask", 1, 2)
def _format_ipv4_mask(_, n, bits=None):
    p = F.lit(32) if bits is None else bits.int
    return F.concat(dotted(mask(_number(n), p)), F.lit("/"), p.cast("string"))
