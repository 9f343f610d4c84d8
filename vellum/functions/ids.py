"""Identifiers of 32 lower-case hex digits: UUID version 7 with kind, collection, shard and counter."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.common import column

PUT, DEL, TRACE, FREEZE, MAP = range(5)
SHARDS = 1024
NIL, MAX = "0" * 32, "f" * 32
_PAYLOAD = 2**62
_TEXT = "^(urn:uuid:)?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def _hex(n: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(n), width, "0"))


def payload(kind: Column, coll: Column, shard: Column, counter: Column) -> Column:
    """62 bits: kind 4, collection byte 8, shard 10, counter 40."""
    parts = [F.shiftleft(column(c).cast("long"), n) for c, n in ((kind, 58), (coll, 50), (shard, 40), (counter, 0))]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])


def compose(ts_ns: Column, bits: Column) -> Column:
    """The version-7 id of a time in nanoseconds and 62 bits of payload."""
    ns = column(ts_ns).cast("long")
    rest = F.pmod(ns, F.lit(1_000_000))
    ms = F.call_function("div", ns - rest, F.lit(1_000_000))
    sub = F.call_function("div", rest * 4096, F.lit(1_000_000))
    return F.concat(_hex(ms, 12), F.lit("7"), _hex(sub, 3), _hex(F.lit(-(2**63)).bitwiseOR(column(bits)), 16))


def compose_text(ts_ns: int, kind: int, coll: str, counter: int) -> str:
    """compose() and payload() for one id, on the driver; the shard is that of the collection's name."""
    first = hashlib.sha256(coll.encode()).digest()
    ms, rest = divmod(ts_ns, 1_000_000)
    bits = kind << 58 | first[0] << 50 | (first[0] << 8 | first[1]) >> 6 << 40 | counter
    return f"{ms:012x}7{rest * 4096 // 1_000_000:03x}{1 << 63 | bits:016x}"


def parse(text: Column) -> Column:
    """Hex of a UUID with or without dashes, or null."""
    t = column(text)
    return F.when(t.rlike(_TEXT), F.lower(F.regexp_replace(F.regexp_replace(t, "^urn:uuid:", ""), "-", "")))


def parse_v7(text: Column) -> Column:
    """As parse(), but null for anything that is no version-7 id of the standard variant."""
    id = parse(text)
    return F.when(is_v7(id), id)


def is_nil(id: Column) -> Column:
    return column(id) == NIL


def is_max(id: Column) -> Column:
    return column(id) == MAX


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: ids order as their text."""
    a, b = column(a), column(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def dashed(id: Column) -> Column:
    c = column(id)
    return F.concat_ws("-", *[F.substring(c, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def version(id: Column) -> Column:
    return F.conv(F.substring(column(id), 13, 1), 16, 10).cast("int")


def variant_ok(id: Column) -> Column:
    """Whether the variant bits are binary 10."""
    return F.substring(column(id), 17, 1).isin("8", "9", "a", "b")


def is_v7(id: Column) -> Column:
    return (version(id) == 7) & variant_ok(id)


def timestamp_ms(id: Column) -> Column:
    return F.conv(F.substring(column(id), 1, 12), 16, 10).cast("long")


def bits62(id: Column) -> Column:
    """The payload: the last 16 digits without the two variant bits."""
    return F.pmod(F.conv(F.substring(column(id), 17, 16), 16, 10).cast("decimal(20,0)"), F.lit(str(_PAYLOAD)).cast("decimal(20,0)")).cast("long")


def kind_of(id: Column) -> Column:
    return F.shiftright(bits62(id), 58).cast("int")


def coll_of(id: Column) -> Column:
    return F.shiftright(bits62(id), 50).bitwiseAND(F.lit(255)).cast("int")


def shard_of(id: Column) -> Column:
    return F.shiftright(bits62(id), 40).bitwiseAND(F.lit(SHARDS - 1)).cast("int")


def counter_of(id: Column) -> Column:
    return bits62(id).bitwiseAND(F.lit(2**40 - 1))


def route(key: Column) -> Column:
    """The shard of a key: the first 10 bits of its digest. Keys of one file share their file's shard."""
    k = column(key).cast("string")
    k = F.when(k.startswith("vfs:"), F.concat_ws(":", F.slice(F.split(k, ":"), 1, 3))).otherwise(k)
    return F.shiftright(F.conv(F.substring(F.sha2(k, 256), 1, 4), 16, 10).cast("int"), 6)


def coll_byte(name: Column) -> Column:
    """One byte that names a collection: the first of its digest."""
    return F.conv(F.substring(F.sha2(column(name), 256), 1, 2), 16, 10).cast("int")


def doc_hash(doc: Column) -> Column:
    """Digest of a document's text."""
    return F.sha2(column(doc), 256)
