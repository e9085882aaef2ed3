"""Scalar expressions: canonical JSON, digests, dates, money, paths, addresses and names."""

from __future__ import annotations

import functools
import ipaddress
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def nfc(c: Column) -> Column:
    """Normalisation form C, for which Spark has no function; null stays null."""

    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return F.pandas_udf(normal, StringType())(c)


def fold_case(c: Column) -> Column:
    return F.lower(F.upper(c))


def single_line(c: Column, most: int | None = None) -> Column:
    """Blanks run together, trimmed, and cut after so many characters with an ellipsis."""
    line = F.trim(F.regexp_replace(c, r"\s+", " "))
    return line if most is None else F.when(F.char_length(line) > most, F.concat(F.rtrim(F.left(line, F.lit(most - 1))), F.lit("…"))).otherwise(line)


def canonical_json(pairs: Column) -> Column:
    """A map of strings as JSON with its keys in order, without blanks."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def content_digest(c: Column) -> Column:
    """The digest field of a text: sha-256=:base64:."""
    return F.concat(F.lit("sha-256=:"), F.base64(F.unhex(F.sha2(c, 256))), F.lit(":"))


def micros(c: Column) -> Column:
    """Money as whole millionths, exactly."""
    return (c.cast("decimal(28,6)") * 1_000_000).cast("decimal(28,0)").cast("long")


def cents(c: Column) -> Column:
    """Halves go up, as x + 0.5 rounded down."""
    return F.floor(c * 100 + 0.5) / 100


def ratio(a: Column, b: Column) -> Column:
    """a / b; infinite where something stands against nothing, 0 where nothing does."""
    return F.when(b != 0, a / b).when(a > 0, F.lit(float("inf"))).otherwise(0.0)


def instant(c: Column) -> Column:
    """A timestamp from yyyy-MM-ddTHH:mm:ss with an optional fraction and zone; null for other text."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(c))


def stale(after: Column, now: Column) -> Column:
    """Whether now is past after: as instants if both are, else as text."""
    a, n = instant(after), instant(now)
    return F.when(a.isNotNull() & n.isNotNull(), a < n).otherwise(after < now)


def resolved_path(folder: Column, target: Column) -> Column:
    """A relative path within a tree, with . and .. worked out; null if it leads out of it."""
    parts = F.filter(F.split(F.concat_ws("/", folder, target), "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, part: Column) -> Column:
        shorter = F.struct(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))).alias("out"), (acc["ok"] & (F.size(acc["out"]) > 0)).alias("ok"))
        return F.when(part == "..", shorter).otherwise(F.struct(F.concat(acc["out"], F.array(part)).alias("out"), acc["ok"].alias("ok")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("ok"))
    return F.aggregate(parts, start, step, lambda a: F.when(a["ok"], F.array_join(a["out"], "/")))


def safe_path(c: Column) -> Column:
    """Whether a path stays below its root: not absolute, no backslash or NUL, no empty or dot part."""
    return ~c.rlike(r"^/|\\|\x00|(^|/)(\.{0,2})(/|$)")


# IPv4 ranges that are not of the public network.
PRIVATE_RANGES = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
)


def address_number(c: Column) -> Column:
    """A dotted IPv4 address as a number; null for other text."""
    parts = F.transform(F.split(c, r"\."), lambda p: p.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    return F.when(c.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), value)


# IPv6 ranges that are not of the public network.
PRIVATE_RANGES_6 = (
    "::/128", "::1/128", "::/96", "::ffff:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "100:0:0:1::/64", "2001::/32", "2001:2::/48",
    "2001:10::/28", "2001:db8::/32", "2002::/16", "3fff::/20", "5f00::/16", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8",
)


def address_digits(c: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits, a dotted end included; null for other text."""
    tail = F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+){3})$", 1)
    number = address_number(tail)
    pair = F.concat(F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"), F.lower(F.hex(number.bitwiseAND(F.lit(65535)))))
    plain = F.when(tail == "", F.lower(c)).when(number.isNotNull(), F.concat(F.lower(F.regexp_replace(c, r"[0-9]+(?:\.[0-9]+){3}$", "")), pair))
    groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
    left, right = groups(F.substring_index(plain, "::", 1)), groups(F.substring_index(plain, "::", -1))
    short = F.contains(plain, F.lit("::"))
    whole = F.when(short, F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)).otherwise(F.split(plain, ":"))
    good = (F.size(whole) == 8) & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & ~plain.rlike("::.*::|:::") & (~short | (F.size(left) + F.size(right) < 8))
    return F.when(good, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))


def refused_address(c: Column) -> Column:
    """Whether an address lies in a range that must not be fetched from."""

    def within(value: Column, bounds: list[tuple]) -> Column:
        # the value is worked out once, as the only entry of an array
        hit = F.transform(F.array(value), lambda v: functools.reduce(lambda a, b: a | v.between(*b), bounds, F.lit(False)))
        return F.coalesce(F.get(hit, F.lit(0)), F.lit(False))

    four, six = ([ipaddress.ip_network(x) for x in blocks] for blocks in (PRIVATE_RANGES, PRIVATE_RANGES_6))
    numbers = [(int(n.network_address), int(n.broadcast_address)) for n in four]
    digits = [(f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}") for n in six]
    return within(address_number(c), numbers) | (F.contains(c, F.lit(":")) & within(address_digits(c), digits))


# Names that some file systems keep for devices.
DEVICE_NAMES = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def same_origin(c: Column, hosts: list[str]) -> Column:
    """Whether an http address is of one of the hosts or of a part of one, and has no query."""
    host = F.lower(F.regexp_extract(c, r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = F.lit(False)
    for h in hosts:
        own = own | (host == h) | host.endswith(f".{h}")
    return F.coalesce(own & ~F.contains(F.substring_index(c, "#", 1), F.lit("?")), F.lit(False))


def portable_name(c: Column) -> Column:
    """Why a file name can't be used everywhere; null if it can."""
    stem = F.lower(F.split_part(c, F.lit("."), F.lit(1)))
    return F.when(F.char_length(c) > 200, "long").when(stem.isin(*DEVICE_NAMES), "device").when(c.rlike(r'[<>:"|?*\\\x00-\x1f]|[. ]$'), "character")
