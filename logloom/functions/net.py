"""Network addresses: canonical text, sortable keys, prefix tests.

Readers store canonical address text (IPv4-mapped IPv6 unwrapped to IPv4, IPv6
lower case and shortest form), so grouping and class tests work on the text.
IPv4 prefixes become one regular expression per list, which stays inside
generated code. IPv6 prefixes compare a sortable key: a family tag and
fixed-width hex digits, ``4`` + 8 or ``6`` + 32, which can never match the
other family.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_V4_TAIL = r"^(.*:)(\d+\.\d+\.\d+\.\d+)$"
# The usual text of an IPv4-mapped address: what follows the prefix is canonical already.
_MAPPED_HEAD = "::ffff:"
_MAPPED = rf"(?i)^{_MAPPED_HEAD}{_OCTET}(?:\.{_OCTET}){{3}}\z"

# Ranges that never route on the internet (RFC 1918, RFC 6598,
# link-local, loopback, unique local).
PRIVATE_PREFIXES = (
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "100.64.0.0/10",
    "169.254.0.0/16",
    "127.0.0.0/8",
    "fc00::/7",
    "fe80::/10",
    "::1/128",
)
# The IPv6 entries above as patterns on canonical text.
_PRIVATE_V6_TEXT = r"f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|::1$"
# Valid addresses that are neither private nor public
# (unspecified and multicast).
SPECIAL_PREFIXES = ("0.0.0.0/32", "224.0.0.0/4", "::/128", "ff00::/8")
_SPECIAL_V6_TEXT = r"::$|ff[0-9a-f]{2}:"

# Above this many prefixes a filter turns from a pattern into a lookup.
MAX_INLINE_PREFIXES = 50
# A prefix table up to this many rows is broadcast; a longer one is shuffled.
MAX_BROADCAST_PREFIXES = 100_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, so a body that uses it often stays small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v4_hex(c: Column) -> Column:
    octets = F.split(c, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(octets, F.lit(i)).try_cast("bigint")
    return F.lpad(F.hex(number), 8, "0")


def _v6_digits(c: Column) -> Column:
    """The 32 hex digits of an IPv6 text, NULL when it is not one."""

    def hex_tail(bare: Column) -> Column:
        tail = F.regexp_extract(bare, _V4_TAIL, 2)
        return F.when(
            F.rlike(tail, F.lit(_V4)),
            _let(
                F.lower(_v4_hex(tail)),
                lambda h: F.concat(
                    F.regexp_extract(bare, _V4_TAIL, 1), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)
                ),
            ),
        ).otherwise(bare)

    def groups(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    def expand(halves: Column) -> Column:
        head = groups(F.get(halves, F.lit(0)))
        rest = groups(F.get(halves, F.lit(1)))
        gap = F.array_repeat(F.lit("0"), F.lit(8) - F.size(head) - F.size(rest))
        return (
            F.when(F.size(halves) == 1, head)
            .when((F.size(halves) == 2) & (F.size(head) + F.size(rest) < 8), F.concat(head, gap, rest))
        )

    def digits(full: Column) -> Column:
        valid = (F.size(full) == 8) & F.forall(full, lambda g: F.rlike(g, F.lit("^[0-9a-f]{1,4}$")))
        return F.when(valid, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

    text = hex_tail(F.regexp_replace(F.lower(c), "%.+$", ""))
    return _let(_let(F.split(text, "::", -1), expand), digits)


def _mapped_tail(c: Column) -> Column:
    return F.substring(c, len(_MAPPED_HEAD) + 1, 15)


def _is_mapped(digits: Column) -> Column:
    return F.startswith(digits, F.lit("0" * 20 + "ffff"))


def addr_key(c: Column) -> Column:
    """Sortable key of an address text, NULL when it is not a valid address."""

    def v6(d: Column) -> Column:
        return F.when(_is_mapped(d), F.concat(F.lit("4"), F.upper(F.substring(d, 25, 8)))).otherwise(
            F.concat(F.lit("6"), F.upper(d))
        )

    return F.when(F.rlike(c, F.lit(_V4)), F.concat(F.lit("4"), _v4_hex(c))).when(
        F.rlike(c, F.lit(_MAPPED)), F.concat(F.lit("4"), _v4_hex(_mapped_tail(c)))
    ).when(F.contains(c, F.lit(":")), _let(_v6_digits(c), v6))


def addr_text(c: Column) -> Column:
    """Canonical text of an address, NULL when it is not a valid address."""

    def squeeze(short: Column) -> Column:
        out = short
        for run in range(2, 9):
            at = rf"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|$)"
            out = F.when(F.rlike(short, F.lit(at)), F.regexp_replace(short, at, "$1::")).otherwise(out)
        return out

    def v6(d: Column) -> Column:
        dotted = F.concat_ws(".", *[F.conv(F.substring(d, 25 + 2 * i, 2), 16, 10) for i in range(4)])
        groups = [F.regexp_replace(F.substring(d, 1 + 4 * i, 4), "^0{1,3}", "") for i in range(8)]
        return F.when(_is_mapped(d), dotted).when(d.isNotNull(), _let(F.concat_ws(":", *groups), squeeze))

    return F.when(F.rlike(c, F.lit(_V4)), c).when(F.rlike(c, F.lit(_MAPPED)), _mapped_tail(c)).when(
        F.contains(c, F.lit(":")), _let(_v6_digits(c), v6)
    )


def parse_prefixes(items: Iterable[str]) -> list[ipaddress.IPv4Network | ipaddress.IPv6Network]:
    """Networks of CIDR texts and bare addresses; host bits are cleared."""
    out = []
    for item in items:
        text = item.strip()
        try:
            net = ipaddress.ip_network(text, strict=False)
        except ValueError as e:
            raise ValueError(f"address {text!r} can't be read: give one address or a network in slash form") from e
        mapped = net.network_address.ipv4_mapped if net.version == 6 and "/" not in text else None
        out.append(ipaddress.ip_network(mapped) if mapped else net)
    return out


def _key_bounds(net) -> tuple[str, str]:
    width = 8 if net.version == 4 else 32
    return tuple(f"{net.version}{int(a):0{width}X}" for a in (net.network_address, net.broadcast_address))


def _v4_pattern(net: ipaddress.IPv4Network) -> str:
    """Pattern on dotted text: fixed octets, then one octet range."""
    octets = str(net.network_address).split(".")
    whole, bits = divmod(net.prefixlen, 8)
    parts = [rf"{o}\." for o in octets[:whole]]
    if whole == 4:
        return r"\.".join(octets) + "$"
    if bits:
        first = int(octets[whole])
        span = range(first, first + (1 << (8 - bits)))
        parts.append("(?:" + "|".join(map(str, span)) + ")" + (r"\." if whole < 3 else "$"))
    return "".join(parts) or r"\d+\."


def in_prefixes(c: Column, prefixes: Sequence[str]) -> Column:
    """True when the canonical address lies in any prefix; False for NULL."""
    nets = parse_prefixes(prefixes)
    v4 = [_v4_pattern(n) for n in ipaddress.collapse_addresses(n for n in nets if n.version == 4)]
    v6 = [_key_bounds(n) for n in ipaddress.collapse_addresses(n for n in nets if n.version == 6)]
    hit = F.lit(False)
    if v4:
        hit = F.rlike(c, F.lit("^(?:" + "|".join(v4) + ")"))
    if v6:

        def any_range(key: Column) -> Column:
            out = F.lit(False)
            for lo, hi in v6:
                out = out | key.between(lo, hi)
            return out

        hit = hit | (F.contains(c, F.lit(":")) & _let(addr_key(c), any_range))
    return F.coalesce(hit, F.lit(False))


def _class_pattern(prefixes: Sequence[str], v6_text: str) -> str:
    v4 = [_v4_pattern(n) for n in parse_prefixes(prefixes) if n.version == 4]
    return "^(?:" + "|".join(v4) + "|" + v6_text + ")"


_PRIVATE = _class_pattern(PRIVATE_PREFIXES, _PRIVATE_V6_TEXT)
_NOT_PUBLIC = _class_pattern(PRIVATE_PREFIXES + SPECIAL_PREFIXES, _PRIVATE_V6_TEXT + "|" + _SPECIAL_V6_TEXT)


def is_private(c: Column) -> Column:
    """Canonical address inside a private range; False for NULL."""
    return F.coalesce(F.rlike(c, F.lit(_PRIVATE)), F.lit(False))


def is_public(c: Column) -> Column:
    """Canonical unicast address outside every private range; False for NULL."""
    return F.coalesce(~F.rlike(c, F.lit(_NOT_PUBLIC)), F.lit(False))


def endpoint(addr: Column, port: Column) -> Column:
    """``10.0.1.20:22`` or ``[fd00::5]:5432``."""
    return F.when(
        F.contains(addr, F.lit(":")), F.concat(F.lit("["), addr, F.lit("]:"), port.cast("string"))
    ).otherwise(F.concat(addr, F.lit(":"), port.cast("string")))


def _digit_prefixes(prefixes: Sequence[str]) -> list[str]:
    """Leading digits of address keys that the prefixes cover, the version first.

    A prefix that ends inside a hex digit stands as the up to eight digits it covers. Prefixes are disjoint, so no
    address begins with two of the entries.
    """
    nets = parse_prefixes(prefixes)
    out = []
    for version in (4, 6):
        for net in ipaddress.collapse_addresses(n for n in nets if n.version == version):
            digits = -(-net.prefixlen // 4)
            lo = _key_bounds(net)[0][1 : 1 + digits]
            if not digits:
                out.append(str(version))
                continue
            first = int(lo, 16)
            out += [f"{version}{first + k:0{digits}X}" for k in range(1 << (4 * digits - net.prefixlen))]
    return out


def where_any_in(df: DataFrame, columns: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Rows where any of the address columns lies in any of the prefixes.

    Short lists are one predicate. Long lists are looked up by equal keys: an address is cut to each length the list
    has and meets one entry at most, so no row is compared with many entries and none is repeated. Lists of checked
    length are broadcast and the rows stay where they are. For longer ones the distinct addresses are looked up, and
    rows meet the addresses found; a hot address is split by the join's skew handling.
    """
    if len(prefixes) <= MAX_INLINE_PREFIXES:
        hit = F.lit(False)
        for name in columns:
            hit = hit | in_prefixes(F.col(name), prefixes)
        return df.where(hit)
    entries = _digit_prefixes(prefixes)
    listed = df.sparkSession.createDataFrame([(e,) for e in entries], "entry string")
    cuts = sorted({(e[0], len(e)) for e in entries})
    if len(entries) <= MAX_BROADCAST_PREFIXES:
        out, any_hit = df, F.lit(False)
        for i, name in enumerate(columns):
            out = out.withColumn(f"_key{i}", addr_key(F.col(name)))
            for version, digits in cuts:
                entry = f"_entry{i}_{version}_{digits}"
                some = listed.where(F.startswith("entry", F.lit(version)) & (F.length("entry") == digits))
                key = F.substring(f"_key{i}", 1, digits)
                out = out.join(F.broadcast(some.toDF(entry)), key == F.col(entry), "left")
                any_hit = any_hit | F.col(entry).isNotNull()
        return out.where(any_hit).select(*df.columns)
    addresses = df.select(F.explode(F.array(*columns)).alias("address")).where("address is not null").distinct()
    lengths = F.array(*[F.when(F.startswith("key", F.lit(v)), F.substring("key", 1, n)) for v, n in cuts])
    keyed = addresses.withColumn("key", addr_key(F.col("address"))).select("address", F.explode(lengths).alias("entry"))
    found = keyed.where("entry is not null").join(listed, "entry", "left_semi").select("address").distinct()
    out, any_hit = df, F.lit(False)
    for i, name in enumerate(columns):
        out = out.join(found.toDF(f"_found{i}"), F.col(name) == F.col(f"_found{i}"), "left")
        any_hit = any_hit | F.col(f"_found{i}").isNotNull()
    return out.where(any_hit).select(*df.columns)
