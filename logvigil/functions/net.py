"""IP addresses (F1, F2) in built-in expressions only; IPv6 work sits behind a test for a colon."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
GROUPS = 8
MAPPED = "^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"


def _groups(text: Column) -> Column:
    """Parts between single colons; none for an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def _hex16(high: Column, low: Column) -> Column:
    return F.lower(F.hex(high.cast("bigint") * 256 + low.cast("bigint")))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Name an intermediate value, so that using it often does not copy its expression."""
    return F.transform(F.array(value), use)[0]


def _without_dots(address: Column) -> Column:
    """Lower-case text with a trailing IPv4 part turned into two groups."""
    tail = F.regexp_extract(address, rf":({IPV4})$", 1)
    prefix = F.substring(address, F.lit(1), F.length(address) - F.length(tail))
    groups = _bind(F.split(tail, r"\."), lambda o: F.concat(_hex16(o[0], o[1]), F.lit(":"), _hex16(o[2], o[3])))
    return F.lower(F.when(tail != "", F.concat(prefix, groups)).otherwise(address))


def _expanded(address: Column) -> Column:
    """The eight groups of an IPv6 text without leading zeros, or null where it is not one."""
    def fill(halves: Column) -> Column:
        left, right = _groups(halves[0]), _groups(halves[1])
        missing = F.lit(GROUPS) - F.size(left) - F.size(right)
        return F.when(missing >= 1, F.concat(left, F.array_repeat(F.lit("0"), missing), right))

    def parse(text: Column) -> Column:
        return _bind(F.split(text, "::", -1), lambda halves: F.when(F.size(halves) == 2, fill(halves))
                     .when(F.size(halves) == 1, _groups(text)))

    def check(groups: Column) -> Column:
        valid = (F.size(groups) == GROUPS) & F.forall(groups, lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
        return F.when(valid, F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")))

    return _bind(_bind(_without_dots(address), parse), check)


def _compressed(groups: Column) -> Column:
    """Standard text form: the first of the longest runs of two or more zero groups becomes ``::``."""
    def shorten(joined: Column) -> Column:
        text = F
        for run in range(GROUPS, 1, -1):
            zeros = rf"^(?:(.*?):)??0(?::0){{{run - 1}}}(?::(.*))?$"
            text = text.when(joined.rlike(zeros), F.regexp_replace(joined, zeros, "$1::$2"))
        return text.otherwise(joined)

    return _bind(F.array_join(groups, ":"), shorten)


def _with_dots(plain: Column) -> Column:
    """IPv4-mapped addresses are written with dots."""
    high, low = [F.conv(F.regexp_extract(plain, MAPPED, i), 16, 10).cast("bigint") for i in (1, 2)]
    mapped = F.format_string("::ffff:%d.%d.%d.%d", F.shiftright(high, 8), high.bitwiseAND(F.lit(255)),
                             F.shiftright(low, 8), low.bitwiseAND(F.lit(255)))
    return F.when(plain.rlike(MAPPED), mapped).otherwise(plain)


def _canonical_v6(text: Column) -> Column:
    scope = F.regexp_extract(text, "^[^%]*%(.*)$", 1)
    plain = _bind(_compressed(_expanded(F.substring_index(text, "%", 1))), _with_dots)
    return (F.when(F.instr(text, "%") == 0, plain)
            .when(scope.rlike("^[^%]+$"), F.concat(plain, F.lit("%"), scope)))


def clean_ip(raw: Column) -> Column:
    """Canonical address of a text, brackets stripped; null where it is not an address."""
    bare = F.regexp_replace(raw, r"^[\[\]]+|[\[\]]+$", "")
    return F.when(bare.rlike(rf"^{IPV4}\z"), bare).when(F.instr(bare, ":") > 0, _canonical_v6(bare))


def subnet_v4(ip: Column) -> Column:
    return F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))


def subnet(ip: Column) -> Column:
    """/24 of an IPv4 or /64 of an IPv6 address, both given in canonical form."""
    groups = F.slice(_expanded(F.substring_index(ip, "%", 1)), 1, 4)
    network = _compressed(F.concat(groups, F.array_repeat(F.lit("0"), F.lit(4))))
    return F.when(F.instr(ip, ":") > 0, F.concat(network, F.lit("/64"))).otherwise(subnet_v4(ip))
