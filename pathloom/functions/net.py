"""Addresses, networks and AS numbers in one canonical text form.

All functions are Column expressions. Null and blank text give null. Text that is no address, network
or number is kept as it is, trimmed and in lower case, so that it still equals itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_V4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z"
_V6 = r"^[0-9a-f:]*:[0-9a-f:.]*\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeezed(text: Column) -> Column:
    """Lower case, without any white space; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(text, r"[\s ]+", "")), F.lit(""))


def _octets(address: Column) -> list[Column]:
    return [F.substring_index(F.substring_index(address, ".", i), ".", -1).cast("int") for i in range(1, 5)]


def _v4_number(address: Column) -> Column:
    a, b, c, d = _octets(address)
    return a.cast("bigint") * 16777216 + b * 65536 + c * 256 + d


def _v4(address: Column, length: Column) -> Column:
    """Only the first `length` bits kept, octet by octet."""
    octets = _octets(address)
    fine = length.between(0, 32)
    for o in octets:
        fine = fine & (o <= 255)
    free = [F.greatest(F.lit(0), F.least(F.lit(8), F.lit(8 * i + 8) - length)) for i in range(4)]  # bits to clear
    kept = [o.bitwiseAND(F.lit(256) - F.call_function("shiftleft", F.lit(1), f)) for o, f in zip(octets, free, strict=True)]
    return F.when(fine, F.concat_ws(".", *[k.cast("string") for k in kept]))


def _v6_nibbles(address: Column) -> Column:
    """32 hexadecimal digits; null where the text is no IPv6 address."""
    tail = F.regexp_extract(address, r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})\z", 1)
    as_groups = lambda n: F.concat(
        F.lpad(F.lower(F.hex(F.shiftright(n, 16))), 4, "0"), F.lit(":"), F.lpad(F.lower(F.hex(n.bitwiseAND(65535))), 4, "0")
    )
    plain = F.when(
        F.contains(address, F.lit(".")),
        F.concat(F.expr("''"), F.regexp_replace(address, r"[0-9.]+\z", ""), let(_v4_number(tail), as_groups)),
    ).otherwise(address)

    def padded(groups: Column) -> Column:
        return F.translate(F.regexp_replace(F.regexp_replace(groups, r"([0-9a-f]+)", "000$1"), r"[0-9a-f]*([0-9a-f]{4})", "$1"), ":", "")

    def filled(a: Column) -> Column:
        left, right = padded(F.substring_index(a, "::", 1)), padded(F.substring_index(a, "::", -1))
        gap = F.lit(32) - F.length(left) - F.length(right)
        short = F.when(gap > 0, F.concat(left, F.call_function("repeat", F.lit("0"), gap), right))
        return F.when(F.contains(a, F.lit("::")), short).otherwise(padded(a))

    return let(plain, lambda a: let(filled(a), lambda n: F.when(F.length(n) == 32, n)))


def _v6_masked(nibbles: Column, length: Column) -> Column:
    """Only the first `length` bits kept."""
    whole, rest = F.floor(length / 4).cast("int"), length % 4
    digit = F.substr(nibbles, whole + 1, F.lit(1))
    kept = [F.translate(digit, "0123456789abcdef", t) for t in ("0000000088888888", "000044448888cccc", "0022446688aaccee")]
    part = F.when(rest == 1, kept[0]).when(rest == 2, kept[1]).when(rest == 3, kept[2]).otherwise(F.lit(""))
    return F.rpad(F.concat(F.substr(nibbles, F.lit(1), whole), part), 32, "0")


def _v6_text(nibbles: Column) -> Column:
    """The shortest form: no leading zeros, the first of the longest runs of zero groups as `::`."""
    groups = F.regexp_replace(F.regexp_replace(nibbles, r"(.{4})", "$1:"), r"(?<![0-9a-f])0{1,3}(?=[0-9a-f])", "")

    def short(s: Column) -> Column:  # s is ":g:g:g:g:g:g:g:g:"
        runs = F.regexp_extract_all(s, F.lit(r"(?<=:)((?:0:){2,})"), F.lit(1))
        longest = F.aggregate(runs, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))

        def cutout(run: Column) -> Column:
            at = F.call_function("instr", s, F.concat(F.lit(":"), run))
            left = F.substr(s, F.lit(2), F.greatest(at - 2, F.lit(0)))
            right = F.call_function("rtrim", F.lit(":"), F.substr(s, at + 1 + F.length(run)))
            return F.when(run == "", F.btrim(s, F.lit(":"))).otherwise(F.concat(left, F.lit("::"), right))

        return let(longest, cutout)

    return let(F.concat(F.lit(":"), groups), short)


def _given(s: Column) -> Column:
    """The length after the slash: null without slash, -1 if it is no number."""
    return F.when(F.contains(s, F.lit("/")), F.coalesce(F.try_to_number(F.regexp_extract(s, r"/([0-9]{1,3})\z", 1), F.lit("999")).cast("int"), F.lit(-1)))


def _slow(text: Column, with_length: bool) -> Column:
    def build(s: Column) -> Column:
        address = F.substring_index(s, "/", 1)
        v4, v6 = address.rlike(_V4), address.rlike(_V6)
        length = F.coalesce(_given(s), F.when(v4, F.lit(32)).otherwise(F.lit(128)))
        plain = F.when(v4, _v4(address, length)).when(
            v6 & length.between(0, 128), let(_v6_nibbles(address), lambda n: F.when(n.isNotNull(), _v6_text(_v6_masked(n, length))))
        )
        return F.coalesce(F.concat(plain, F.lit("/"), length.cast("string")) if with_length else plain, s)

    return let(squeezed(text), build)


def _network(text: Column, with_length: bool) -> Column:
    """Nearly all texts are canonical or plain IPv4: those stay within generated code."""
    s = F.lower(F.btrim(text))
    octet, group = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])", r"[1-9a-f][0-9a-f]{0,3}"
    if not with_length:
        short = s.rlike(rf"^{octet}(?:\.{octet}){{3}}\z") | (s.rlike(rf"^{group}(?::{group}){{0,4}}::{group}\z"))
        return F.when(short, s).otherwise(_slow(text, False))
    # host bits are zero at a glance
    canonical = s.rlike(rf"^{octet}\.{octet}\.(?:0\.0/(?:1[6-9]|2[0-4])|{octet}\.(?:0/24|{octet}/32))\z")
    length = F.substring_index(s, "/", -1).cast("int")
    v4 = s.rlike(rf"^{octet}(?:\.{octet}){{3}}/(?:[0-9]|[12][0-9]|3[0-2])\z")
    # groups without zeros up to `::`: only the last of them may have bits to clear
    plain6 = s.rlike(rf"^{group}(?::{group}){{0,5}}::/(?:[1-9][0-9]?|1[01][0-9]|12[0-8])\z")
    colons = F.length(s) - F.length(F.call_function("replace", s, F.lit(":"), F.lit("")))
    over = (colons - 1) * 16 - length
    groups = F.substring_index(s, "::", 1)
    last = F.substring_index(groups, ":", -1)
    kept = F.conv(last, 16, 10).cast("int").bitwiseAND(F.lit(65536) - F.call_function("shiftleft", F.lit(1), over))
    head = F.left(groups, F.length(groups) - F.length(last))  # with its colon, if there is one
    cleared = F.when(kept > 0, F.concat(head, F.lower(F.hex(kept)))).otherwise(F.call_function("rtrim", F.lit(":"), head))
    v6 = F.when(over <= 0, s).when(over < 16, F.concat(cleared, F.lit("::/"), length.cast("string"))).otherwise(_slow(text, True))
    masked = F.concat(_v4(F.substring_index(s, "/", 1), length), F.lit("/"), length.cast("string"))
    return F.when(canonical, s).when(plain6, v6).when(v4, masked).otherwise(_slow(text, True))


def network(text: Column) -> Column:
    """A network such as `10.1.0.0/24` or `2001:db8:1::/48`: shortest lower-case form, host bits cleared.

    An address without length counts as its own network (/32 or /128).
    """
    return _network(text, True)


def address(text: Column) -> Column:
    """An IPv4 or IPv6 address in its shortest lower-case form."""
    return _network(text, False)


def as_number(text: Column) -> Column:
    """An AS number as plain decimal text: `AS64500` is 64500, asdot `15.16960` is 15 * 65536 + 16960."""

    def build(s: Column) -> Column:
        high, low = F.substring_index(s, ".", 1), F.substring_index(s, ".", -1)
        dotted = F.when(s.rlike(r"^[0-9]{1,9}\.[0-9]{1,9}\z"), high.cast("bigint") * 65536 + low.cast("bigint")).cast("string")
        plain = F.when(s.rlike(r"^[0-9]+\z"), F.regexp_replace(s, "^0+(?=[0-9])", ""))
        return F.coalesce(dotted, plain, s)

    slow = let(F.nullif(F.regexp_replace(squeezed(text), "^asn?(?=[0-9])", ""), F.lit("")), build)
    return F.when(text.rlike(r"^[1-9][0-9]*\z"), text).otherwise(slow)
