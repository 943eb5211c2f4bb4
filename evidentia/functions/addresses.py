"""IP addresses as keys that sort by number: the family, 4 or 6, and 8 or 32 hexadecimal digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789abcdef"
#: After every address of a family that begins with what stands before it, and before the next one.
AFTER = "~"


def _let(value: Column, rest: Callable[[Column], Column]) -> Column:
    """rest of a value that is computed once, however often rest names it."""
    return F.get(F.transform(F.array(value), rest), F.lit(0))


def _hex4(ip: Column) -> Column:
    """The digits of an IPv4 address, or null."""
    parts = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("int"))
    right = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(right, _let(parts, lambda p: F.when(F.forall(p, lambda x: x <= 255), F.array_join(F.transform(p, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), ""))))


def _groups(part: Column) -> Column:
    return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))


def _hex6(plain: Column) -> Column:
    """The digits of an IPv6 address whose groups are all hexadecimal, or null."""
    def of_groups(g: Column) -> Column:
        missing = 8 - F.size(g["left"]) - F.size(g["right"])
        every = F.concat(g["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), g["right"])
        fits = F.when(g["halves"] == 2, missing >= 1).otherwise((g["halves"] == 1) & (missing == 0))
        return F.when(fits & F.forall(every, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(every, lambda x: F.lpad(x, 4, "0")), ""))

    def of_halves(h: Column) -> Column:
        right = F.when(F.size(h) == 2, _groups(F.get(h, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        return _let(F.struct(_groups(F.get(h, F.lit(0))).alias("left"), right.alias("right"), F.size(h).alias("halves")), of_groups)

    return _let(F.split(plain, "::", -1), of_halves)


def address_key(ip: Column) -> Column:
    """The key of an IPv4 or IPv6 address, in any of its spellings; null for what is no address. A zone (%eth0) is left out; an IPv4 address
    within an IPv6 one (::ffff:10.0.0.1) stays IPv6."""
    def of_bare(bare: Column) -> Column:
        tail = F.regexp_extract(bare, r":(\d+\.\d+\.\d+\.\d+)$", 1)
        spelled = _let(_hex4(tail), lambda x: F.concat(F.regexp_replace(bare, r"\d+\.\d+\.\d+\.\d+$", ""), F.substring(x, 1, 4), F.lit(":"), F.substring(x, 5, 4)))
        six = _let(F.when(tail == "", bare).otherwise(spelled), _hex6)
        return F.when(bare.contains(":"), F.concat(F.lit("6"), six)).otherwise(F.concat(F.lit("4"), _hex4(bare)))

    return _let(F.regexp_replace(F.lower(F.trim(ip)), "%.*$", ""), of_bare)


def _cut(key: Column, bits: Column, rest: str) -> Column:
    """The first `bits` bits of a key, and all others 0 or 1."""
    whole = F.floor(bits / 4).cast("int")
    own = F.instr(F.lit(DIGITS), F.substring(key, whole + 2, F.lit(1))) - 1
    mask = F.element_at(F.array(*map(F.lit, (0, 8, 12, 14))), (bits % 4).cast("int") + 1)
    part = own.bitwiseAND(mask) if rest == "0" else own.bitwiseAND(mask).bitwiseOR(15 - mask)
    digit = F.when(bits % 4 == 0, F.lit("")).otherwise(F.substring(F.lit(DIGITS), part + 1, F.lit(1)))
    return F.rpad(F.concat(F.substring(key, F.lit(1), whole + 1), digit), F.length(key), F.lit(rest))


def first_key(key: Column, bits: Column) -> Column:
    """The key of the first address that shares `bits` bits with key."""
    return _cut(key, bits, "0")


def last_key(key: Column, bits: Column) -> Column:
    return _cut(key, bits, "f")


def prefix_bits(network: Column, key: Column) -> Column:
    """The bits of a network's prefix, as in 10.0.0.0/8, or all bits of an address alone; null if there are more than the family has. key is the
    network's address_key."""
    most = (F.length(key) - 1) * 4
    given = F.when(network.contains("/"), F.regexp_extract(network, r"/(\d{1,3})$", 1).try_cast("int")).otherwise(most)
    return F.when(given <= most, given)
