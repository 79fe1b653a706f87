"""Addresses are bigint (0 to 2^32 - 1); a prefix is its first address and its length."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL = 4294967295


def mask(plen: Column) -> Column:
    """The netmask of a length."""
    return F.lit(1 << 32).cast("long") - F.pow(F.lit(2), 32 - plen).cast("long")


def network(ip: Column, plen: Column) -> Column:
    return ip.bitwiseAND(mask(plen))


def last(ip: Column, plen: Column) -> Column:
    return network(ip, plen) + F.pow(F.lit(2), 32 - plen).cast("long") - 1


def ip_str(ip: Column) -> Column:
    octet = lambda k: F.shiftright(ip, k).bitwiseAND(F.lit(255).cast("long")).cast("string")
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))


def ip_parse(text: Column | str) -> Column:
    """Dotted quad (a column, or its name) to bigint; null if it isn't one."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, r"\.")
    value = lambda k: F.get(parts, F.lit(k)).cast("long")
    ok = text.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")
    total = value(0) * (1 << 24) + value(1) * (1 << 16) + value(2) * (1 << 8) + value(3)
    fits = F.forall(parts, lambda x: x.cast("long") <= 255)
    return F.when(ok, F.when(fits, total))


def mask_bits(m: Column) -> Column:
    """Length of a netmask, null if its ones aren't all in front."""
    flipped = F.lit(ALL).cast("long") - m
    return F.when(flipped.bitwiseAND(flipped + 1) == 0, F.bit_count(m).cast("int"))


def wildcard_matches(ip: Column, base: Column, wild: Column) -> Column:
    """Whether ip agrees with base in every bit that wild leaves 0."""
    return ip.bitwiseXOR(base).bitwiseAND(F.lit(ALL).cast("long") - wild) == 0


def common_prefix_len(a: Column, b: Column) -> Column:
    """Leading bits that two addresses share."""
    x = a.bitwiseXOR(b)
    return F.when(x == 0, 32).otherwise(32 - F.length(F.bin(x))).cast("int")


def eigrp_cost(bandwidth_kbps: Column, delay_tens_us: Column) -> Column:
    """Classic composite metric with the default weights; integer division first, as the formula truncates step by step."""
    return F.expr("256L") * (F.floor(F.lit(10_000_000) / bandwidth_kbps).cast("long") + delay_tens_us)


def ospf_cost(bandwidth: Column, reference: int = 100_000) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.lit(reference) / bandwidth).cast("long"))


def without_private_as(path: Column) -> Column:
    """An AS path less the private numbers (64512-65534 and 4200000000-4294967294)."""
    return F.filter(path, lambda a: ~(a.between(64512, 65534) | a.between(4200000000, 4294967294)))


def prepend(path: Column, asn: Column, times: int = 1) -> Column:
    return F.concat(F.array_repeat(asn, times), path)


def exclude_as(path: Column, asn: Column) -> Column:
    return F.filter(path, lambda a: a != asn)
