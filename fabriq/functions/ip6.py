"""IPv6 addresses as 32 lower-case hexadecimal digits, whose order as texts is their order as numbers; prefixes as the first and last of them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """Colon notation, with one :: at most, to digits; null if it isn't one (dotted endings included)."""
    low = F.lower(F.trim(text))
    halves = F.split(low, "::")
    groups = lambda h: F.filter(F.split(F.coalesce(h, F.lit("")), ":"), lambda g: g != "")
    head, tail = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    gap = 8 - F.size(head) - F.size(tail)
    all_ = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), tail)
    ok = low.rlike(r"^[0-9a-f:]+$") & (F.size(halves) <= 2) & ~low.rlike(":::") & F.forall(all_, lambda g: F.length(g) <= 4)
    shape = F.when(F.size(halves) == 2, gap >= 1).otherwise((gap == 0) & ~low.rlike("^:|:$"))
    return F.when(ok & shape, F.array_join(F.transform(all_, lambda g: F.lpad(g, 4, "0")), ""))


def _edge(digits: Column, plen: Column, fill: int) -> Column:
    """The digits with all bits behind the first plen set to fill."""
    whole = F.floor(plen / 4).cast("int")
    rest = (plen % 4).cast("int")
    digit = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    keep = F.floor(digit / F.pow(F.lit(2), 4 - rest)).cast("int") * F.pow(F.lit(2), 4 - rest).cast("int")
    edge = keep + (F.pow(F.lit(2), 4 - rest).cast("int") - 1) * fill
    tail = F.when(rest > 0, F.lower(F.conv(edge.cast("string"), 10, 16))).otherwise(F.lit(""))
    return F.rpad(F.concat(F.substr(digits, F.lit(1), whole), tail), 32, "f" if fill else "0")


def network(digits: Column, plen: Column) -> Column:
    return _edge(digits, plen, 0)


def last(digits: Column, plen: Column) -> Column:
    return _edge(digits, plen, 1)


def contains(net: Column, plen: Column, digits: Column) -> Column:
    """Whether the prefix holds the address."""
    return digits.between(network(net, plen), last(net, plen))
