r"""Small languages that pick nodes, interfaces, filters, locations, addresses, applications, protocols, policies and values.

All share one grammar of sets: ``,`` (or) binds least, then ``\`` (without), then ``&`` (and); parentheses group, ``!`` negates, ``/regex/`` searches,
``f(x)`` calls, and ``a[b]`` says b of a.  A specifier compiles to one condition on a table's columns, so that it is pushed into the scan.
Null behaviour: a null name, role or address is picked by nothing but ``all`` and a negation of it by nothing either.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import wildcard_matches
from ..operators.headers import APPLICATIONS, ICMP_TYPES, PROTOCOLS

TOKEN = re.compile(r"\s*(?:/((?:\\/|[^/])*)/|([A-Za-z0-9_.:\-*~][^\s,&\\()\[\]!]*)|([&,\\()\[\]!]))")


class SpecifierError(ValueError):
    pass


@dataclass
class Grammar:
    """What a word, a regex and each function mean; functions get the compiled or, where their name is in raw, the plain argument."""

    word: Callable[[str], Column]
    regex: Callable[[str], Column] | None = None
    functions: dict[str, Callable] = field(default_factory=dict)
    raw: set[str] = field(default_factory=set)
    inner: dict[str, Callable[[str], Column]] = field(default_factory=dict)  # compilers of functions' arguments
    of: Callable[[str, str], Column] | None = None  # a[b] of the two texts

    def compile(self, text: str) -> Column:
        tokens, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SpecifierError(f"at {at}: {text[at:at + 20]!r}")
            tokens.append(m)
            at = m.end()
        pos = 0

        def peek() -> str | None:
            return tokens[pos][3] if pos < len(tokens) else None

        def chain(level: int) -> Column:
            nonlocal pos
            if level == 3:
                return atom()
            sign = ",\\&"[level]
            left = chain(level + 1)
            while peek() == sign:
                pos += 1
                right = chain(level + 1)
                left = left | right if sign == "," else left & ~right if sign == "\\" else left & right
            return left

        def enclosed(close: str) -> str:
            """The text up to the matching bracket, which is passed."""
            nonlocal pos
            open_, depth, start = {")": "(", "]": "["}[close], 1, tokens[pos].start() if pos < len(tokens) else len(text)
            while pos < len(tokens):
                sign = tokens[pos][3]
                depth += (sign == open_) - (sign == close)
                pos += 1
                if not depth:
                    return text[start : tokens[pos - 1].start(3)].strip()
            raise SpecifierError(f"{close!r} is missing")

        def atom() -> Column:
            nonlocal pos
            if pos >= len(tokens):
                raise SpecifierError("it ends too soon")
            m, begin = tokens[pos], pos
            pos += 1
            if m[3] == "!":
                return ~atom()
            if m[3] == "(":
                inner = chain(0)
                if peek() != ")":
                    raise SpecifierError("a parenthesis is open")
                pos += 1
                out = inner
            elif m[1] is not None:
                if self.regex is None:
                    raise SpecifierError("no regular expression can stand here")
                out = self.regex(m[1].replace(r"\/", "/"))
            elif m[2] is not None and peek() == "(":
                name = m[2].lower()
                if name not in self.functions:
                    raise SpecifierError(f"unknown function {m[2]!r}")
                pos += 1
                arg = enclosed(")")
                out = self.functions[name](arg if name in self.raw else self.inner.get(name, self.compile)(arg))
            elif m[2] is not None:
                if peek() == "[":
                    out = None
                else:
                    out = self.word(m[2])
            else:
                raise SpecifierError(f"{m[3]} stands where a name should")
            if peek() == "[":
                if self.of is None:
                    raise SpecifierError("no brackets can stand here")
                outer = text[tokens[begin].start() : tokens[pos].start(3)].strip()
                pos += 1
                return self.of(outer, enclosed("]"))
            return out

        out = chain(0)
        if pos < len(tokens):
            raise SpecifierError(f"{tokens[pos][0].strip()!r} is left over")
        return out


def _named(column: str) -> tuple[Callable[[str], Column], Callable[[str], Column]]:
    """Names whatever their case, and regular expressions that search in them."""
    return lambda x: F.lower(column) == x.lower(), lambda x: F.lower(column).rlike(x.lower()) if x.islower() else F.col(column).rlike(x)


def _equals(column: str) -> Callable[[str], Column]:
    return lambda x: F.lower(column) == x.strip().lower()


def compile_nodes(text: str) -> Column:
    """On (hostname, role, active, type where it is asked for): names, /regex/, role(name), type(name), active(), all()."""
    name, regex = _named("hostname")
    return Grammar(name, regex, {"role": _equals("role"), "type": _equals("type"), "active": lambda _: F.col("active"), "all": lambda _: F.lit(True)}, raw={"role", "type", "active", "all"}).compile(text)


def compile_interfaces(text: str) -> Column:
    """On (hostname, interface, vrf, zone, type, ip, ...): names, /regex/, vrf(), zone(), type(), connectedTo(addresses), node[interface]."""
    name, regex = _named("interface")
    functions = {"vrf": _equals("vrf"), "zone": _equals("zone"), "type": _equals("type"), "connectedto": lambda c: c, "all": lambda _: F.lit(True)}
    return Grammar(name, regex, functions, raw={"vrf", "zone", "type", "all"}, inner={"connectedto": compile_ips}, of=lambda a, b: compile_nodes(a) & compile_interfaces(b)).compile(text)


def compile_filters(text: str) -> Column:
    """On (hostname, filter, interface, direction): names, /regex/, in(interfaces), out(interfaces), node[filter]."""
    name, regex = _named("filter")
    way = lambda d: lambda c: (F.col("direction") == d) & c
    return Grammar(name, regex, {"in": way("in"), "out": way("out"), "all": lambda _: F.lit(True)}, raw={"all"}, inner={"in": compile_interfaces, "out": compile_interfaces}, of=lambda a, b: compile_nodes(a) & compile_filters(b)).compile(text)


def compile_locations(text: str) -> Column:
    """On (hostname, interface, kind): nodes or node[interface] (links out of interfaces), enter(...), internet."""
    at = lambda kind, c: (F.col("kind") == kind) & c

    def place(x: str) -> Column:
        return F.col("kind") == "INTERNET" if x.lower() == "internet" else at("INTERFACE", compile_nodes(x))

    def enter(x: str) -> Column:
        inside = re.fullmatch(r"([^\[]+)\[(.*)\]", x.strip(), re.S)
        return at("ENTER", compile_nodes(inside[1]) & compile_interfaces(inside[2]) if inside else compile_nodes(x))

    return Grammar(place, lambda x: at("INTERFACE", compile_nodes(f"/{x}/")), {"enter": enter, "role": lambda x: at("INTERFACE", compile_nodes(f"role({x})"))}, raw={"enter", "role"}, of=lambda a, b: at("INTERFACE", compile_nodes(a) & compile_interfaces(b))).compile(text)


def parse_ip(text: str) -> int:
    parts = text.split(".")
    if len(parts) != 4 or not all(p.isdigit() and int(p) < 256 for p in parts):
        raise SpecifierError(f"no address: {text!r}")
    return reduce(lambda a, b: a * 256 + int(b), parts, 0)


def compile_ips(text: str, column: str = "ip", groups: dict[str, list[str]] | None = None) -> Column:
    """On an address: a.b.c.d, a-b, prefixes, base:wildcard, ref.addressGroup(name)."""
    ip = F.col(column)

    def word(x: str) -> Column:
        if "/" in x:
            base, _, plen = x.partition("/")
            if not plen.isdigit() or int(plen) > 32:
                raise SpecifierError(f"no prefix: {x!r}")
            lo = parse_ip(base) >> (32 - int(plen)) << (32 - int(plen))
            return ip.between(lo, lo + (1 << (32 - int(plen))) - 1)
        if ":" in x:
            base, wild = map(parse_ip, x.split(":", 1))
            return wildcard_matches(ip, F.lit(base).cast("long"), F.lit(wild).cast("long"))
        if "-" in x:
            lo, hi = map(parse_ip, x.split("-", 1))
            return ip.between(lo, hi)
        return ip == parse_ip(x)

    def group(x: str) -> Column:
        members = (groups or {}).get(x.split(",")[0].strip())
        if members is None:
            raise SpecifierError(f"no address group {x!r}")
        return reduce(lambda a, b: a | b, map(word, members), F.lit(False))

    return Grammar(word, None, {"ref.addressgroup": group, "all": lambda _: F.lit(True)}, raw={"ref.addressgroup", "all"}).compile(text)


def compile_applications(text: str) -> Column:
    """On (protocol, dst_port, icmp_type, icmp_code): names, /regex/ over names, tcp/80, tcp/80-90, udp/53, icmp, icmp/8, icmp/8/0."""

    def named(x: str) -> Column:
        protocol, lo, hi = APPLICATIONS[x]
        return (F.col("protocol") == protocol) & F.col("dst_port").between(lo, hi)

    def word(x: str) -> Column:
        low = x.lower()
        if low in APPLICATIONS:
            return named(low)
        kind, *rest = low.split("/")
        if kind in ("tcp", "udp") and len(rest) <= 1:
            ok = F.col("protocol") == PROTOCOLS[kind]
            if not rest:
                return ok
            lo, _, hi = rest[0].partition("-")
            if not lo.isdigit() or hi and not hi.isdigit():
                raise SpecifierError(f"no ports: {x!r}")
            return ok & F.col("dst_port").between(int(lo), int(hi or lo))
        if kind == "icmp" and len(rest) <= 2:
            ok = F.col("protocol") == 1
            for column, value in zip(("icmp_type", "icmp_code"), rest):
                if not (value.isdigit() or value in ICMP_TYPES):
                    raise SpecifierError(f"no ICMP type or code: {x!r}")
                ok = ok & (F.col(column) == (int(value) if value.isdigit() else ICMP_TYPES[value]))
            return ok
        raise SpecifierError(f"unknown application {x!r}")

    return Grammar(word, lambda p: reduce(lambda a, b: a | b, [named(n) for n in APPLICATIONS if re.search(p, n, re.I)], F.lit(False))).compile(text)


def compile_protocols(text: str, column: str = "protocol") -> Column:
    """On a protocol's number: names and numbers, ! and sets of them."""

    def word(x: str) -> Column:
        if x.isdigit() and int(x) < 256:
            return F.col(column) == int(x)
        if x.lower() not in PROTOCOLS:
            raise SpecifierError(f"unknown protocol {x!r}")
        return F.col(column) == PROTOCOLS[x.lower()]

    # a list of nothing but negations starts from everything
    parts = [p.strip() for p in text.split(",")]
    if parts and all(p.startswith("!") for p in parts):
        return reduce(lambda a, b: a & b, [Grammar(word).compile(p) for p in parts])
    return Grammar(word).compile(text)


def compile_names(text: str, column: str) -> Column:
    """On a column of names (routing policies, structures): names, /regex/, sets."""
    name, regex = _named(column)
    return Grammar(name, regex).compile(text)


# Groups of dispositions and of routing protocols.
DISPOSITION_GROUPS = {"success": ["ACCEPTED", "DELIVERED_TO_SUBNET", "EXITS_NETWORK"], "failure": ["DENIED_IN", "DENIED_OUT", "NO_ROUTE", "NULL_ROUTED", "NEIGHBOR_UNREACHABLE", "LOOP", "INSUFFICIENT_INFO"]}
PROTOCOL_GROUPS = {"ospf": ["ospf-intra", "ospf-inter", "ospf-ext1", "ospf-ext2"], "isis": ["isis-l1", "isis-l2"], "eigrp": ["eigrp-int", "eigrp-ext"], "bgp": ["ebgp", "ibgp"], "igp": ["ospf-intra", "ospf-inter", "ospf-ext1", "ospf-ext2", "isis-l1", "isis-l2", "eigrp-int", "eigrp-ext", "rip"]}


def values(text: str, allowed: list[str], groups: dict[str, list[str]] | None = None) -> list[str]:
    """The allowed values that a list picks, in their order: values, groups, /regex/, each with ! to take it away; only takings start from all."""
    picked: set[str] = set()
    parts = [p.strip() for p in re.findall(r"!?\s*/(?:\\/|[^/])*/|[^,]+", text) if p.strip()]
    if not parts:
        raise SpecifierError("it ends too soon")
    if all(p.startswith("!") for p in parts):
        picked = set(allowed)
    for p in sorted(parts, key=lambda p: p.startswith("!")):
        minus, p = p.startswith("!"), p.lstrip("!").strip()
        if p.startswith("/"):
            got = {a for a in allowed if re.search(p[1:-1], a, re.I)}
        else:
            got = {a for a in allowed if a.lower() == p.lower()} | {a for a in (groups or {}).get(p.lower(), []) if a in allowed}
            if not got:
                raise SpecifierError(f"unknown value {p!r}")
        picked = picked - got if minus else picked | got
    return [a for a in allowed if a in picked]


COMPILERS: dict[str, Callable[..., Column]] = {"node": compile_nodes, "interface": compile_interfaces, "filter": compile_filters, "location": compile_locations, "ip": compile_ips, "application": compile_applications, "protocol": compile_protocols}


def nodes(df: DataFrame, text: str) -> DataFrame:
    return df.where(compile_nodes(text))


def resolve(kind: str, df: DataFrame, text: str) -> DataFrame:
    """The rows of df that a specifier of the kind picks."""
    if kind not in COMPILERS:
        raise SpecifierError(f"unknown kind {kind!r}")
    return df.where(COMPILERS[kind](text))


def validated(kind: str, df: DataFrame, text: str) -> tuple[str, str]:
    """VALID, NO_MATCH, or INVALID with what is wrong."""
    try:
        got = resolve(kind, df, text)
    except SpecifierError as e:
        return "INVALID", str(e)
    return ("NO_MATCH", "") if got.isEmpty() else ("VALID", "")


def suggestions(metadata: DataFrame, kind: str, typed: str, most: int = 10) -> DataFrame:
    """(text, rank) of the completion metadata (kind, text) for what is typed: names that start with it first, then names that have it, by name."""
    low, query = F.lower("text"), typed.lower()
    rank = F.when(low == query, 0).when(low.startswith(query), 1).otherwise(2)
    got = metadata.where((F.col("kind") == kind) & low.contains(query)).select("text", rank.alias("rank")).distinct()
    return got.orderBy("rank", "text").limit(most)
