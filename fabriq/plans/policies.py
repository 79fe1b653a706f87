"""Policies compiled to columns: statements run in order as nested conditions, in one projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import network


@dataclass
class Statement:
    """If when holds (None: always): set attributes, then accept, reject, or with accept None go on."""

    when: Column | None = None
    set: dict[str, Column] = field(default_factory=dict)
    accept: bool | None = None


def run(routes: DataFrame, policy: list[Statement], default: bool) -> DataFrame:
    """routes with what the policy sets, and action PERMIT or DENY.  A rejected route keeps what it had."""
    out = routes.withColumn("__done", F.lit(None).cast("boolean"))
    given = {c: F.col(c) for s in policy for c in s.set}
    out = out.withColumns({f"__{c}": v for c, v in given.items()})
    for s in policy:
        hit = F.col("__done").isNull() & (F.coalesce(s.when, F.lit(False)) if s.when is not None else F.lit(True))
        new = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in s.set.items()}
        out = out.withColumns({"__hit": hit})
        out = out.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in s.set.items()}) if new else out
        if s.accept is not None:
            out = out.withColumn("__done", F.when(F.col("__hit"), F.lit(s.accept)).otherwise(F.col("__done")))
    ok = F.coalesce("__done", F.lit(default))
    out = out.withColumns({c: F.when(ok, F.col(c)).otherwise(F.col(f"__{c}")) for c in given} | {"action": F.when(ok, "PERMIT").otherwise("DENY")})
    return out.drop("__done", "__hit", *(f"__{c}" for c in given))


def compare(routes: DataFrame, first: list[Statement], second: list[Statement], attributes: list[str], default: bool = False) -> DataFrame:
    """Routes on which two policies differ, with both actions and the outcomes of attributes; other columns stay as they came in."""
    touched = list(dict.fromkeys([*attributes, *(c for s in [*first, *second] for c in s.set)]))
    keep = routes.withColumns({f"in_{c}": F.col(c) for c in touched})
    a = run(keep, first, default).withColumnRenamed("action", "first_action").withColumns({f"first_{c}": F.col(c) for c in attributes})
    a = a.withColumns({c: F.col(f"in_{c}") for c in touched})  # the second policy starts from what the first one got
    b = run(a, second, default).withColumnRenamed("action", "second_action").withColumns({f"second_{c}": F.col(c) for c in attributes})
    differ = F.col("first_action") != F.col("second_action")
    for c in attributes:
        differ = differ | ((F.col("first_action") == "PERMIT") & ~F.col(f"first_{c}").eqNullSafe(F.col(f"second_{c}")))
    others = [c for c in touched if c not in attributes]
    return b.withColumns({c: F.col(f"in_{c}") for c in others}).where(differ).drop(*attributes, *(f"in_{c}" for c in touched))


def peer_groups(peers: DataFrame, policies: dict[str, list[Statement]], routes: DataFrame, attributes: list[str], key: list[str]) -> DataFrame:
    """(group, policy, base, key..., first_action, second_action): routes that a peer group's policies treat otherwise than its most used one.

    peers: (group, peer, policy).  Policies of one name are equal and not compared; ties for the most used go to the first name.  The routes'
    names of attributes may not begin with in_, first_ or second_.
    """
    use = peers.groupBy("group", "policy").agg(F.count_distinct("peer").alias("n"))
    base = use.groupBy("group").agg(F.min(F.struct(-F.col("n"), "policy")).alias("b")).select("group", F.col("b.policy").alias("base"))
    pairs = use.join(base, "group").where("policy <> base").select("group", "policy", "base")
    out = None
    for a in sorted(policies):
        for b in sorted(policies):
            if a != b:
                differ = compare(routes, policies[a], policies[b], attributes).select(*key, "first_action", "second_action")
                got = pairs.where((F.col("policy") == a) & (F.col("base") == b)).crossJoin(differ)  # the groups that use this pair of policies
                out = got if out is None else out.unionByName(got)
    return out


def route_filter(net: Column, plen: Column, lines: list[tuple[int, int, int, int, str]], default: str = "DENY") -> Column:
    """First line (base, base length, least length, most length, action) that holds the prefix."""
    out = F.lit(default)
    for base, size, lo, hi, action in reversed(lines):
        out = F.when((network(net, F.lit(size)) == base) & plen.between(lo, hi), action).otherwise(out)
    return out


def rewrite(flows: DataFrame, rules: list[tuple[Column, dict[str, Column]]], columns: list[str]) -> DataFrame:
    """new_ columns by the first rule that holds; others stay as they are."""
    out = {}
    for c in columns:
        value = F.col(c)
        for cond, sets in reversed(rules):
            value = F.when(cond, sets.get(c, F.col(c))).otherwise(value)
        out[f"new_{c}"] = value
    return flows.withColumns(out)
