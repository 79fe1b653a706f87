"""Control plane: routes within and between areas and levels, BGP propagation by rules, RIB merging, and how work on prefixes is split.

Propagation is a shortest-path fixpoint over a product of nodes and what a route may still do there; null nodes meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixpoint, tables


def _states(n: int, node: str, state) -> Column:
    return F.col(node) * n + state


def area_costs(edges: DataFrame, borders: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, area, cost): least costs as link-state areas know them.

    edges: (src, dst, weight, area); borders: (node, area), the areas that a node is in; sources: (node, area).  Inside an area the costs are
    the area's own; between areas a path goes once into area 0 and once out of it, at nodes that are in both.
    """
    # state: (node, area, phase); phase 0 in the first area, 1 in area 0, 2 in the last
    walk = edges.select(F.struct(F.col("src").alias("n"), "area").alias("s"), F.struct(F.col("dst").alias("n"), "area").alias("d"), "weight")
    both = borders.join(borders.select("node", F.col("area").alias("other")), "node").where("area <> other")
    zero = F.lit(0).cast("long")
    key = lambda s, k: F.concat_ws("/", s["n"], s["area"], F.lit(k))
    legs = None
    for k in range(3):
        ok = walk.where(F.col("s.area") == 0) if k == 1 else walk
        part = ok.select(key(F.col("s"), k).alias("src"), key(F.col("d"), k).alias("dst"), F.col("weight").cast("long").alias("weight"))
        legs = part if legs is None else legs.unionByName(part)
    up = both.where("other = 0").select(F.concat_ws("/", "node", "area", F.lit(0)).alias("src"), F.concat_ws("/", "node", "other", F.lit(1)).alias("dst"), zero.alias("weight"))
    # a route that starts in area 0 is there already
    down = both.where("area = 0").select("node", "other").crossJoin(F.broadcast(both.sparkSession.createDataFrame([(0,), (1,)], "k int")))
    down = down.select(F.concat_ws("/", "node", F.lit(0), "k").alias("src"), F.concat_ws("/", "node", "other", F.lit(2)).alias("dst"), zero.alias("weight"))
    start = sources.select(F.concat_ws("/", "node", "area").alias("source"), F.concat_ws("/", "node", "area", F.lit(0)).alias("node"))
    got = fixpoint.least_cost(start, legs.unionByName(up).unionByName(down))
    parts = F.split("node", "/")
    return got.select(F.split("source", "/")[0].cast("long").alias("source"), F.split("source", "/")[1].cast("long").alias("source_area"), parts[0].cast("long").alias("node"), parts[1].cast("long").alias("area"), "cost").groupBy("source", "source_area", "node", "area").agg(F.min("cost").alias("cost"))


def external_costs(internal: DataFrame, externals: DataFrame, stubs: DataFrame) -> DataFrame:
    """(node, network, kind, cost, metric): the best external route of each node.

    internal: (source, node, area, cost); externals: (node, network, kind, metric), E1 adds the way to its border and E2 doesn't; stubs: (area), areas
    that externals don't enter.  E1 is preferred to E2, then the cost, then (E2) the way.
    """
    way = internal.join(stubs, "area", "left_anti").groupBy("source", "node").agg(F.min("cost").alias("way"))
    got = way.join(externals.withColumnRenamed("node", "source"), "source")
    got = got.withColumn("cost", F.col("metric") + F.when(F.col("kind") == "E1", F.col("way")).otherwise(0))
    best = got.groupBy("node", "network").agg(F.min(F.struct("kind", "cost", "way")).alias("b"))
    return best.select("node", "network", F.col("b.kind").alias("kind"), F.col("b.cost").alias("cost"))


def level_costs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, node, level, cost): IS-IS routes: level 1 inside an area, level 2 over nodes of the backbone.

    edges: (src, dst, weight); nodes: (node, area, levels): 1, 2 or 12.  A node reaches its area at level 1 where both ends speak it, and others
    at level 2; what both offer is taken at level 1.
    """
    a = nodes.select(F.col("node").alias("src"), F.col("area").alias("sa"), F.col("levels").alias("sl"))
    b = nodes.select(F.col("node").alias("dst"), F.col("area").alias("da"), F.col("levels").alias("dl"))
    e = edges.join(a, "src").join(b, "dst")
    one = e.where("sl <> 2 and dl <> 2 and sa = da").select("src", "dst", "weight")
    two = e.where("sl <> 1 and dl <> 1").select("src", "dst", "weight")
    start = lambda level: nodes.where(f"levels <> {3 - level}").select(F.col("node").alias("source"), "node")
    both = fixpoint.least_cost(start(1), one).withColumn("level", F.lit(1)).unionByName(fixpoint.least_cost(start(2), two).withColumn("level", F.lit(2)))
    return both.groupBy("source", "node").agg(F.min(F.struct("level", "cost")).alias("b")).select("source", "node", "b.level", "b.cost")


def bgp_propagation(origins: DataFrame, sessions: DataFrame) -> DataFrame:
    """(prefix, node, learned, as_hops): how short an AS path each node gets, by the rules of sessions.

    origins: (prefix, node); sessions: (src, dst, kind, client): EBGP, IBGP or CONFED; client: dst is a route reflector's client of src, or src of dst.
    Over IBGP goes only what was originated or learned over EBGP, and to or from clients also what was learned over IBGP; over CONFED, as over EBGP,
    everything, but no AS is counted.  learned: 0 own, EBGP or CONFED; 1 IBGP of a client; 2 IBGP of another.
    """
    s = sessions
    go = []
    for learned in (0, 1, 2):
        for kind, client, to, cost in (("EBGP", None, 0, 1), ("CONFED", None, 0, 0), ("IBGP", True, 1, 0), ("IBGP", False, 2, 0)):
            if learned == 2 and kind == "IBGP" and not client:
                continue
            part = s.where(F.col("kind") == kind) if client is None else s.where((F.col("kind") == kind) & (F.col("client") == client))
            go.append(part.select(_states(3, "src", learned).alias("src"), _states(3, "dst", to).alias("dst"), F.lit(cost).cast("long").alias("weight")))
    edges = go[0]
    for g in go[1:]:
        edges = edges.unionByName(g)
    start = origins.select(F.col("prefix").alias("source"), _states(3, "node", 0).alias("node"))
    got = fixpoint.least_state(start, edges, 3)
    return got.select(F.col("source").alias("prefix"), "node", F.col("rest").alias("learned"), F.col("cost").alias("as_hops"))


def loop_free(routes: DataFrame, path: str, asn: Column, times: int = 0, remote: Column | None = None, remote_out: bool = True) -> DataFrame:
    """Routes that a receiver takes: its AS stands in the path no more than ``times``; with remote_out off, a sender keeps back paths with the receiver's AS."""
    count = F.size(F.filter(path, lambda a: a == asn))
    got = routes.where(count <= times)
    return got if remote_out or remote is None else got.where(~F.array_contains(path, remote))


def multipath(routes: DataFrame, key: list[str], order: list[Column], path: str, mode: str) -> DataFrame:
    """Best routes of each key and those as good by order whose AS path is equivalent to the best one's: EXACT_PATH, FIRST_AS or PATH_LENGTH.

    The best of several is that with the least path as a text.
    """
    if mode not in ("EXACT_PATH", "FIRST_AS", "PATH_LENGTH"):
        raise ValueError(f"unknown mode {mode}")
    text = F.array_join(F.transform(path, lambda a: a.cast("string")), " ")
    equal = tables.best(routes, key, order).withColumn("__text", text)
    first = equal.groupBy(*key).agg(F.min_by(path, "__text").alias("__best"))
    got = equal.join(first, key)
    match mode:
        case "EXACT_PATH":
            ok = F.col(path) == F.col("__best")
        case "FIRST_AS":
            ok = F.get(path, F.lit(0)).eqNullSafe(F.get("__best", F.lit(0))) & (F.size(path) == F.size("__best"))
        case _:
            ok = F.size(path) == F.size("__best")
    return got.where(ok).drop("__text", "__best")


def local_origination(routes: DataFrame, key: list[str], prefer: str = "NETWORK", next_hop: str = "LOWEST_NEXT_HOP_IP") -> DataFrame:
    """The best locally originated route of each key: network statements or redistribution first, then the lowest or highest next hop."""
    if prefer not in ("NETWORK", "REDISTRIBUTE", "NO_PREFERENCE") or next_hop not in ("LOWEST_NEXT_HOP_IP", "HIGHEST_NEXT_HOP_IP"):
        raise ValueError(f"unknown preference {prefer} or {next_hop}")
    kind = F.lit(0) if prefer == "NO_PREFERENCE" else F.when(F.col("origin_kind") == prefer, 0).otherwise(1)
    hop = F.col("next_hop") if next_hop.startswith("LOWEST") else F.col("next_hop").desc()
    return tables.best(routes, key, [kind, hop])


def merged(rib: DataFrame, more: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One RIB imported into another: the best of both, each route once."""
    return tables.best(rib.unionByName(more).distinct(), key, order)


def merge_delta(rib: DataFrame, more: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """(key..., change, rest): what an import does to the best routes: ADD, or REPLACE of those that are no longer best."""
    before, after = tables.best(rib.distinct(), key, order), merged(rib, more, key, order)
    rest = [c for c in rib.columns if c not in key]
    new = after.exceptAll(before).withColumn("change", F.lit("ADD"))
    old = before.exceptAll(after).withColumn("change", F.lit("REPLACE"))
    return new.unionByName(old).select(*key, "change", *rest)


def tracks(conditions: DataFrame, values: DataFrame) -> DataFrame:
    """(track, ok): tracks that are up.

    conditions: (track, kind, of, negate): a row for each condition of a track; kind VALUE: of is a key of values (of, up), what isn't there is
    down; kind TRACK: of is another track, which must be up.  All of a track's conditions have to hold; tracks in a circle are an error.
    """
    value = conditions.where("kind = 'VALUE'").join(values.groupBy("of").agg(F.bool_and("up").alias("up")), "of", "left").select("track", (F.coalesce("up", F.lit(False)) != F.col("negate")).alias("ok"))
    refs = conditions.where("kind = 'TRACK'").select("track", "of", "negate")
    if not fixpoint.can_loop(refs.select(F.lit(1).alias("k"), F.col("track").alias("src"), F.col("of").alias("dst")), ["k"]).isEmpty():
        raise ValueError("tracks refer to each other in a circle")
    names = conditions.select("track").distinct()
    own = value.groupBy("track").agg(F.bool_and("ok").alias("own"))
    base = fixpoint.cut(names.join(own, "track", "left").select("track", F.coalesce("own", F.lit(True)).alias("own")))
    known = base.select("track", F.col("own").alias("ok"))
    while True:
        said = refs.join(known.select(F.col("track").alias("of"), "ok"), "of", "left").select("track", (F.coalesce("ok", F.lit(False)) != F.col("negate")).alias("ok")).groupBy("track").agg(F.bool_and("ok").alias("all"))
        nxt = fixpoint.cut(base.join(said, "track", "left").select("track", (F.col("own") & F.coalesce("all", F.lit(True))).alias("ok")))
        if nxt.exceptAll(known).isEmpty():
            return nxt
        known = nxt


def traced(origins: DataFrame, sessions: DataFrame, blocked: DataFrame, limit: int = 10_000) -> DataFrame:
    """(prefix, node, event, peer): where a prefix was ORIGINATED, SENT, FILTERED and INSTALLED (each node's first round), as it spreads.

    sessions: (src, dst); blocked: (prefix, src, dst), exports that a policy drops.
    """
    open_ = origins.select("prefix").distinct().crossJoin(sessions.select("src", "dst").distinct()).join(blocked.select("prefix", "src", "dst").distinct(), ["prefix", "src", "dst"], "left_anti")
    at = fixpoint.cut(fixpoint.reach(origins, open_, keep=["prefix"], rounds=limit))
    sends = at.join(sessions.select(F.col("src").alias("node"), F.col("dst").alias("peer")).distinct(), "node")
    stop = blocked.select("prefix", F.col("src").alias("node"), F.col("dst").alias("peer"), F.lit(True).alias("stop")).distinct()
    sends = sends.join(stop, ["prefix", "node", "peer"], "left").select("prefix", "node", F.when(F.col("stop"), "FILTERED").otherwise("SENT").alias("event"), "peer")
    none = F.lit(None).cast("long")
    first = at.where("hops = 0").select("prefix", "node", F.lit("ORIGINATED").alias("event"), none.alias("peer"))
    return first.unionByName(sends).unionByName(at.select("prefix", "node", F.lit("INSTALLED").alias("event"), none.alias("peer")))


# How work on prefixes and nodes is split


def dependency_components(routes: DataFrame, aggregates: DataFrame) -> DataFrame:
    """(network, plen, component): prefixes that must be computed together: an aggregate with all that it holds, by the least prefix (as a number)."""
    from . import prefixes

    code = lambda n, p: F.col(n) * 64 + F.col(p)
    every = routes.select("network", "plen").unionByName(aggregates.select("network", "plen")).distinct().withColumn("k", F.lit(1))
    held = prefixes.contained(every, aggregates.select("network", "plen").distinct().withColumn("k", F.lit(1)), ["k"])
    got = fixpoint.components(every.select(code("network", "plen").alias("node")), held.select(code("network", "plen").alias("src"), code("o_network", "o_plen").alias("dst")))
    return got.select(F.floor(F.col("node") / 64).cast("long").alias("network"), (F.col("node") % 64).cast("int").alias("plen"), "component")


def shard_count(prefixes: int, per_shard: int = 256, most: int = 16) -> int:
    """As many shards as keep each within its budget of prefixes, ``most`` at most; one at least."""
    return max(1, min(most, -(-prefixes // per_shard)))


def shards(weights: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """(key, shard): heaviest first, forth and back over the shards, so that sums stay near each other; one sorted pass, no greedy loop."""
    from .answers import row_ids

    ranked = row_ids(weights.select((-F.col(weight)).alias("__w"), F.col(key)), ["__w", key], "__r").withColumn("__r", F.col("__r") - 1)
    turn, at = F.floor(F.col("__r") / n), F.col("__r") % n
    return ranked.select(key, F.when(turn % 2 == 0, at).otherwise(n - 1 - at).cast("long").alias("shard"))


def partitioned(nodes: DataFrame, scheme: str, n: int, weight: str = "weight") -> DataFrame:
    """(node, part) by RANDOM (a hash), NAME_ORDERED (equal runs of names) or WEIGHTED (shards of weights)."""
    from .answers import row_ids

    match scheme:
        case "RANDOM":
            return nodes.select("node", F.pmod(F.crc32(F.col("node").cast("string").cast("binary")), F.lit(n)).alias("part"))
        case "NAME_ORDERED":
            total = nodes.agg(F.count("*").alias("__n"))
            got = row_ids(nodes.select("hostname", "node"), ["hostname", "node"], "__r").crossJoin(F.broadcast(total))  # one row
            return got.select("node", F.floor((F.col("__r") - 1) * n / F.col("__n")).cast("long").alias("part"))
        case "WEIGHTED":
            return shards(nodes, "node", weight, n).withColumnRenamed("shard", "part")
        case _:
            raise ValueError(f"unknown scheme {scheme}")


def cut_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, other, edges): how many edges lead from part to part; those between different parts are what has to be exchanged."""
    a = parts.select(F.col("node").alias("src"), "part")
    b = parts.select(F.col("node").alias("dst"), F.col("part").alias("other"))
    return edges.join(a, "src").join(b, "dst").groupBy("part", "other").agg(F.count("*").alias("edges"))


def unusable_vlans(interfaces: DataFrame) -> DataFrame:
    """VLAN interfaces (node, vlan) that no active switch port (node, vlan_lo, vlan_hi, active) of their node carries."""
    carried = interfaces.where("active").select("node", F.explode(F.sequence("vlan_lo", "vlan_hi")).alias("vlan")).distinct()
    wanted = interfaces.select("node", F.col("vlan_lo").alias("vlan")).distinct()
    return wanted.join(carried, ["node", "vlan"], "left_anti")

