"""Questions on routes: preference, activation, aggregation, redistribution, policies, differences."""

from pyspark.sql import functions as F

from ..functions import ip as fip
from ..operators import prefixes, tables
from ..sources.project import Facts
from .registry import question

RIB = "SELECT node, network, plen, protocol, admin, metric, tag FROM (SELECT *, rank() OVER (PARTITION BY node, network, plen{part} ORDER BY {order}) AS k FROM route{where}) WHERE k = 1"
COLS = ["node", "network", "plen", "protocol", "admin", "metric", "tag"]
KEY = ["node", "network", "plen"]


@question(RIB.format(part="", order="admin, metric", where=""))
def main_rib(f: Facts):
    return tables.best(f.route, KEY, [F.asc("admin"), F.asc("metric")]).select(*COLS)


@question(RIB.format(part="", order="CASE protocol WHEN 'A' THEN 0 WHEN 'N' THEN 3 ELSE 4 END, metric, CASE WHEN protocol = 'R' THEN admin ELSE 0 END", where=" WHERE NOT (protocol = 'R' AND tag % 100 = node)"))
def ospf_rib(f: Facts):
    kind = F.when(F.col("protocol") == "A", 0).when(F.col("protocol") == "N", 3).otherwise(4)
    advertised = f.route.where(~((F.col("protocol") == "R") & (F.col("tag") % 100 == F.col("node"))))
    return tables.best(advertised, KEY, [kind, F.asc("metric"), F.when(F.col("protocol") == "R", F.col("admin")).otherwise(0)]).select(*COLS)


@question(RIB.format(part="", order="metric % 16", where=" WHERE metric % 16 < 15"))
def rip_rib(f: Facts):
    return tables.best(f.route.where("metric % 16 < 15"), KEY, [F.col("metric") % 16]).select(*COLS)


@question(RIB.format(part="", order="admin, CASE WHEN plen < 16 THEN 1 ELSE 2 END, tag % 5 = 0, metric", where=" WHERE NOT (tag % 7 = 0 AND plen >= 16)"))
def isis_rib(f: Facts):
    level = F.when(F.col("plen") < 16, 1).otherwise(2)
    return tables.best(f.route.where("not (tag % 7 = 0 and plen >= 16)"), KEY, [F.asc("admin"), level, F.col("tag") % 5 == 0, F.asc("metric")]).select(*COLS)


@question(RIB.format(part="", order="256 * (10000000 // (1000 + metric) + admin), protocol", where=""))
def eigrp_rib(f: Facts):
    return tables.best(f.route, KEY, [fip.eigrp_cost(1000 + F.col("metric"), F.col("admin")), F.asc("protocol")]).select(*COLS)


@question(RIB.format(part=", tag % 4", order="admin DESC, metric", where=""))
def evpn_rib(f: Facts):
    return tables.best(f.route.withColumn("rd", F.col("tag") % 4), [*KEY, "rd"], [F.desc("admin"), F.asc("metric")]).select(*COLS)


BGP = "tag % 3 DESC, admin DESC, plen % 3, protocol, peer % 2, metric % 100, peer, tag, metric"


@question("SELECT node, network, plen, protocol, admin, metric, tag FROM (SELECT *, row_number() OVER (PARTITION BY node, network, plen ORDER BY " + BGP + ") AS k FROM route) WHERE k = 1")
def bgp_best_path(f: Facts):
    """Weight, local preference, path length, origin, external first, MED, then a total order by peer and originator."""
    struct = F.struct(*(F.expr(e) for e in ("-(tag % 3)", "-admin", "plen % 3", "protocol", "peer % 2", "metric % 100", "peer", "tag", "metric")))
    # one least row per prefix by a pre-aggregated minimum rather than a sorted window
    return f.route.groupBy(*KEY).agg(F.min(F.struct(struct.alias("o"), "protocol", "admin", "metric", "tag")).alias("b")).select(*KEY, "b.protocol", "b.admin", "b.metric", "b.tag")


@question("SELECT node, network, plen, protocol, metric, tag FROM (SELECT *, rank() OVER (PARTITION BY node, network, plen ORDER BY admin, metric) AS k FROM route) WHERE k = 2")
def backup_routes(f: Facts):
    best = tables.best(f.route, KEY, [F.asc("admin"), F.asc("metric")])
    keys = best.select(*KEY, F.col("admin").alias("a"), F.col("metric").alias("m")).distinct()
    only = best.groupBy(*KEY).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    others = f.route.join(keys, KEY).join(only, KEY).where("not (admin = a and metric = m)")
    return tables.best(others, KEY, [F.asc("admin"), F.asc("metric")]).select(*KEY, "protocol", "metric", "tag")


DELTA = """WITH a AS (SELECT DISTINCT node, network, plen, metric FROM (SELECT *, rank() OVER (PARTITION BY node, network, plen ORDER BY metric) AS k FROM route) WHERE k = 1),
 b AS (SELECT DISTINCT node, network, plen, metric FROM (SELECT *, rank() OVER (PARTITION BY node, network, plen ORDER BY metric) AS k FROM route WHERE tag % 20 <> 0) WHERE k = 1)
 SELECT coalesce(a.node, b.node) AS node, coalesce(a.network, b.network) AS network, coalesce(a.plen, b.plen) AS plen, CASE WHEN b.node IS NULL THEN 'WITHDRAW' ELSE 'REPLACE' END AS change, a.metric AS old_metric, b.metric AS new_metric
 FROM a FULL OUTER JOIN b ON a.node = b.node AND a.network = b.network AND a.plen = b.plen WHERE a.metric IS DISTINCT FROM b.metric"""


@question(DELTA)
def rib_delta(f: Facts):
    low = lambda df, c: df.groupBy(*KEY).agg(F.min("metric").alias(c))
    both = low(f.route, "old_metric").join(low(f.route.where("tag % 20 <> 0"), "new_metric"), KEY, "full_outer").where("not (old_metric <=> new_metric)")
    return both.select(*KEY, F.when(F.col("new_metric").isNull(), "WITHDRAW").otherwise("REPLACE").alias("change"), "old_metric", "new_metric")


@question("SELECT protocol, plen, count(*) AS routes, count(DISTINCT network) AS networks, max(metric) AS worst FROM route GROUP BY ROLLUP (protocol, plen)")
def route_summary(f: Facts):
    return f.route.rollup("protocol", "plen").agg(F.count("*").alias("routes"), F.count_distinct("network").alias("networks"), F.max("metric").alias("worst"))


# Static routes: every flow's destination as a next hop that must resolve over something other than itself.
@question("""SELECT f.flow AS id, f.node, max(r.plen) AS resolved_plen FROM flow f JOIN route r ON r.node = f.node AND r.forwarding AND f.dst >= r.network AND f.dst < r.network + (1::BIGINT << (32 - r.plen)) AND r.plen > f.port % 20 GROUP BY f.flow, f.node""")
def static_activation(f: Facts):
    statics = f.flow.select(F.col("flow").alias("id"), "node", "dst", (F.col("port") % 20).alias("own_plen"))
    hit = prefixes.longest_prefix_match(statics, f.route.select("node", "network", "plen", "forwarding").distinct(), ["node"], "dst")
    return hit.where("plen > own_plen").select("id", "node", F.col("plen").alias("resolved_plen")).distinct()


NETS = "(SELECT DISTINCT node, network, plen, tag % 50 AS pref FROM route)"


@question(f"SELECT a.node, a.network, a.plen, min(c.pref) AS best_pref, count(DISTINCT (c.network, c.plen)) AS contributors FROM (SELECT DISTINCT node, network, plen FROM route WHERE plen = 8) a JOIN {NETS} c ON a.node = c.node AND c.plen > 8 AND c.network >= a.network AND c.network < a.network + 16777216 GROUP BY ALL")
def generated_routes(f: Facts):
    nets = f.route.select("node", "network", "plen", (F.col("tag") % 50).alias("pref")).distinct()
    aggregates = nets.where("plen = 8").select("node", "network", "plen").distinct()
    hit = prefixes.contained(nets.where("plen > 8"), aggregates, ["node"])
    return hit.groupBy("node", F.col("o_network").alias("network"), F.col("o_plen").alias("plen")).agg(F.min("pref").alias("best_pref"), F.count_distinct("network", "plen").alias("contributors")).select("node", "network", "plen", "best_pref", "contributors")


@question("SELECT DISTINCT r.node, r.network, r.plen FROM route r WHERE NOT EXISTS (SELECT 1 FROM route a WHERE a.node = r.node AND a.plen = 8 AND a.protocol = 'R' AND r.plen > 8 AND r.network // 16777216 * 16777216 = a.network)")
def aggregate_suppression(f: Facts):
    nets = f.route.select("node", "network", "plen").distinct()
    summary = f.route.where("plen = 8 and protocol = 'R'").select("node", "network", "plen").distinct()
    hidden = prefixes.contained(nets.where("plen > 8"), summary, ["node"]).select("node", "network", "plen").distinct()
    return nets.join(hidden, KEY, "left_anti")


@question("SELECT node, network, plen, CASE WHEN plen <= 16 THEN 'E1' ELSE 'E2' END AS kind, min(CASE WHEN plen <= 16 THEN metric + admin ELSE metric END) AS metric FROM route WHERE protocol <> 'A' AND tag % 4 <> 0 GROUP BY ALL")
def redistribution(f: Facts):
    allowed = f.route.where("protocol <> 'A' and tag % 4 <> 0")
    metric = F.col("metric") + F.when(F.col("plen") <= 16, F.col("admin")).otherwise(0)
    return allowed.groupBy("node", "network", "plen", F.when(F.col("plen") <= 16, "E1").otherwise("E2").alias("kind")).agg(F.min(metric).alias("metric"))


@question("SELECT DISTINCT node, 'blue' AS vrf, network, plen FROM route WHERE tag % 2 = 0 UNION SELECT DISTINCT node, 'red', network, plen FROM route WHERE tag % 2 = 1 UNION SELECT DISTINCT node, 'red', network, plen FROM route WHERE tag % 2 = 0 AND plen >= 20")
def vrf_leaking(f: Facts):
    base = f.route.select("node", F.when(F.col("tag") % 2 == 0, "blue").otherwise("red").alias("vrf"), "network", "plen")
    leak = base.where("vrf = 'blue' and plen >= 20").withColumn("vrf", F.lit("red"))
    return base.union(leak).distinct()


@question("SELECT node, network, plen, tag, rib FROM (SELECT *, unnest(CASE WHEN protocol = 'A' THEN ['main', 'multicast'] ELSE ['main'] END) AS rib FROM route)")
def rib_groups(f: Facts):
    ribs = F.when(F.col("protocol") == "A", F.array(F.lit("main"), F.lit("multicast"))).otherwise(F.array(F.lit("main")))
    return f.route.select("node", "network", "plen", "tag", F.explode(ribs).alias("rib"))


# Paths and policies

PATH = "[65000 + tag % 3, 64512 + tag % 5, 65000 + peer % 3]"


@question(f"SELECT node, tag, network, len({PATH}) AS size, array_to_string(list_filter({PATH}, lambda a: NOT (a BETWEEN 64512 AND 65534)), ' ') AS public, array_to_string(list_concat([node + 1], {PATH}), ' ') AS prepended, list_contains({PATH}, 65001) AS has_65001 FROM route")
def as_path_functions(f: Facts):
    path = F.array((65000 + F.col("tag") % 3), (64512 + F.col("tag") % 5), (65000 + F.col("peer") % 3))
    text = lambda p: F.array_join(F.transform(p, lambda a: a.cast("string")), " ")
    r = f.route.withColumn("path", path)
    return r.select("node", "tag", "network", F.size("path").alias("size"), text(fip.without_private_as(F.col("path"))).alias("public"), text(fip.prepend(F.col("path"), F.col("node") + 1)).alias("prepended"), F.array_contains("path", F.lit(65001).cast("long")).alias("has_65001"))


@question("SELECT node, network, tag, array_to_string(list_sort(list_distinct(list_concat(list_filter([65000::BIGINT * 65536 + tag % 9, 65001::BIGINT * 65536 + tag % 4], lambda c: c % 65536 <> 3), [777]))), ' ') AS communities FROM route")
def community_algebra(f: Facts):
    own = F.array((F.lit(65000 * 65536).cast("long") + F.col("tag") % 9), (F.lit(65001 * 65536).cast("long") + F.col("tag") % 4))
    kept = F.filter(own, lambda c: c % 65536 != 3)
    out = F.array_sort(F.array_union(kept, F.array(F.lit(777).cast("long"))))
    return f.route.select("node", "network", "tag", F.array_join(F.transform(out, lambda c: c.cast("string")), " ").alias("communities"))


@question("""SELECT node, network, plen, tag, CASE WHEN plen > 20 THEN 'DENY' WHEN protocol = 'R' THEN 'PERMIT' WHEN tag % 3 = 0 THEN 'DENY' ELSE 'PERMIT' END AS action,
 CASE WHEN plen > 20 THEN metric WHEN protocol = 'R' THEN metric + 10 WHEN tag % 3 = 0 THEN metric ELSE greatest(metric - 500, 0) END AS metric FROM route""")
def test_route_policies(f: Facts):
    from .policies import Statement, run

    policy = [Statement(F.col("plen") > 20, accept=False), Statement(F.col("protocol") == "R", {"metric": F.col("metric") + 10}, accept=True), Statement(F.col("tag") % 3 == 0, accept=False), Statement(None, {"metric": F.greatest(F.col("metric") - 500, F.lit(0))}, accept=True)]
    return run(f.route, policy, default=False).select("node", "network", "plen", "tag", "action", "metric")


@question("""SELECT node, network, plen, tag, CASE WHEN plen > 20 THEN 'DENY' ELSE 'PERMIT' END AS first_action, CASE WHEN plen > 16 AND protocol = 'N' THEN 'DENY' ELSE 'PERMIT' END AS second_action FROM route
 WHERE (CASE WHEN plen > 20 THEN 'DENY' ELSE 'PERMIT' END) <> (CASE WHEN plen > 16 AND protocol = 'N' THEN 'DENY' ELSE 'PERMIT' END)""")
def compare_route_policies(f: Facts):
    from .policies import Statement, compare

    a = [Statement(F.col("plen") > 20, accept=False), Statement(None, accept=True)]
    b = [Statement((F.col("plen") > 16) & (F.col("protocol") == "N"), accept=False), Statement(None, accept=True)]
    return compare(f.route, a, b, ["metric"]).select("node", "network", "plen", "tag", "first_action", "second_action")


@question("SELECT protocol, min(network * 64 + plen) // 64 AS network, CAST(min(network * 64 + plen) % 64 AS INTEGER) AS plen FROM route WHERE plen <= 20 AND tag % 3 <> 0 GROUP BY protocol")
def search_route_policies(f: Facts):
    from .policies import Statement, run

    policy = [Statement(F.col("plen") > 20, accept=False), Statement(F.col("tag") % 3 == 0, accept=False), Statement(None, accept=True)]
    got = run(f.route, policy, default=False).where("action = 'PERMIT'").groupBy("protocol").agg(F.min(F.struct("network", "plen")).alias("w"))
    return got.select("protocol", "w.network", "w.plen")


@question("""SELECT node, network, plen, arg_min(action, line) AS action FROM (SELECT r.node, r.network, r.plen, l.line, l.action FROM (SELECT DISTINCT node, network, plen FROM route) r
 JOIN (VALUES (1, 0, 8, 8, 12, 'DENY'), (2, 0, 4, 8, 20, 'PERMIT'), (3, 0, 0, 0, 32, 'DENY')) l(line, base, len, lo, hi, action) ON r.plen BETWEEN l.lo AND l.hi AND r.network < CASE l.len WHEN 8 THEN 16777216 WHEN 4 THEN 268435456 ELSE 4294967296 END) GROUP BY ALL""")
def route_filter_lists(f: Facts):
    from .policies import route_filter

    lines = [(0, 8, 8, 12, "DENY"), (0, 4, 8, 20, "PERMIT"), (0, 0, 0, 32, "DENY")]
    return f.route.select("node", "network", "plen").distinct().withColumn("action", route_filter(F.col("network"), F.col("plen"), lines))


@question("SELECT flow, node, dst, port, CASE WHEN port % 4 = 0 THEN 167772160 + dst % 256 WHEN dst < 1000000 THEN dst + 16777216 ELSE dst END AS new_dst, CASE WHEN port % 4 = 0 THEN 8000 + port % 100 ELSE port END AS new_port FROM flow")
def address_translation(f: Facts):
    from .policies import rewrite

    rules = [(F.col("port") % 4 == 0, {"dst": F.lit(167772160).cast("long") + F.col("dst") % 256, "port": 8000 + F.col("port") % 100}), (F.col("dst") < 1000000, {"dst": F.col("dst") + 16777216})]
    got = rewrite(f.flow, rules, ["dst", "port"])
    return got.select("flow", "node", "dst", "port", "new_dst", "new_port")
