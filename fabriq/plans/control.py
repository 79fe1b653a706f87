"""Questions on the control plane: areas, levels, propagation, RIB imports, tracks, partitions of the work."""

from pyspark.sql import functions as F

from ..operators import control
from ..sources.project import Facts
from .registry import question

# A node is in the area of its number's rest by three, and in area 0 too where four divides it; an edge is in an area that both ends have.
AREA = "homed AS (SELECT node, node % 3 AS area FROM node UNION SELECT node, 0 FROM node WHERE node % 4 = 0), ae AS (SELECT e.src, e.dst, e.weight, a.area FROM undirected u JOIN (SELECT src, dst, weight FROM edge UNION SELECT dst, src, weight FROM edge) e ON e.src = u.src AND e.dst = u.dst JOIN homed a ON a.node = e.src JOIN homed b ON b.node = e.dst AND b.area = a.area), "
WALK = AREA + """st AS (SELECT a.src AS n, a.area, k, a.dst AS n2, a.area AS area2, k AS k2, min(weight) AS weight FROM ae a, (SELECT unnest([0, 1, 2]) AS k) WHERE k <> 1 OR a.area = 0 GROUP BY ALL UNION ALL SELECT h.node, h.area, 0, h.node, 0, 1, 0 FROM homed h JOIN homed z ON z.node = h.node AND z.area = 0 WHERE h.area <> 0 UNION ALL SELECT h.node, 0, k, h.node, h.area, 2, 0 FROM homed h JOIN homed z ON z.node = h.node AND z.area = 0, (SELECT unnest([0, 1]) AS k) WHERE h.area <> 0),
 r(sn, sa, n, area, k, cost) USING KEY (sn, sa, n, area, k) AS (SELECT node, area, node, area, 0, 0::BIGINT FROM homed UNION SELECT x.sn, x.sa, x.n2, x.area2, x.k2, min(x.c) FROM (SELECT r.sn, r.sa, s.n2, s.area2, s.k2, r.cost + s.weight AS c FROM r JOIN st s ON s.n = r.n AND s.area = r.area AND s.k = r.k) x LEFT JOIN recurring.r o ON o.sn = x.sn AND o.sa = x.sa AND o.n = x.n2 AND o.area = x.area2 AND o.k = x.k2 WHERE o.cost IS NULL OR x.c < o.cost GROUP BY ALL),
 inner_ AS (SELECT sn AS source, sa AS source_area, n AS node, area, min(cost) AS cost FROM r GROUP BY ALL)"""


def _homed(f: Facts):
    n = f.node.select("node")
    return n.select("node", (F.col("node") % 3).alias("area")).union(n.where("node % 4 = 0").select("node", F.lit(0).cast("long"))).distinct()


def _weighted(f: Facts):
    e = f.edge.select("src", "dst", "weight")
    return e.union(e.select("dst", "src", "weight")).distinct()


def _areas(f: Facts):
    h = _homed(f)
    edges = _weighted(f).join(h.withColumnRenamed("node", "src"), "src").join(h.withColumnRenamed("node", "dst"), ["dst", "area"])
    return control.area_costs(edges.groupBy("src", "dst", "area").agg(F.min("weight").alias("weight")), h, h)


@question(f"WITH RECURSIVE {WALK} SELECT * FROM inner_")
def ospf_inter_area(f: Facts):
    """Costs within areas and over the backbone between them."""
    return _areas(f)


@question(f"WITH RECURSIVE {WALK}, ext AS (SELECT node, node * 1000 AS network, CASE WHEN node % 2 = 0 THEN 'E1' ELSE 'E2' END AS kind, 20 + node % 5 AS metric FROM node WHERE NOT active UNION ALL SELECT node, 7, CASE WHEN node % 5 = 0 THEN 'E1' ELSE 'E2' END, 30 + node % 7 FROM node WHERE asn % 6 = 1), way AS (SELECT source, node, min(cost) AS way FROM inner_ WHERE area <> 2 GROUP BY ALL), e AS (SELECT w.node, network, kind, metric + CASE WHEN kind = 'E1' THEN way ELSE 0 END AS cost, way FROM way w JOIN ext ON ext.node = w.source) SELECT node, network, kind, cost FROM (SELECT *, row_number() OVER (PARTITION BY node, network ORDER BY kind, cost, way) AS k FROM e) WHERE k = 1")
def ospf_external_routes(f: Facts):
    """E1 and E2 routes; area 2 is a stub, which has none."""
    n = f.node
    one = n.where("not active").select("node", (F.col("node") * 1000).alias("network"), F.when(F.col("node") % 2 == 0, "E1").otherwise("E2").alias("kind"), (20 + F.col("node") % 5).alias("metric"))
    two = n.where("asn % 6 = 1").select("node", F.lit(7).cast("long").alias("network"), F.when(F.col("node") % 5 == 0, "E1").otherwise("E2").alias("kind"), (30 + F.col("node") % 7).alias("metric"))
    stubs = f.spark.createDataFrame([(2,)], "area long")
    return control.external_costs(_areas(f), one.unionByName(two), stubs)


LEVELS = "lv AS (SELECT node, node % 4 AS area, CASE WHEN node % 3 = 0 THEN 12 WHEN node % 3 = 1 THEN 1 ELSE 2 END AS levels FROM node), we AS (SELECT src, dst, min(weight) AS weight FROM (SELECT src, dst, weight FROM edge UNION ALL SELECT dst, src, weight FROM edge) GROUP BY ALL), le AS (SELECT e.src, e.dst, e.weight, 1 AS level FROM we e JOIN lv a ON a.node = e.src JOIN lv b ON b.node = e.dst WHERE a.levels <> 2 AND b.levels <> 2 AND a.area = b.area UNION ALL SELECT e.src, e.dst, e.weight, 2 FROM we e JOIN lv a ON a.node = e.src JOIN lv b ON b.node = e.dst WHERE a.levels <> 1 AND b.levels <> 1)"


@question(f"WITH RECURSIVE {LEVELS}, r(source, node, level, cost) USING KEY (source, node, level) AS (SELECT node, node, l.level, 0::BIGINT FROM lv, (SELECT unnest([1, 2]) AS level) l WHERE levels <> 3 - l.level UNION SELECT x.source, x.dst, x.level, min(x.c) FROM (SELECT r.source, e.dst, r.level, r.cost + e.weight AS c FROM r JOIN le e ON e.src = r.node AND e.level = r.level) x LEFT JOIN recurring.r o ON o.source = x.source AND o.node = x.dst AND o.level = x.level WHERE o.cost IS NULL OR x.c < o.cost GROUP BY ALL) SELECT source, node, CAST(min(level) AS INTEGER) AS level, arg_min(cost, level) AS cost FROM r GROUP BY source, node")
def isis_levels(f: Facts):
    nodes = f.node.select("node", (F.col("node") % 4).alias("area"), F.when(F.col("node") % 3 == 0, 12).when(F.col("node") % 3 == 1, 1).otherwise(2).alias("levels"))
    return control.level_costs(_weighted(f).groupBy("src", "dst").agg(F.min("weight").alias("weight")), nodes)


BGP = "ses AS (SELECT src, dst, CASE WHEN src % 3 = dst % 3 THEN 'IBGP' WHEN src % 9 // 3 = dst % 9 // 3 THEN 'CONFED' ELSE 'EBGP' END AS kind, src % 5 = 0 OR dst % 5 = 0 AS client FROM undirected), rule_ AS (SELECT * FROM (VALUES ('EBGP', true, 0, 1), ('EBGP', false, 0, 1), ('CONFED', true, 0, 0), ('CONFED', false, 0, 0), ('IBGP', true, 1, 0), ('IBGP', false, 2, 0)) t(kind, client, l2, cost)), "


@question(f"WITH RECURSIVE {BGP} r(prefix, node, learned, cost) USING KEY (prefix, node, learned) AS (SELECT node, node, 0, 0::BIGINT FROM node UNION SELECT x.prefix, x.dst, x.l2, min(x.c) FROM (SELECT r.prefix, s.dst, u.l2, r.cost + u.cost AS c FROM r JOIN ses s ON s.src = r.node JOIN rule_ u ON u.kind = s.kind AND u.client = s.client WHERE NOT (r.learned = 2 AND s.kind = 'IBGP' AND NOT s.client)) x LEFT JOIN recurring.r o ON o.prefix = x.prefix AND o.node = x.dst AND o.learned = x.l2 WHERE o.cost IS NULL OR x.c < o.cost GROUP BY ALL) SELECT prefix, node, CAST(arg_min(learned, cost * 4 + learned) AS INTEGER) AS learned, min(cost) AS as_hops FROM r GROUP BY prefix, node")
def bgp_propagation(f: Facts):
    """EBGP, IBGP with reflection, and confederations, for a prefix of each node."""
    kind = F.when(F.col("src") % 3 == F.col("dst") % 3, "IBGP").when(F.expr("src % 9 div 3") == F.expr("dst % 9 div 3"), "CONFED").otherwise("EBGP")
    sessions = f.undirected.select("src", "dst", kind.alias("kind"), ((F.col("src") % 5 == 0) | (F.col("dst") % 5 == 0)).alias("client"))
    return control.bgp_propagation(f.node.select(F.col("node").alias("prefix"), "node"), sessions)


PATH = "[65000 + tag % 3, 64512 + peer % 2, 65000 + peer % 3]"
ROUTES = f"pr AS (SELECT DISTINCT node, network, plen, admin % 3 AS pref, {PATH} AS path FROM route)"


def _paths(f: Facts):
    path = F.array((65000 + F.col("tag") % 3), (64512 + F.col("peer") % 2), (65000 + F.col("peer") % 3))
    return f.route.select("node", "network", "plen", (F.col("admin") % 3).alias("pref"), path.alias("path")).distinct()


@question(f"WITH {ROUTES}, b AS (SELECT *, array_to_string(path, ' ') AS t FROM (SELECT *, rank() OVER (PARTITION BY node, network, plen ORDER BY pref DESC) AS k FROM pr) WHERE k = 1), f AS (SELECT node, network, plen, arg_min(path, t) AS bp FROM b GROUP BY ALL) SELECT m.mode, b.node, b.network, b.plen, t AS path FROM b JOIN f USING (node, network, plen), (SELECT unnest(['EXACT_PATH', 'FIRST_AS', 'PATH_LENGTH']) AS mode) m WHERE CASE mode WHEN 'EXACT_PATH' THEN path = bp WHEN 'FIRST_AS' THEN path[1] = bp[1] AND len(path) = len(bp) ELSE len(path) = len(bp) END")
def bgp_multipath(f: Facts):
    out = None
    for mode in ("EXACT_PATH", "FIRST_AS", "PATH_LENGTH"):
        got = control.multipath(_paths(f), ["node", "network", "plen"], [F.desc("pref")], "path", mode)
        got = got.select(F.lit(mode).alias("mode"), "node", "network", "plen", F.array_join(F.transform("path", lambda a: a.cast("string")), " ").alias("path"))
        out = got if out is None else out.unionByName(got)
    return out


@question(f"WITH {ROUTES} SELECT node, network, plen, array_to_string(path, ' ') AS path FROM pr WHERE len(list_filter(path, lambda a: a = 65000 + node % 3)) <= 1 AND NOT list_contains(path, 64512 + node % 2)")
def bgp_loop_prevention(f: Facts):
    """Paths that have the receiver's AS once at most, and that no sender keeps back."""
    got = control.loop_free(_paths(f), "path", 65000 + F.col("node") % 3, 1, 64512 + F.col("node") % 2, remote_out=False)
    return got.select("node", "network", "plen", F.array_join(F.transform("path", lambda a: a.cast("string")), " ").alias("path"))


@question("SELECT node, network, plen, origin_kind, next_hop FROM (SELECT *, rank() OVER (PARTITION BY node, network, plen ORDER BY CASE WHEN origin_kind = 'NETWORK' THEN 0 ELSE 1 END, next_hop DESC) AS k FROM (SELECT DISTINCT node, network, plen, CASE WHEN tag % 3 = 0 THEN 'NETWORK' ELSE 'REDISTRIBUTE' END AS origin_kind, peer AS next_hop FROM route)) WHERE k = 1")
def bgp_local_origination(f: Facts):
    r = f.route.select("node", "network", "plen", F.when(F.col("tag") % 3 == 0, "NETWORK").otherwise("REDISTRIBUTE").alias("origin_kind"), F.col("peer").alias("next_hop")).distinct()
    return control.local_origination(r, ["node", "network", "plen"], "NETWORK", "HIGHEST_NEXT_HOP_IP")


IMPORT = "a AS (SELECT DISTINCT node, network, plen, protocol, admin, metric FROM route WHERE protocol = 'A'), b AS (SELECT DISTINCT node, network, plen, protocol, admin, metric FROM route WHERE protocol <> 'A'), best_ AS (SELECT node, network, plen, protocol, admin, metric FROM (SELECT *, rank() OVER (PARTITION BY node, network, plen ORDER BY admin, metric) AS k FROM a) WHERE k = 1), after_ AS (SELECT node, network, plen, protocol, admin, metric FROM (SELECT *, rank() OVER (PARTITION BY node, network, plen ORDER BY admin, metric) AS k FROM (FROM a UNION FROM b)) WHERE k = 1)"


@question(f"WITH {IMPORT} SELECT * FROM after_")
def rib_import(f: Facts):
    r = f.route.select("node", "network", "plen", "protocol", "admin", "metric")
    return control.merged(r.where("protocol = 'A'"), r.where("protocol <> 'A'"), ["node", "network", "plen"], [F.asc("admin"), F.asc("metric")])


@question(f"WITH {IMPORT} SELECT node, network, plen, 'ADD' AS change, protocol, admin, metric FROM (FROM after_ EXCEPT FROM best_) UNION ALL SELECT node, network, plen, 'REPLACE', protocol, admin, metric FROM (FROM best_ EXCEPT FROM after_)")
def rib_merge_delta(f: Facts):
    r = f.route.select("node", "network", "plen", "protocol", "admin", "metric").distinct()
    return control.merge_delta(r.where("protocol = 'A'"), r.where("protocol <> 'A'"), ["node", "network", "plen"], [F.asc("admin"), F.asc("metric")])


@question("SELECT node, network, plen, out FROM (SELECT node, ip // 4 * 4 AS network, plen, num AS out FROM port WHERE plen = 30 UNION SELECT node, ip // 256 * 256, plen, num FROM port WHERE plen = 24)")
def connected_rib(f: Facts):
    """Routes of interfaces are all equal: none is preferred."""
    from ..operators import forwarding

    return control.merged(forwarding.connected_routes(f.port), forwarding.connected_routes(f.port), ["node", "network", "plen"], [F.lit(0)]).select("node", "network", "plen", "out")


@question("""WITH RECURSIVE up AS (SELECT node AS of, bool_and(active) AS up FROM interface GROUP BY node), v AS (SELECT n.node AS track, coalesce(u.up, false) <> (n.node % 4 = 0) AS own FROM node n LEFT JOIN up u ON u.of = n.node),
 t AS (SELECT track, own AS ok FROM v WHERE track % 5 <> 2 OR track + 1 NOT IN (SELECT node FROM node) OR track % 5 = 2 AND (track + 1) % 5 = 2), s AS (SELECT v.track, own AND (t.ok <> (v.track % 2 = 0)) AS ok FROM v JOIN t ON t.track = v.track + 1 WHERE v.track % 5 = 2 AND v.track + 1 IN (SELECT node FROM node)) SELECT track, ok FROM s UNION ALL SELECT track, own AND v.track % 5 <> 2 OR own AND v.track % 5 = 2 AND v.track % 2 = 0 FROM v WHERE v.track NOT IN (SELECT track FROM s)""")
def track_evaluation(f: Facts):
    """A track asks whether all ports of its node are up (or the contrary), every fifth also for the next node's track."""
    values = f.interface.select(F.concat(F.lit("n"), "node").alias("of"), F.col("active").alias("up"))
    n = f.node.select("node")
    own = n.select(F.col("node").alias("track"), F.lit("VALUE").alias("kind"), F.concat(F.lit("n"), "node").alias("of"), (F.col("node") % 4 == 0).alias("negate"))
    refs = n.where("node % 5 = 2").select(F.col("node").alias("track"), F.lit("TRACK").alias("kind"), (F.col("node") + 1).cast("string").alias("of"), (F.col("node") % 2 == 0).alias("negate"))
    got = control.tracks(own.unionByName(refs).withColumn("track", F.col("track").cast("string")), values)
    return got.select(F.col("track").cast("long").alias("track"), "ok")


@question("""WITH RECURSIVE ok AS (SELECT p.node AS prefix, u.src, u.dst FROM undirected u, node p WHERE (u.src + u.dst + p.node) % 4 <> 1), r AS (SELECT node AS prefix, node FROM node UNION SELECT r.prefix, o.dst FROM r JOIN ok o ON o.prefix = r.prefix AND o.src = r.node)
 SELECT node AS prefix, node, 'ORIGINATED' AS event, CAST(NULL AS BIGINT) AS peer FROM node UNION ALL SELECT prefix, node, 'INSTALLED', NULL FROM r UNION ALL SELECT r.prefix, r.node, CASE WHEN (u.src + u.dst + r.prefix) % 4 = 1 THEN 'FILTERED' ELSE 'SENT' END, u.dst FROM r JOIN undirected u ON u.src = r.node""")
def prefix_tracer(f: Facts):
    origins = f.node.select(F.col("node").alias("prefix"), "node")
    every = f.undirected.crossJoin(f.node.select(F.col("node").alias("prefix")))  # the export rules of each prefix are the input
    return control.traced(origins, f.undirected, every.where("(src + dst + prefix) % 4 = 1"))


@question("""WITH RECURSIVE p AS (SELECT DISTINCT network, plen FROM route), a AS (SELECT DISTINCT network, plen FROM route WHERE plen IN (8, 12) AND protocol = 'R'), l AS (SELECT p.network * 64 + p.plen AS x, a.network * 64 + a.plen AS y FROM p JOIN a ON a.plen <= p.plen AND p.network >= a.network AND p.network < a.network + (1::BIGINT << (32 - a.plen))), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
 r(node, c) USING KEY (node) AS (SELECT network * 64 + plen, network * 64 + plen FROM p UNION SELECT e.y, min(r.c) FROM r JOIN e ON e.x = r.node JOIN recurring.r o ON o.node = e.y WHERE r.c < o.c GROUP BY e.y) SELECT node // 64 AS network, CAST(node % 64 AS INTEGER) AS plen, c AS component FROM r""")
def prefix_components(f: Facts):
    return control.dependency_components(f.route, f.route.where("plen in (8, 12) and protocol = 'R'"))


@question("""WITH w AS (SELECT network, count(*) AS weight FROM route GROUP BY network), s AS (SELECT greatest(1, least(16, (count(*) + 255) // 256)) AS n FROM w), r AS (SELECT network, weight, n, row_number() OVER (ORDER BY -weight, network) - 1 AS k FROM w, s) SELECT network, CASE WHEN k // n % 2 = 0 THEN k % n ELSE n - 1 - k % n END AS shard FROM r""")
def prefix_shards(f: Facts):
    """Prefixes dealt to as many shards as their number asks for, by how many routes they have."""
    w = f.route.groupBy("network").agg(F.count("*").alias("weight"))
    return control.shards(w, "network", "weight", control.shard_count(w.count()))


PARTS = "SELECT 'NAME_ORDERED' AS scheme, node, CAST(floor((row_number() OVER (ORDER BY hostname, node) - 1) * 4 / (SELECT count(*) FROM node)) AS BIGINT) AS part FROM node UNION ALL SELECT 'WEIGHTED', node, CASE WHEN k // 4 % 2 = 0 THEN k % 4 ELSE 3 - k % 4 END FROM (SELECT node, row_number() OVER (ORDER BY -w, node) - 1 AS k FROM (SELECT n.node, count(i.num) AS w FROM node n LEFT JOIN interface i ON i.node = n.node GROUP BY n.node))"


@question(f"WITH p AS ({PARTS}) SELECT a.scheme, a.part, b.part AS other, count(*) AS edges FROM edge e JOIN p a ON a.node = e.src JOIN p b ON b.node = e.dst AND b.scheme = a.scheme GROUP BY ALL")
def node_partitions(f: Facts):
    """Edges within and between the parts of two schemes."""
    w = f.interface.groupBy("node").agg(F.count("*").alias("weight"))
    nodes = f.node.join(w, "node", "left").select("node", "hostname", F.coalesce("weight", F.lit(0)).alias("weight"))
    out = None
    for scheme in ("NAME_ORDERED", "WEIGHTED"):
        got = control.cut_edges(f.edge, control.partitioned(nodes, scheme, 4)).withColumn("scheme", F.lit(scheme))
        out = got if out is None else out.unionByName(got)
    return out.select("scheme", "part", "other", "edges")


@question("SELECT DISTINCT node, vlan_lo AS vlan FROM interface i WHERE NOT EXISTS (SELECT 1 FROM interface j WHERE j.node = i.node AND j.active AND i.vlan_lo BETWEEN j.vlan_lo AND j.vlan_hi)")
def unusable_vlan_interfaces(f: Facts):
    return control.unusable_vlans(f.interface)
