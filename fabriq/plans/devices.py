"""Questions on device properties: sessions, virtual addresses, servers, access, health of the ingestion."""

from pyspark.sql import functions as F

from ..operators import tables
from ..sources.project import Facts
from ..streaming import monitor
from .registry import question


@question("SELECT node, 5000 + num AS vni, min(ip) AS vtep, count(*) AS members, 4789 AS port FROM interface WHERE active GROUP BY node, num")
def vxlan_vni_properties(f: Facts):
    v = f.interface.where("active").groupBy("node", (5000 + F.col("num")).alias("vni")).agg(F.min("ip").alias("vtep"), F.count("*").alias("members"))
    return v.withColumn("port", F.lit(4789))


@question("SELECT node, channel AS mlag, min(num) AS local_interface, max(num) AS peer_interface, CASE WHEN node % 2 = 0 THEN node + 1 ELSE node - 1 END AS peer FROM interface GROUP BY node, channel")
def mlag_properties(f: Facts):
    peer = F.when(F.col("node") % 2 == 0, F.col("node") + 1).otherwise(F.col("node") - 1)
    return f.interface.groupBy("node", F.col("channel").alias("mlag")).agg(F.min("num").alias("local_interface"), F.max("num").alias("peer_interface")).withColumn("peer", peer)


@question("SELECT node, num, ip, list_contains([ip, ip + 1, ip + 2], 167772160 + node // 2 * 256 + node % 2 * 128 + 4) AS virtual FROM interface")
def virtual_addresses(f: Facts):
    wanted = F.lit(167772160).cast("long") + F.expr("node div 2") * 256 + F.col("node") % 2 * 128 + 4
    return f.interface.select("node", "num", "ip", F.array_contains(F.array("ip", F.col("ip") + 1, F.col("ip") + 2), wanted).alias("virtual"))


@question("SELECT node, num AS pool, unnest(range(0, num % 3 + 1)) AS member, ip + num AS address FROM interface")
def load_balancer_servers(f: Facts):
    i = f.interface
    return i.select("node", F.col("num").alias("pool"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("num") % 3)).alias("member"), (F.col("ip") + F.col("num")).alias("address"))


@question("SELECT n.node, CASE WHEN n.asn % 4 = 0 THEN 'UNSUPPORTED_DEVICE' WHEN coalesce(a.clients, '') = '' THEN 'NO_SUCH_COMMUNITY' WHEN a.clients <> '1,2,3,4,5,6,7' THEN 'UNEXPECTED_CLIENTS' END AS reason FROM node n LEFT JOIN (SELECT node, string_agg(num || '', ',' ORDER BY num) AS clients FROM interface WHERE active GROUP BY node) a ON a.node = n.node WHERE n.asn % 4 = 0 OR coalesce(a.clients, '') <> '1,2,3,4,5,6,7'")
def snmp_community_clients(f: Facts):
    clients = f.interface.where("active").groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list("num")), lambda x: x.cast("string")), ",").alias("clients"))
    got = f.node.join(clients, "node", "left").withColumn("clients", F.coalesce("clients", F.lit("")))
    reason = F.when(F.col("asn") % 4 == 0, "UNSUPPORTED_DEVICE").when(F.col("clients") == "", "NO_SUCH_COMMUNITY").when(F.col("clients") != "1,2,3,4,5,6,7", "UNEXPECTED_CLIENTS")
    return got.select("node", reason.alias("reason")).where("reason is not null")


@question("SELECT acl || '' AS name, 'filter' AS kind, min(line) AS first_line, max(line) AS last_line, count(*) AS lines FROM acl GROUP BY acl UNION ALL SELECT hostname, 'node', node, node, 1 FROM node")
def defined_structures(f: Facts):
    acl = f.acl.groupBy(F.col("acl").cast("string").alias("name")).agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("lines"))
    nodes = f.node.select(F.col("hostname").alias("name"), F.lit("node").alias("kind"), F.col("node").alias("first_line"), F.col("node").alias("last_line"), F.lit(1).cast("long").alias("lines"))
    return acl.select("name", F.lit("filter").alias("kind"), "first_line", "last_line", "lines").unionByName(nodes)


@question("SELECT CAST(page_id AS BIGINT) AS file, CASE WHEN length(html) = 0 THEN 'EMPTY' WHEN NOT ends_with(html, '</html>') THEN 'PARTIALLY_UNRECOGNIZED' ELSE 'PASSED' END AS status FROM pages")
def file_parse_status(f: Facts):
    status = F.when(F.length("html") == 0, "EMPTY").when(~F.endswith("html", F.lit("</html>")), "PARTIALLY_UNRECOGNIZED").otherwise("PASSED")
    return f.table("pages").select(F.col("page_id").cast("long").alias("file"), status.alias("status"))


@question("SELECT node, min(num) FILTER (active) AS first_active, max(num) AS ports, count(*) FILTER (NOT active) AS down FROM interface GROUP BY node")
def ospf_area_interfaces(f: Facts):
    up = F.col("active")
    return f.interface.groupBy("node").agg(F.min(F.when(up, F.col("num"))).alias("first_active"), F.max("num").alias("ports"), F.count_if(~up).alias("down"))


@question("SELECT node, network, plen, peer, path_id FROM (SELECT *, row_number() OVER (PARTITION BY node, network, plen ORDER BY metric, tag, peer, admin) AS path_id FROM route) WHERE path_id <= 3")
def bgp_additional_paths(f: Facts):
    from pyspark.sql import Window

    w = Window.partitionBy("node", "network", "plen").orderBy("metric", "tag", "peer", "admin")
    return f.route.withColumn("path_id", F.row_number().over(w)).where("path_id <= 3").select("node", "network", "plen", "peer", "path_id")


@question("SELECT DISTINCT r.node, r.network, r.plen FROM route r WHERE r.protocol = 'R' AND EXISTS (SELECT 1 FROM (SELECT *, rank() OVER (PARTITION BY node, network, plen ORDER BY admin) AS k FROM route) m WHERE m.k = 1 AND m.node = r.node AND m.network = r.network AND m.plen = r.plen AND m.protocol = 'R')")
def advertise_only_active(f: Facts):
    key = ["node", "network", "plen"]
    active = tables.best(f.route, key, [F.asc("admin")]).where("protocol = 'R'")
    return f.route.where("protocol = 'R'").select(*key).distinct().join(active.select(*key), key, "left_semi")


@question("SELECT a.node, b.node AS remote_node, a.num FROM interface a JOIN interface b ON a.num = b.num AND b.ip BETWEEN a.ip // 256 * 256 AND a.ip // 256 * 256 + 255 WHERE a.node <> b.node")
def bgp_dynamic_peers(f: Facts):
    own = f.interface.withColumn("range", F.expr("ip div 256"))
    other = own.select("range", "num", F.col("node").alias("remote_node"))
    return own.join(other, ["range", "num"]).where("node <> remote_node").select("node", "remote_node", "num")


@question("SELECT least(kind, kind) AS kind, n FROM (SELECT 'node' AS kind, count(*) AS n FROM node UNION ALL SELECT 'interface', count(*) FROM interface UNION ALL SELECT 'route', count(*) FROM route UNION ALL SELECT 'filter line', count(*) FROM acl)")
def snapshot_summary(f: Facts):
    one = lambda k, d: d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return one("node", f.node).union(one("interface", f.interface)).union(one("route", f.route)).union(one("filter line", f.acl))


@question("SELECT CAST(epoch(time_bucket(INTERVAL 10 MINUTE, CAST(ts AS TIMESTAMP))) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(f: Facts):
    """Route events in windows of ten minutes, as the stream counts them."""
    got = monitor.windowed(f.table("events"))
    return got.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@question("SELECT user_id, CAST(floor(epoch(min(t))) AS BIGINT) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT user_id, CAST(ts AS TIMESTAMP) AS t, CASE WHEN CAST(ts AS TIMESTAMP) - lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, run")
def event_sessions(f: Facts):
    """Sessions of a user's events: a pause of half an hour ends one."""
    got = monitor.sessions(f.table("events"))
    return got.select("user_id", F.unix_timestamp("start").alias("start"), "n")
