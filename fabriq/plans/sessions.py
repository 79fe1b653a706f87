"""Questions on sessions: peers' settings, compatibility, what is established."""

from pyspark.sql import functions as F

from ..operators import sessions
from ..sources.project import Facts
from .registry import question

LINKS = """own AS (SELECT DISTINCT ip, node FROM interface WHERE active), full_ AS (SELECT * FROM peer WHERE local_as IS NOT NULL AND remote_as IS NOT NULL),
 dyn AS (SELECT a.id, p.id AS remote_id FROM full_ a JOIN own o ON o.ip = a.remote_ip JOIN full_ p ON p.node = o.node AND p.kind = 'PASSIVE' AND p.remote_network = a.local_ip // (1::BIGINT << (32 - p.remote_plen)) * (1::BIGINT << (32 - p.remote_plen)) WHERE a.kind = 'ACTIVE' AND a.node <> p.node AND a.remote_as = p.local_as AND a.local_as = p.remote_as),
 link AS (SELECT a.id, b.id AS remote_id FROM full_ a JOIN full_ b ON a.kind = 'ACTIVE' AND b.kind = 'ACTIVE' AND a.local_ip = b.remote_ip AND a.remote_ip = b.local_ip AND a.local_as = b.remote_as AND a.remote_as = b.local_as AND a.node <> b.node
 UNION SELECT id, remote_id FROM dyn UNION SELECT remote_id, id FROM dyn
 UNION SELECT a.id, b.id FROM full_ a JOIN adjacency l ON l.node = a.node AND l.num = a.num JOIN full_ b ON b.node = l.remote_node AND b.num = l.remote_num WHERE a.kind = 'UNNUMBERED' AND b.kind = 'UNNUMBERED' AND a.local_as = b.remote_as AND a.remote_as = b.local_as),
 compat AS (SELECT p.*, coalesce(n, 0) AS n_remotes, CASE WHEN local_as = remote_as THEN 'IBGP' WHEN multihop THEN 'EBGP_MULTIHOP' WHEN local_as IS NOT NULL AND remote_as IS NOT NULL THEN 'EBGP_SINGLEHOP' ELSE 'UNSET' END AS session_type,
 EXISTS (SELECT 1 FROM own o WHERE o.ip = p.local_ip AND o.node = p.node) AS mine, EXISTS (SELECT 1 FROM own o WHERE o.ip = p.remote_ip) AS known FROM peer p LEFT JOIN (SELECT id, count(DISTINCT remote_id) AS n FROM link GROUP BY id) l USING (id)),
 stat AS (SELECT *, CASE WHEN kind = 'PASSIVE' THEN CASE WHEN local_as IS NULL THEN 'NO_LOCAL_AS' WHEN remote_network IS NULL THEN 'NO_REMOTE_PREFIX' WHEN remote_as IS NULL THEN 'NO_REMOTE_AS' WHEN n_remotes > 0 THEN 'DYNAMIC_MATCH' ELSE 'NO_MATCH_FOUND' END
 WHEN kind = 'ACTIVE' AND local_ip IS NULL THEN CASE WHEN session_type IN ('EBGP_MULTIHOP', 'IBGP') THEN 'LOCAL_IP_UNKNOWN_STATICALLY' ELSE 'NO_LOCAL_IP' END WHEN local_as IS NULL THEN 'NO_LOCAL_AS' WHEN kind = 'ACTIVE' AND remote_ip IS NULL THEN 'NO_REMOTE_IP' WHEN remote_as IS NULL THEN 'NO_REMOTE_AS'
 WHEN kind = 'ACTIVE' AND NOT mine THEN 'INVALID_LOCAL_IP' WHEN kind = 'ACTIVE' AND NOT known THEN 'UNKNOWN_REMOTE' WHEN n_remotes = 0 THEN 'HALF_OPEN' WHEN n_remotes > 1 THEN 'MULTIPLE_REMOTES' ELSE 'UNIQUE_MATCH' END AS status FROM compat)"""


def _owners(f: Facts):
    return f.interface.where("active").select("ip", "node").distinct()


@question(f"WITH {LINKS} SELECT id, node, kind, session_type, n_remotes, status FROM stat")
def bgp_session_compatibility(f: Facts):
    return sessions.bgp_compatibility(f.peer, _owners(f), f.adjacency).select("id", "node", "kind", "session_type", "n_remotes", "status")


@question(f"WITH {LINKS} SELECT id, node, CASE WHEN status NOT IN ('UNIQUE_MATCH', 'DYNAMIC_MATCH', 'MULTIPLE_REMOTES') THEN 'NOT_COMPATIBLE' WHEN EXISTS (SELECT 1 FROM link l WHERE l.id = s.id AND l.id % 4 <> 0 AND l.remote_id % 4 <> 0) THEN 'ESTABLISHED' ELSE 'NOT_ESTABLISHED' END AS status FROM stat s")
def bgp_session_status(f: Facts):
    """Sessions are established where both ends' nodes answer: here all ends but those whose number is a multiple of four."""
    links = sessions.bgp_links(f.peer, _owners(f), f.adjacency)
    got = sessions.bgp_status(sessions.bgp_compatibility(f.peer, _owners(f), f.adjacency), links, links.where("id % 4 <> 0 and remote_id % 4 <> 0"))
    return got.select("id", "node", F.col("established_status").alias("status"))


@question(f"WITH {LINKS} SELECT l.id, l.remote_id, a.session_type AS kind FROM link l JOIN compat a ON a.id = l.id")
def bgp_topology(f: Facts):
    kind = sessions.session_type(F.col("local_as"), F.col("remote_as"), F.col("multihop"))
    return sessions.bgp_links(f.peer, _owners(f), f.adjacency).join(f.peer.select("id", kind.alias("kind")), "id")


@question("SELECT id, node, kind, local_as, local_ip, remote_ip, CASE WHEN kind = 'PASSIVE' THEN remote_network END AS remote_network, CASE WHEN kind = 'PASSIVE' THEN remote_plen END AS remote_plen, remote_as, reflector_client, kind = 'PASSIVE' AS is_passive FROM peer")
def bgp_peer_configuration(f: Facts):
    passive = F.col("kind") == "PASSIVE"
    return f.peer.select("id", "node", "kind", "local_as", "local_ip", "remote_ip", F.when(passive, F.col("remote_network")).alias("remote_network"), F.when(passive, F.col("remote_plen")).alias("remote_plen"), "remote_as", "reflector_client", passive.alias("is_passive"))


@question("SELECT node, min(local_as) AS local_as, count(*) AS neighbors, count(*) FILTER (kind = 'PASSIVE') AS passive, bool_or(reflector_client) AS route_reflector, bool_or(multihop) AS multihop, string_agg(DISTINCT remote_as, ',' ORDER BY remote_as) AS remote_asns FROM peer GROUP BY node")
def bgp_process_configuration(f: Facts):
    """One row for each process; the list of remote AS numbers is bounded by the neighbours of a node."""
    got = f.peer.groupBy("node").agg(F.min("local_as").alias("local_as"), F.count("*").alias("neighbors"), F.count_if(F.col("kind") == "PASSIVE").alias("passive"), F.bool_or("reflector_client").alias("route_reflector"), F.bool_or("multihop").alias("multihop"), F.array_sort(F.collect_set("remote_as")).alias("r"))
    asns = F.array_join(F.transform("r", lambda x: x.cast("string")), ",")
    return got.withColumn("remote_asns", F.when(F.size("r") > 0, asns)).drop("r")


OSPF = """SELECT l.node, l.num, l.remote_node, l.remote_num, a.area, b.area AS remote_area, CASE WHEN a.process IS NULL OR b.process IS NULL THEN 'PROCESS_INVALID' WHEN a.area IS NULL OR b.area IS NULL THEN 'UNKNOWN_COMPATIBILITY_ISSUE' WHEN NOT a.area_valid OR NOT b.area_valid THEN 'AREA_INVALID'
 WHEN a.passive AND b.passive THEN 'NO_SESSION' WHEN a.passive <> b.passive THEN 'PASSIVE_MISMATCH' WHEN a.area <> b.area THEN 'AREA_MISMATCH' WHEN a.router_id = b.router_id THEN 'DUPLICATE_ROUTER_ID' WHEN a.stub_type <> b.stub_type THEN 'AREA_TYPE_MISMATCH' WHEN a.network_type <> b.network_type THEN 'NETWORK_TYPE_MISMATCH'
 WHEN coalesce(a.network_type, b.network_type) <> 'POINT_TO_POINT' AND a.ip // 256 <> b.ip // 256 THEN 'NO_SESSION' WHEN a.hello <> b.hello THEN 'HELLO_INTERVAL_MISMATCH' WHEN a.dead <> b.dead THEN 'DEAD_INTERVAL_MISMATCH' WHEN a.network_type = 'NON_BROADCAST_MULTI_ACCESS' AND NOT list_contains(a.nbma_neighbors, b.ip) THEN 'NO_SESSION' ELSE 'ESTABLISHED' END AS session_status
 FROM l3 l JOIN ospf a ON a.node = l.node AND a.num = l.num JOIN ospf b ON b.node = l.remote_node AND b.num = l.remote_num"""
L3 = "l3 AS (SELECT a.node, a.num, b.node AS remote_node, b.num AS remote_num FROM interface a JOIN interface b ON a.ip // 256 = b.ip // 256 AND a.node <> b.node WHERE a.active AND b.active)"


def _l3(f: Facts):
    up = f.interface.where("active").withColumn("subnet", F.expr("ip div 256"))
    other = up.select("subnet", F.col("node").alias("remote_node"), F.col("num").alias("remote_num"))
    return up.join(other, "subnet").where("node <> remote_node").select("node", "num", "remote_node", "remote_num")


@question(f"WITH {L3} {OSPF}")
def ospf_session_compatibility(f: Facts):
    return sessions.ospf_compatibility(f.ospf, _l3(f))


@question(f"WITH {L3}, s AS ({OSPF}) SELECT node, num, remote_node, remote_num, area FROM s WHERE session_status = 'ESTABLISHED'")
def edges_ospf(f: Facts):
    return sessions.ospf_compatibility(f.ospf, _l3(f)).where("session_status = 'ESTABLISHED'").select("node", "num", "remote_node", "remote_num", "area")


@question("SELECT node, process, string_agg(DISTINCT area, ',' ORDER BY area) AS areas, count(DISTINCT area) > 1 AS area_border_router, min(router_id) AS router_id, count(*) FILTER (passive) AS passive FROM ospf WHERE process IS NOT NULL GROUP BY node, process")
def ospf_process_configuration(f: Facts):
    got = f.ospf.where("process is not null").groupBy("node", "process").agg(F.array_sort(F.collect_set("area")).alias("a"), F.min("router_id").alias("router_id"), F.count_if("passive").alias("passive"))
    areas = F.array_join(F.transform("a", lambda x: x.cast("string")), ",")
    return got.select("node", "process", F.when(F.size("a") > 0, areas).alias("areas"), (F.size("a") > 1).alias("area_border_router"), "router_id", "passive")


@question("SELECT area, any_value(CASE WHEN area_valid THEN 'VALID' ELSE 'INVALID' END) AS area_type, count(*) AS interfaces, count(*) FILTER (NOT passive) AS active_interfaces, count(*) FILTER (passive) AS passive_interfaces, count(DISTINCT node) AS nodes FROM ospf WHERE area IS NOT NULL GROUP BY area")
def ospf_area_configuration(f: Facts):
    kind = F.when(F.bool_and("area_valid"), "VALID").otherwise("INVALID")
    return f.ospf.where("area is not null").groupBy("area").agg(kind.alias("area_type"), F.count("*").alias("interfaces"), F.count_if(~F.col("passive")).alias("active_interfaces"), F.count_if("passive").alias("passive_interfaces"), F.count_distinct("node").alias("nodes"))


@question("""SELECT a.id, b.id AS remote_id, CASE WHEN b.id IS NULL THEN 'MISSING_END_POINT' WHEN NOT list_has_any(a.ike_proposals, b.ike_proposals) THEN 'IKE_PHASE1_FAILED' WHEN a.ike_key <> b.ike_key THEN 'IKE_PHASE1_KEY_MISMATCH' WHEN NOT list_has_any(a.ipsec_proposals, b.ipsec_proposals) THEN 'IPSEC_PHASE2_FAILED' ELSE 'IPSEC_SESSION_ESTABLISHED' END AS status
 FROM tunnel a LEFT JOIN tunnel b ON a.local_ip = b.remote_ip AND a.remote_ip = b.local_ip""")
def ipsec_sessions(f: Facts):
    return sessions.ipsec_sessions(f.tunnel)


@question("SELECT a.id, b.id AS remote_id FROM tunnel a JOIN tunnel b ON a.local_ip = b.remote_ip AND a.remote_ip = b.local_ip AND list_has_any(a.ike_proposals, b.ike_proposals) AND a.ike_key = b.ike_key AND list_has_any(a.ipsec_proposals, b.ipsec_proposals)")
def tunnel_topology(f: Facts):
    """Tunnels whose two ends negotiate: the edges that traffic may take."""
    return sessions.ipsec_sessions(f.tunnel).where("status = 'IPSEC_SESSION_ESTABLISHED'").select("id", "remote_id")
