"""Questions on tables, addresses, filters and structures."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ip as fip
from ..operators import answers, intervals, prefixes, tables
from ..sources.project import Facts
from .registry import question


@question("SELECT DISTINCT hostname, role, asn FROM node WHERE lower(role) LIKE '%a%' ORDER BY asn DESC, hostname LIMIT 20 OFFSET 5")
def answer_row_options(f: Facts):
    return tables.row_options(f.node, ["hostname", "role", "asn"], [tables.text_filter("role", "A")], unique=True, sort=[("asn", True), ("hostname", False)], offset=5, rows=20)


@question("SELECT node, hostname, asn FROM node WHERE asn >= 65010 AND role <> 'CHINA'")
def filter_table(f: Facts):
    return f.node.where(tables.predicate("asn", ">=", 65010) & tables.predicate("role", "!=", "CHINA")).select("node", "hostname", "asn")


@question("SELECT id, status FROM (SELECT id, nullif(status, 'O') AS status FROM snapshot) WHERE status IS DISTINCT FROM 'F' AND id % 3 = 0")
def filter_table_nulls(f: Facts):
    s = f.snapshot.withColumn("status", F.when(F.col("status") != "O", F.col("status")))
    return s.where(tables.predicate("status", "ISNOT", "F") & (F.col("id") % 3 == 0)).select("id", "status")


DIFF = """SELECT coalesce(s.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'Only in Snapshot' WHEN s.id IS NULL THEN 'Only in Reference' ELSE 'In both' END AS KeyPresence,
 s.status AS Snapshot_status, r.status AS Reference_status, s.price AS Snapshot_price, r.price AS Reference_price
 FROM snapshot s {} JOIN reference r ON s.id = r.id WHERE r.id IS NULL OR s.id IS NULL OR s.status IS DISTINCT FROM r.status OR s.price IS DISTINCT FROM r.price"""


@question(DIFF.format("FULL OUTER"))
def table_diff(f: Facts):
    return tables.table_diff(f.snapshot, f.reference, ["id"])


@question(DIFF.format("INNER"))
def table_diff_both_sides(f: Facts):
    return tables.table_diff(f.snapshot, f.reference, ["id"], one_sided=False)


@question("SELECT id, price, CASE WHEN price > 200000 THEN 'dear' WHEN status = 'O' THEN 'open' END AS exclusion FROM snapshot")
def answer_exclusions(f: Facts):
    return tables.exclusions(f.snapshot, [("dear", F.col("price") > 200000), ("open", F.col("status") == "O")]).select("id", "price", "exclusion")


@question("SELECT count(*) AS num_rows, count(CASE WHEN price > 200000 THEN 1 END) AS num_excluded, array_to_string(list_filter([CASE WHEN count(id) = 0 THEN 'id' END, CASE WHEN count(nothing) = 0 THEN 'nothing' END, CASE WHEN count(price) = 0 THEN 'price' END, CASE WHEN count(status) = 0 THEN 'status' END], lambda c: c IS NOT NULL), ',') AS empty_columns, max(price) AS max_price, max(id) AS max_id FROM (SELECT *, NULL AS nothing FROM snapshot)")
def answer_metrics(f: Facts):
    s = tables.exclusions(f.snapshot.withColumn("nothing", F.lit(None).cast("string")), [("dear", F.col("price") > 200000)])
    return tables.metrics(s, ["price", "id"], "exclusion")


@question("SELECT NOT EXISTS ((SELECT * FROM snapshot EXCEPT ALL SELECT * FROM reference) UNION ALL (SELECT * FROM reference EXCEPT ALL SELECT * FROM snapshot)) AS equal")
def assertion_equals(f: Facts):
    return tables.multiset_equal(f.snapshot, f.reference)


@question("SELECT count(*) > 100 AS more_than_100, count(*) < 100 AS less_than_100, count(*) = 100 AS equals_100 FROM node")
def assertion_counts(f: Facts):
    return f.node.agg(F.count("*").alias("n")).select((F.col("n") > 100).alias("more_than_100"), (F.col("n") < 100).alias("less_than_100"), (F.col("n") == 100).alias("equals_100"))


# Addresses


@question("SELECT node, num, (ip >> 24) || '.' || ((ip >> 16) & 255) || '.' || ((ip >> 8) & 255) || '.' || (ip & 255) AS address, ip // 256 * 256 AS network, ip // 256 * 256 + 255 AS broadcast, 4294967040 AS netmask, 24 AS mask_bits, ip AS parsed FROM interface")
def address_functions(f: Facts):
    i = f.interface
    text = fip.ip_str(F.col("ip"))
    m = fip.mask(F.col("plen"))
    return i.select("node", "num", text.alias("address"), fip.network(F.col("ip"), F.col("plen")).alias("network"), fip.last(F.col("ip"), F.col("plen")).alias("broadcast"), m.alias("netmask"), fip.mask_bits(m).alias("mask_bits"), fip.ip_parse(text).alias("parsed"))


@question("SELECT DISTINCT node, ip FROM interface WHERE ip & 255 = 3 AND (ip >> 24) = 10")
def wildcard_match(f: Facts):
    base, wild = (10 << 24) + 3, 0x00FFFF00
    return f.interface.where(fip.wildcard_matches(F.col("ip"), F.lit(base), F.lit(wild))).select("node", "ip").distinct()


@question("SELECT a.node, a.num, CASE WHEN xor(a.ip, b.ip) = 0 THEN 32 ELSE 31 - CAST(floor(log2(xor(a.ip, b.ip))) AS INTEGER) END AS shared FROM interface a JOIN interface b ON a.node = b.node AND b.num = 1")
def common_prefix_length(f: Facts):
    first = f.interface.where("num = 1").select("node", F.col("ip").alias("other"))
    return f.interface.join(first, "node").select("node", "num", fip.common_prefix_len(F.col("ip"), F.col("other")).alias("shared"))


@question("SELECT node, num, 256 * (10000000 // bandwidth + num * 10) AS eigrp, greatest(1, 100000 // bandwidth) AS ospf FROM interface")
def interface_costs(f: Facts):
    return f.interface.select("node", "num", fip.eigrp_cost(F.col("bandwidth"), F.col("num") * 10).alias("eigrp"), fip.ospf_cost(F.col("bandwidth")).alias("ospf"))


LPM = """SELECT f.flow, f.node, f.dst, r.network, r.plen, r.protocol, r.admin, r.tag FROM (SELECT *, rank() OVER (PARTITION BY flow ORDER BY plen DESC) AS k FROM (
 SELECT f.flow, f.dst, r.* FROM flow f JOIN route r ON f.node = r.node AND f.dst >= r.network AND f.dst < r.network + (1::BIGINT << (32 - r.plen)) WHERE r.forwarding)) r JOIN flow f USING (flow) WHERE k = 1"""


@question(LPM)
def lpm_routes(f: Facts):
    hit = prefixes.longest_prefix_match(f.flow.select("flow", "node", "dst"), f.route, ["node"], "dst")
    return hit.select("flow", "node", "dst", "network", "plen", "protocol", "admin", "tag")


@question(f"SELECT node, dst, CAST(count(*) AS BIGINT) AS routes FROM (SELECT DISTINCT node, dst, network, plen, protocol, admin, tag FROM ({LPM})) GROUP BY node, dst")
def lpm_route_counts(f: Facts):
    hit = prefixes.longest_prefix_match(f.flow.select("node", "dst").distinct(), f.route, ["node"], "dst")
    hit = hit.select("node", "dst", "network", "plen", "protocol", "admin", "tag").distinct()
    return hit.groupBy("node", "dst").agg(F.count("*").alias("routes"))


NETS = "(SELECT DISTINCT node, network, plen FROM route)"
WITHIN = "i.network >= o.network AND i.network < o.network + (1::BIGINT << (32 - o.plen)) AND o.plen <= i.plen"


@question(f"SELECT i.node, i.network, i.plen, o.network AS o_network, o.plen AS o_plen FROM {NETS} i JOIN {NETS} o ON i.node = o.node AND {WITHIN}")
def prefix_longer(f: Facts):
    nets = f.route.select("node", "network", "plen").distinct()
    return prefixes.contained(nets, nets, ["node"]).select("node", "network", "plen", "o_network", "o_plen")


@question(f"SELECT o.node, o.network, o.plen, i.network AS o_network, i.plen AS o_plen FROM {NETS} i JOIN {NETS} o ON i.node = o.node AND {WITHIN}")
def prefix_shorter(f: Facts):
    nets = f.route.select("node", "network", "plen").distinct()
    return prefixes.contained(nets, nets, ["node"], "SHORTER_PREFIXES").select("node", "network", "plen", "o_network", "o_plen")


@question(f"SELECT i.node, i.network, i.plen FROM {NETS} i JOIN {NETS} o ON i.network = o.network AND i.plen = o.plen AND o.node = i.node + 1")
def prefix_exact(f: Facts):
    nets = f.route.select("node", "network", "plen").distinct()
    other = nets.withColumn("node", F.col("node") - 1)
    return prefixes.contained(nets, other, ["node"], "EXACT").select("node", "network", "plen")


@question("SELECT a.ip, a.node, a.num, a.active, n > 1 AS duplicated FROM address a JOIN (SELECT ip, count(DISTINCT node) AS n FROM address GROUP BY ip) USING (ip)")
def ip_owners(f: Facts):
    """An address is duplicated where several nodes own it; several interfaces of one node are no duplicate."""
    n = f.address.groupBy("ip").agg(F.count_distinct("node").alias("n"))
    return f.address.join(n, "ip").select("ip", "node", "num", "active", (F.col("n") > 1).alias("duplicated"))


@question("SELECT ip, count(*) AS owners, string_agg(node || ':' || num, ',' ORDER BY node, num) AS places FROM address WHERE active GROUP BY ip HAVING count(DISTINCT (node, num)) > 1")
def unique_ip_assignments(f: Facts):
    """Addresses that are not assigned once only, with the interfaces that have them."""
    got = f.address.where("active").groupBy("ip").agg(F.count("*").alias("owners"), F.array_sort(F.collect_set(F.struct("node", "num"))).alias("p")).where("size(p) > 1")
    return got.select("ip", "owners", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["node"].cast("string"), x["num"].cast("string"))), ",").alias("places"))


# Integer and address spaces

POINTS = """WITH a AS (SELECT DISTINCT acl, unnest(range(lo, hi + 1)) AS x FROM acl WHERE action = 'PERMIT'), b AS (SELECT DISTINCT acl, unnest(range(lo, hi + 1)) AS x FROM acl WHERE action = 'DENY'),
 p AS ({}), q AS (SELECT acl, x, x - row_number() OVER (PARTITION BY acl ORDER BY x) AS g FROM p) SELECT acl, min(x) AS lo, max(x) AS hi FROM q GROUP BY acl, g"""


def _spaces(f: Facts):
    return [f.acl.where(f"action = '{a}'").select("acl", "lo", "hi") for a in ("PERMIT", "DENY")]


@question(POINTS.format("SELECT * FROM a UNION SELECT * FROM b"))
def space_union(f: Facts):
    return intervals.union(*_spaces(f), ["acl"])


@question(POINTS.format("SELECT * FROM a INTERSECT SELECT * FROM b"))
def space_intersection(f: Facts):
    return intervals.intersect(*_spaces(f), ["acl"])


@question(POINTS.format("SELECT * FROM a EXCEPT SELECT * FROM b"))
def space_difference(f: Facts):
    return intervals.difference(*_spaces(f), ["acl"])


@question(POINTS.format("SELECT acl, x FROM (SELECT DISTINCT acl FROM a), (SELECT unnest(range(0, 65536)) AS x) EXCEPT SELECT * FROM a"))
def space_complement(f: Facts):
    return intervals.complement(_spaces(f)[0], ["acl"], 0, 65535)


# Filters

FIRST = "(SELECT acl, x, min(line) AS line FROM (SELECT acl, line, unnest(range(lo, hi + 1)) AS x FROM acl) GROUP BY acl, x)"


@question("""SELECT f.flow, a.acl, arg_min(l.line, l.line) AS line, coalesce(arg_min(l.action, l.line), 'DENY') AS action FROM flow f
 JOIN (SELECT DISTINCT acl FROM acl) a ON f.node % 8 = a.acl LEFT JOIN acl l ON l.acl = a.acl AND f.port BETWEEN l.lo AND l.hi GROUP BY f.flow, a.acl""")
def test_filters(f: Facts):
    flows = f.flow.select("flow", (F.col("node") % 8).alias("acl"), "port").join(f.acl.select("acl").distinct(), "acl")
    own = intervals.owners(f.acl.select("acl", "line", "lo", "hi"), ["acl"])
    # the atom that holds a port: the last one that begins at or before it, in one sorted pass per filter and port block
    at = own.select("acl", F.explode(F.sequence(F.expr("lo div 256"), F.expr("hi div 256"))).alias("part"), "lo", "hi", "line")
    hit = flows.withColumn("part", F.expr("port div 256")).join(at, ["acl", "part"], "left").where("lo is null or port between lo and hi")
    hit = hit.where("lo is not null").select("flow", "acl", "line")
    got = flows.join(hit, ["flow", "acl"], "left").join(f.acl.select("acl", "line", "action"), ["acl", "line"], "left")
    return got.select("flow", "acl", "line", F.coalesce("action", F.lit("DENY")).alias("action"))


@question(f"SELECT acl, line, action FROM acl ANTI JOIN {FIRST} w USING (acl, line)")
def filter_line_reachability(f: Facts):
    own = intervals.owners(f.acl.select("acl", "line", "lo", "hi"), ["acl"])
    return f.acl.join(own.select("acl", "line").distinct(), ["acl", "line"], "left_anti").select("acl", "line", "action")


@question("""SELECT u.acl, u.line, string_agg(DISTINCT b.line, ',' ORDER BY b.line) AS blockers, bool_or(b.action <> u.action) AS differing FROM (
 SELECT * FROM acl ANTI JOIN """ + FIRST + " w USING (acl, line)) u JOIN (SELECT w.acl, w.x, w.line, a.action FROM " + FIRST + " w JOIN acl a USING (acl, line)) b ON b.acl = u.acl AND b.x BETWEEN u.lo AND u.hi GROUP BY u.acl, u.line")
def blocking_lines(f: Facts):
    lines = f.acl
    own = intervals.owners(lines.select("acl", "line", "lo", "hi"), ["acl"])
    blocked = lines.join(own.select("acl", "line").distinct(), ["acl", "line"], "left_anti")
    parts = own.join(lines.select("acl", "line", "action"), ["acl", "line"]).withColumnsRenamed({"line": "by", "action": "by_action", "lo": "a", "hi": "b"})
    parts = parts.withColumn("part", F.explode(F.sequence(F.expr("a div 1024"), F.expr("b div 1024"))))
    span = blocked.withColumn("part", F.explode(F.sequence(F.expr("lo div 1024"), F.expr("hi div 1024"))))
    hit = span.join(parts, ["acl", "part"]).where("a >= lo and b <= hi")
    got = hit.groupBy("acl", "line").agg(F.array_sort(F.collect_set("by")).alias("by"), F.bool_or(F.col("by_action") != F.col("action")).alias("differing"))
    return got.select("acl", "line", F.array_join(F.transform("by", lambda x: x.cast("string")), ",").alias("blockers"), "differing")


@question(f"""WITH w AS {FIRST}, o AS (SELECT w.acl, w.x, w.line, a.action FROM w JOIN acl a USING (acl, line))
 SELECT DISTINCT coalesce(l.acl, r.acl - 1) AS acl, l.line AS line_a, r.line AS line_b FROM (SELECT * FROM o WHERE acl % 2 = 0) l FULL OUTER JOIN (SELECT * FROM o WHERE acl % 2 = 1) r ON r.acl = l.acl + 1 AND l.x = r.x WHERE coalesce(l.action, 'DENY') <> coalesce(r.action, 'DENY')""")
def compare_filters(f: Facts):
    lines = f.acl
    own = intervals.owners(lines.select("acl", "line", "lo", "hi"), ["acl"]).join(lines.select("acl", "line", "action"), ["acl", "line"])
    pair = own.withColumn("pair", F.col("acl") - F.col("acl") % 2).withColumn("side", F.col("acl") % 2)
    # atoms of both filters of a pair together, then what each says on them; none means the default
    both = intervals.owners(pair.select("pair", F.lit(0).alias("line"), "lo", "hi"), ["pair"]).drop("line")
    cut = both.withColumn("part", F.explode(F.sequence(F.expr("lo div 256"), F.expr("hi div 256"))))
    said = pair.select("pair", "side", "line", "action", F.col("lo").alias("a"), F.col("hi").alias("b")).withColumn("part", F.explode(F.sequence(F.expr("a div 256"), F.expr("b div 256"))))
    hit = cut.join(said, ["pair", "part"]).where("lo >= a and hi <= b")
    side = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    got = hit.groupBy("pair", "lo").agg(side(0, "line").alias("line_a"), side(0, "action").alias("x"), side(1, "line").alias("line_b"), side(1, "action").alias("y"))
    got = got.where(F.coalesce("x", F.lit("DENY")) != F.coalesce("y", F.lit("DENY")))
    return got.select(F.col("pair").alias("acl"), "line_a", "line_b").distinct()


@question("SELECT acl, line, action FROM acl WHERE lo <= 21000 AND hi >= 20000 AND action = 'PERMIT'")
def find_matching_filter_lines(f: Facts):
    return f.acl.where("action = 'PERMIT' and lo <= 21000 and hi >= 20000").select("acl", "line", "action")


@question(f"SELECT acl, min(x) AS witness FROM {FIRST} w JOIN acl a USING (acl, line) WHERE a.action = 'PERMIT' AND x >= 15000 GROUP BY acl")
def search_filters(f: Facts):
    own = intervals.owners(f.acl.select("acl", "line", "lo", "hi"), ["acl"]).join(f.acl.select("acl", "line", "action"), ["acl", "line"])
    return own.where("action = 'PERMIT' and hi >= 15000").groupBy("acl").agg(F.min(F.greatest("lo", F.lit(15000).cast("long"))).alias("witness"))


@question("SELECT min(acl) AS representative, count(*) AS filters, min(n) AS lines FROM (SELECT acl, count(*) AS n, string_agg(k || '/' || action || '/' || dst_lo || '/' || dst_hi || '/' || port_lo || '/' || port_hi || '/' || proto_lo || '/' || proto_hi || '/' || coalesce(callee, -1), ';' ORDER BY k) AS body FROM (SELECT *, row_number() OVER (PARTITION BY acl ORDER BY line) AS k FROM rule) GROUP BY acl) GROUP BY body")
def filter_deduplication(f: Facts):
    """Filters of equal ordered lines, whatever the lines' numbers; a filter is one hash, summed over its lines with their ranks."""
    w = Window.partitionBy("acl").orderBy("line")
    lines = f.rule.withColumn("k", F.row_number().over(w))
    parts = [F.xxhash64(F.lit(seed), "k", "action", "dst_lo", "dst_hi", "port_lo", "port_hi", "proto_lo", "proto_hi", F.coalesce("callee", F.lit(-1).cast("long"))).cast("decimal(38,0)") for seed in (1, 2)]
    body = lines.groupBy("acl").agg(F.count("*").alias("lines"), F.sum(parts[0]).alias("a"), F.sum(parts[1]).alias("b"))
    return body.groupBy("lines", "a", "b").agg(F.min("acl").alias("representative"), F.count("*").alias("filters")).select("representative", "filters", "lines")


# Structures and roles


@question("SELECT node % 10 AS name, bandwidth, mtu, string_agg(DISTINCT node || '', ',' ORDER BY node || '') AS members, count(DISTINCT node) AS n FROM (SELECT node, sum(bandwidth)::BIGINT AS bandwidth, max(mtu) AS mtu FROM interface GROUP BY node) GROUP BY ALL")
def compare_same_name(f: Facts):
    per = f.interface.groupBy("node").agg(F.sum("bandwidth").alias("bandwidth"), F.max("mtu").alias("mtu")).withColumn("name", F.col("node") % 10)
    got = tables.classes_of_same_name(per.withColumn("definition", F.concat_ws("/", "bandwidth", "mtu")), ["name", "bandwidth", "mtu"], "definition", "node")
    return got.select("name", "bandwidth", "mtu", "members", "n")


@question("""WITH c AS (SELECT node % 10 AS name, mtu, count(DISTINCT node) AS n FROM interface GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, mtu) AS k, CAST(sum(n) OVER (PARTITION BY name) AS BIGINT) AS total FROM c)
 SELECT name, mtu, n, total, (SELECT n FROM r q WHERE q.name = r.name AND q.k = 1) AS conformers FROM r WHERE k > 1 AND (total - (SELECT n FROM r q WHERE q.name = r.name AND q.k = 1)) / total <= 0.67""")
def outliers(f: Facts):
    c = tables.classes_of_same_name(f.interface.withColumn("name", F.col("node") % 10), ["name"], "mtu", "node")
    return tables.outliers(c, ["name"], "mtu", 0.67).select("name", "mtu", "n", "total", "conformers")


@question("SELECT role, mtu, count(DISTINCT i.node) AS n FROM interface i JOIN node n ON n.node = i.node GROUP BY role, mtu HAVING count(DISTINCT i.node) > 0")
def per_role_classes(f: Facts):
    return f.interface.join(f.node.select("node", "role"), "node").groupBy("role", "mtu").agg(F.count_distinct("node").alias("n"))


@question("SELECT role, count(*) AS nodes, count(DISTINCT asn) = 1 AS consistent FROM node GROUP BY role")
def role_consistency(f: Facts):
    return f.node.groupBy("role").agg(F.count("*").alias("nodes"), (F.count_distinct("asn") == 1).alias("consistent"))


@question("SELECT hostname, regexp_extract(hostname, '^([a-z]+)\\d*$', 1) AS kind, CASE WHEN role LIKE 'UNITED%' THEN 'union' WHEN role LIKE '%A' THEN 'a' ELSE 'other' END AS region FROM node")
def node_roles(f: Facts):
    region = F.when(F.col("role").rlike("^UNITED"), "union").when(F.col("role").rlike("A$"), "a").otherwise("other")
    return f.node.select("hostname", F.regexp_extract("hostname", r"^([a-z]+)\d*$", 1).alias("kind"), region.alias("region"))


@question("SELECT name, kind, lines FROM structure WHERE NOT EXISTS (SELECT 1 FROM reference_to r WHERE r.name = structure.name AND r.kind = structure.kind)")
def unused_structures(f: Facts):
    """Defined structures that nothing refers to, under their name and kind."""
    return f.structure.join(f.reference_to.select("name", "kind").distinct(), ["name", "kind"], "left_anti").select("name", "kind", "lines")


@question("SELECT r.name, r.kind, r.context, count(*) AS uses, min(r.line) AS first_line FROM reference_to r GROUP BY ALL")
def referenced_structures(f: Facts):
    return f.reference_to.groupBy("name", "kind", "context").agg(F.count("*").alias("uses"), F.min("line").alias("first_line"))


@question("SELECT name, kind, context, min(line) AS first_line, count(*) AS uses FROM reference_to r WHERE NOT EXISTS (SELECT 1 FROM structure s WHERE s.name = r.name AND s.kind = r.kind) GROUP BY ALL")
def undefined_references(f: Facts):
    """References to structures that are not defined under that name and kind."""
    got = f.reference_to.join(f.structure.select("name", "kind"), ["name", "kind"], "left_anti")
    return got.groupBy("name", "kind", "context").agg(F.min("line").alias("first_line"), F.count("*").alias("uses"))


@question("SELECT acl AS name, node, count(line) > 0 AS present FROM (SELECT DISTINCT acl FROM acl) a CROSS JOIN (SELECT node FROM node) n LEFT JOIN (SELECT acl AS l_acl, line FROM acl) l ON l_acl = a.acl AND line % 50 = node GROUP BY acl, node")
def named_structures(f: Facts):
    names = f.acl.select("acl").distinct()  # few names by many nodes: the matrix is the answer
    every = f.node.select("node").crossJoin(F.broadcast(names))
    held = f.acl.select("acl", (F.col("line") % 50).alias("node")).distinct().withColumn("present", F.lit(True))
    return every.join(held, ["acl", "node"], "left").select(F.col("acl").alias("name"), "node", F.coalesce("present", F.lit(False)).alias("present"))


@question("SELECT node, vlan, count(*) AS interfaces, string_agg(num || '', ',' ORDER BY num) AS members FROM (SELECT node, num, unnest(range(vlan_lo, vlan_hi + 1)) AS vlan FROM interface WHERE active) GROUP BY node, vlan")
def switched_vlans(f: Facts):
    v = f.interface.where("active").select("node", "num", F.explode(F.sequence("vlan_lo", "vlan_hi")).alias("vlan"))
    got = v.groupBy("node", "vlan").agg(F.count("*").alias("interfaces"), F.array_sort(F.collect_list("num")).alias("m"))
    return got.select("node", "vlan", "interfaces", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


@question("SELECT node, channel, CAST(coalesce(sum(bandwidth) FILTER (active), 0) AS BIGINT) AS aggregate, max(bandwidth) FILTER (active) AS redundant, bool_or(active) AS up FROM interface GROUP BY node, channel")
def channel_bandwidth(f: Facts):
    live = F.when(F.col("active"), F.col("bandwidth"))
    return f.interface.groupBy("node", "channel").agg(F.coalesce(F.sum(live), F.lit(0)).alias("aggregate"), F.max(live).alias("redundant"), F.bool_or("active").alias("up"))


@question("SELECT ip // 256 AS subnet, arg_max(node, (100 - node % 50 - CASE WHEN active THEN 0 ELSE 60 END) * 1000000000000 + ip) AS winner, num AS vrid FROM interface GROUP BY ip // 256, num")
def virtual_router_winner(f: Facts):
    prio = 100 - F.col("node") % 50 - F.when(F.col("active"), 0).otherwise(60)
    return f.interface.groupBy(F.expr("ip div 256").alias("subnet"), F.col("num").alias("vrid")).agg(F.max_by("node", F.struct(prio, "ip")).alias("winner"))


@question("SELECT event_type AS kind, count(*) AS n, min(event_id) AS first_id, count(DISTINCT user_id) AS files FROM events GROUP BY event_type")
def warning_summary(f: Facts):
    return f.table("events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.count_distinct("user_id").alias("files"))


@question("SELECT node, hostname, asn FROM node WHERE active AND hostname SIMILAR TO 'n[1-3][0-9]*' AND role <> 'CHINA' OR hostname = 'n5'")
def resolve_node_specifier(f: Facts):
    from .specifiers import nodes

    return nodes(f.node, r"(/^n[1-3][0-9]*$/ & active()) \ role(CHINA), n5").select("node", "hostname", "asn")


@question("SELECT node, num, mtu, CASE WHEN bandwidth > 3000 THEN 'fast' ELSE 'slow' END AS speed FROM interface WHERE active")
def interface_properties(f: Facts):
    return f.interface.where("active").select("node", "num", "mtu", F.when(F.col("bandwidth") > 3000, "fast").otherwise("slow").alias("speed"))


@question("SELECT hostname, asn, active FROM node")
def node_properties(f: Facts):
    return f.node.select("hostname", "asn", "active")


# Answers: structural covers, row numbers, excluded rows


@question("SELECT hostname, role FROM node WHERE role = 'FRANCE' AND active OR hostname = 'n3'")
def excluded_rows(f: Facts):
    """Rows that a list of exclusions covers; an exclusion covers a row that has all of its fields, nested ones and members of lists too."""
    return answers.covered(f.node.select("hostname", "role", "active"), [{"role": "FRANCE", "active": True}, {"hostname": "n3"}]).select("hostname", "role")


@question("SELECT row_number() OVER (ORDER BY asn, hostname) AS id, hostname, asn FROM node")
def answer_row_ids(f: Facts):
    return answers.row_ids(f.node.select("hostname", "asn"), ["asn", "hostname"])


@question("SELECT node, network, plen, protocol, admin, metric, row_number() OVER (ORDER BY node, network, plen, protocol, admin, metric, tag) AS place FROM route")
def ordered_routes(f: Facts):
    """Routes in the answers' order: node, network, length, protocol, and on to a total order."""
    got = answers.row_ids(f.route.select("node", "network", "plen", "protocol", "admin", "metric", "tag"), ["node", "network", "plen", "protocol", "admin", "metric", "tag"], "place")
    return got.drop("tag")


@question("SELECT hostname, '{\"node\":' || node || ',\"hostname\":\"' || hostname || '\",\"asn\":' || asn || '}' AS model FROM node")
def vi_model(f: Facts):
    return f.node.select("hostname", F.to_json(F.struct("node", "hostname", "asn")).alias("model"))


@question("SELECT kind, nodes, issues, sample FROM (SELECT event_type AS kind, count(DISTINCT user_id) AS nodes, count(*) AS issues, min(event_id) AS sample FROM events GROUP BY event_type)")
def init_issues(f: Facts):
    """Issues of a kind merged over the nodes that have them."""
    return f.table("events").groupBy(F.col("event_type").alias("kind")).agg(F.count_distinct("user_id").alias("nodes"), F.count("*").alias("issues"), F.min("event_id").alias("sample"))


@question("SELECT lo_vlan, node, num FROM (SELECT unnest(range(vlan_lo, vlan_hi + 1)) AS lo_vlan, node, num FROM interface) WHERE lo_vlan IN (SELECT unnest(range(vlan_lo, vlan_hi + 1)) FROM interface WHERE NOT active)")
def vlan_range_index(f: Facts):
    """Interfaces by VLAN, for VLANs that an interface which is down has as well."""
    v = lambda i: i.select(F.explode(F.sequence("vlan_lo", "vlan_hi")).alias("lo_vlan"), "node", "num")
    return v(f.interface).join(v(f.interface.where("not active")).select("lo_vlan").distinct(), "lo_vlan", "left_semi")
