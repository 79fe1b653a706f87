"""Questions on filters of several fields: what lines match first, what blocks them, what two filters do apart."""

from pyspark.sql import functions as F

from ..operators import headers
from ..sources.project import Facts
from .registry import question

FIELDS = ["dst", "port", "proto"]
# Corners of all boxes of a filter: every cell has its least header among them.
CORNER = """live AS (SELECT * FROM rule WHERE dst_lo <= dst_hi AND port_lo <= port_hi AND proto_lo <= proto_hi), d AS (SELECT acl, dst_lo AS dst FROM live UNION SELECT acl, dst_hi + 1 FROM live), p AS (SELECT acl, port_lo AS port FROM live UNION SELECT acl, port_hi + 1 FROM live), q AS (SELECT acl, proto_lo AS proto FROM live UNION SELECT acl, proto_hi + 1 FROM live),
 corner AS (SELECT acl, dst, port, proto, min(line) AS line FROM d JOIN p USING (acl) JOIN q USING (acl) JOIN live l USING (acl) WHERE dst BETWEEN dst_lo AND dst_hi AND port BETWEEN port_lo AND port_hi AND proto BETWEEN proto_lo AND proto_hi GROUP BY acl, dst, port, proto)"""


@question("""SELECT h.flow, h.acl, min(l.line) AS line, coalesce(arg_min(l.action, l.line), 'DENY') AS action FROM header h LEFT JOIN rule l ON l.acl = h.acl AND l.callee IS NULL AND h.dst BETWEEN l.dst_lo AND l.dst_hi AND h.port BETWEEN l.port_lo AND l.port_hi AND h.proto BETWEEN l.proto_lo AND l.proto_hi GROUP BY h.flow, h.acl""")
def test_filters_headers(f: Facts):
    plain = f.rule.where("callee is null")
    hit = headers.first_match(f.header.select("flow", "acl", "dst", "port", "proto"), plain.drop("dst_lo", "dst_hi"), "flow", "acl", ["port", "proto"], "dst")
    got = f.header.select("flow", "acl").join(hit, ["flow", "acl"], "left").join(plain.select("acl", "line", "action"), ["acl", "line"], "left")
    return got.select("flow", "acl", "line", F.coalesce("action", F.lit("DENY")).alias("action"))


@question("""WITH RECURSIVE pair AS (SELECT flow, acl AS root, acl, dst, port, proto FROM header UNION SELECT flow, root, l.callee, dst, port, proto FROM pair JOIN rule l ON l.acl = pair.acl AND l.callee IS NOT NULL),
 c0 AS (SELECT p.flow, p.acl, min(l.line) AS line, arg_min(l.action, l.line) AS action FROM (SELECT DISTINCT flow, acl, dst, port, proto FROM pair) p JOIN rule l ON l.acl = p.acl AND l.callee IS NULL AND p.dst BETWEEN l.dst_lo AND l.dst_hi AND p.port BETWEEN l.port_lo AND l.port_hi AND p.proto BETWEEN l.proto_lo AND l.proto_hi GROUP BY p.flow, p.acl),
 want AS (SELECT DISTINCT flow, acl FROM pair),
 lev AS (SELECT want.flow, want.acl, max(l.line) AS at, max(l.callee) AS callee FROM want LEFT JOIN rule l ON l.acl = want.acl AND l.callee IS NOT NULL GROUP BY ALL),
 depth AS (SELECT acl, 0 AS k FROM (SELECT DISTINCT acl FROM rule) x WHERE acl NOT IN (SELECT acl FROM rule WHERE callee IS NOT NULL) UNION ALL SELECT l.acl, d.k + 1 FROM depth d JOIN rule l ON l.callee = d.acl),
 v1 AS (SELECT flow, acl, line, action FROM c0 WHERE acl NOT IN (SELECT acl FROM rule WHERE callee IS NOT NULL)),
 v2 AS (SELECT lev.flow, lev.acl, CASE WHEN i.action IS NOT NULL AND (c.line IS NULL OR lev.at < c.line) THEN lev.at ELSE c.line END AS line, CASE WHEN i.action IS NOT NULL AND (c.line IS NULL OR lev.at < c.line) THEN i.action ELSE c.action END AS action FROM lev LEFT JOIN c0 c USING (flow, acl) LEFT JOIN v1 i ON i.flow = lev.flow AND i.acl = lev.callee WHERE lev.at IS NOT NULL)
 SELECT h.flow, h.acl, coalesce(v1.line, v2.line) AS line, coalesce(v1.action, v2.action, 'DENY') AS action FROM header h LEFT JOIN v1 USING (flow, acl) LEFT JOIN v2 USING (flow, acl)""")
def test_filters_nested(f: Facts):
    """As filters that call others say it; a call of a filter that has no line for the flow says nothing."""
    h = f.header.select("flow", "acl", "dst", "port", "proto")
    plain, calls = f.rule.where("callee is null"), f.rule.where("callee is not null").select("acl", "line", "callee")
    asked = h.select("flow", "acl")
    may = headers.fixpoint.reach(asked, calls.select(F.col("acl").alias("src"), F.col("callee").alias("dst")), state="acl", keep=["flow"]).select("flow", "acl")
    hit = headers.first_match(may.join(h.drop("acl"), "flow"), plain.drop("dst_lo", "dst_hi"), "flow", "acl", ["port", "proto"], "dst")
    got = asked.join(headers.nested_verdicts(asked, hit.join(plain.select("acl", "line", "action"), ["acl", "line"]), calls), ["flow", "acl"], "left")
    return got.select("flow", "acl", "line", F.coalesce("action", F.lit("DENY")).alias("action"))


@question(f"WITH {CORNER} SELECT acl, line, action, CASE WHEN dst_lo <= dst_hi AND port_lo <= port_hi AND proto_lo <= proto_hi THEN 'BLOCKING_LINES' ELSE 'INDEPENDENTLY_UNMATCHABLE' END AS reason FROM rule ANTI JOIN corner USING (acl, line)")
def filter_line_reachability_headers(f: Facts):
    got = headers.unreachable(f.rule, ["acl"], FIELDS)
    return got.join(f.rule.select("acl", "line", "action"), ["acl", "line"]).select("acl", "line", "action", "reason")


@question(f"""WITH {CORNER}, nx AS (SELECT c.*, (SELECT min(d.dst) FROM d WHERE d.acl = c.acl AND d.dst > c.dst) - dst AS a, (SELECT min(p.port) FROM p WHERE p.acl = c.acl AND p.port > c.port) - port AS b, (SELECT min(q.proto) FROM q WHERE q.acl = c.acl AND q.proto > c.proto) - proto AS e FROM corner c),
 un AS (SELECT l.* FROM live l ANTI JOIN corner USING (acl, line)), mine AS (SELECT u.acl, u.line, u.action, n.line AS blocker, n.dst, n.port, n.proto, CAST(a AS DOUBLE) * b * e AS v FROM un u JOIN nx n ON n.acl = u.acl AND n.dst BETWEEN u.dst_lo AND u.dst_hi AND n.port BETWEEN u.port_lo AND u.port_hi AND n.proto BETWEEN u.proto_lo AND u.proto_hi),
 w AS (SELECT m.acl, m.line, m.blocker, sum(v) AS overlap, any_value(l.action <> m.action) AS differs FROM mine m JOIN live l ON l.acl = m.acl AND l.line = m.blocker GROUP BY m.acl, m.line, m.blocker), r AS (SELECT *, row_number() OVER (PARTITION BY acl, line ORDER BY overlap DESC, blocker) AS k FROM w),
 firstk AS (SELECT m.acl, m.line, m.dst, m.port, m.proto, min(r.k) AS k FROM mine m JOIN r ON r.acl = m.acl AND r.line = m.line JOIN live l ON l.acl = m.acl AND l.line = r.blocker AND m.dst BETWEEN l.dst_lo AND l.dst_hi AND m.port BETWEEN l.port_lo AND l.port_hi AND m.proto BETWEEN l.proto_lo AND l.proto_hi GROUP BY ALL),
 lastk AS (SELECT acl, line, max(k) AS last FROM firstk GROUP BY acl, line), other AS (SELECT acl, line, min(k) AS other FROM r WHERE differs GROUP BY acl, line)
 SELECT r.acl, r.line, r.blocker, r.overlap, r.differs FROM r JOIN lastk USING (acl, line) LEFT JOIN other USING (acl, line) WHERE r.k <= last OR r.k = other""")
def filter_blockers(f: Facts):
    """Unreachable lines with a concise set of lines that block them."""
    return headers.blockers(f.rule, ["acl"], FIELDS).withColumnRenamed("by", "blocker")


@question(f"WITH {CORNER} SELECT c.acl, min(c.dst * 1000000000 + greatest(c.port, 1000) * 1000 + c.proto) AS witness FROM (SELECT acl, dst, port, proto FROM corner UNION SELECT acl, dst, 1000, proto FROM d JOIN q USING (acl)) c JOIN live l ON l.acl = c.acl AND c.dst BETWEEN dst_lo AND dst_hi AND c.port BETWEEN port_lo AND port_hi AND c.proto BETWEEN proto_lo AND proto_hi WHERE c.port BETWEEN 1000 AND 30000 AND l.action = 'PERMIT' AND NOT EXISTS (SELECT 1 FROM live e WHERE e.acl = l.acl AND e.line < l.line AND c.dst BETWEEN e.dst_lo AND e.dst_hi AND c.port BETWEEN e.port_lo AND e.port_hi AND c.proto BETWEEN e.proto_lo AND e.proto_hi) GROUP BY c.acl")
def search_filters_headers(f: Facts):
    """The least header to a port from 1000 to 30000 that a filter permits."""
    got = headers.witnesses(f.rule, ["acl"], FIELDS, F.col("action") == "PERMIT", {"port": (1000, 30000)})
    return got.select("acl", (F.col("dst") * 1_000_000_000 + F.col("port") * 1000 + F.col("proto")).alias("witness"))


@question(f"WITH {CORNER} SELECT c.acl, count(DISTINCT l.action) = 2 AS both_ways FROM corner c JOIN live l USING (acl, line) GROUP BY c.acl")
def permit_and_deny(f: Facts):
    """Whether a filter has explicit headers of both answers."""
    got = headers.cells(f.rule, ["acl"], FIELDS).join(f.rule.select("acl", "line", "action"), ["acl", "line"])
    return got.groupBy("acl").agg((F.count_distinct("action") == 2).alias("both_ways"))


PAIR = """WITH live AS (SELECT *, acl % 2 AS side, acl - acl % 2 AS pair FROM rule WHERE dst_lo <= dst_hi AND port_lo <= port_hi AND proto_lo <= proto_hi), d AS (SELECT pair, dst_lo AS dst FROM live UNION SELECT pair, dst_hi + 1 FROM live), p AS (SELECT pair, port_lo AS port FROM live UNION SELECT pair, port_hi + 1 FROM live), q AS (SELECT pair, proto_lo AS proto FROM live UNION SELECT pair, proto_hi + 1 FROM live),
 said AS (SELECT pair, dst, port, proto, min(line) FILTER (side = 0) AS line_a, arg_min(action, line) FILTER (side = 0) AS x, min(line) FILTER (side = 1) AS line_b, arg_min(action, line) FILTER (side = 1) AS y FROM d JOIN p USING (pair) JOIN q USING (pair) JOIN live l USING (pair) WHERE dst BETWEEN dst_lo AND dst_hi AND port BETWEEN port_lo AND port_hi AND proto BETWEEN proto_lo AND proto_hi GROUP BY pair, dst, port, proto)
 SELECT pair AS acl, line_a, line_b, min(dst * 1000000000 + port * 1000 + proto) AS witness FROM said WHERE coalesce(x, 'DENY') <> coalesce(y, 'DENY') GROUP BY pair, line_a, line_b"""


@question(PAIR)
def compare_filters_headers(f: Facts):
    """Each filter of even number with the next one, as two snapshots of one filter."""
    lines = f.rule.withColumn("pair", F.col("acl") - F.col("acl") % 2)
    got = headers.compared(lines.where("acl % 2 = 0"), lines.where("acl % 2 = 1"), ["pair"], FIELDS)
    return got.select(F.col("pair").alias("acl"), "line_a", "line_b", (F.col("dst") * 1_000_000_000 + F.col("port") * 1000 + F.col("proto")).alias("witness"))


@question("SELECT flow FROM header WHERE dst BETWEEN 65536 AND 131071 AND proto = 6 AND (port = 22 OR port = 80 OR port = 443 OR port BETWEEN 1000 AND 2999 OR port BETWEEN 3101 AND 40000) AND (tcp_flags & 18 = 2 OR tcp_flags & 4 = 4)")
def header_constraints(f: Facts):
    """Flows of a header space: to a network, by TCP, to ports of a list with a hole, opening or resetting."""
    h = f.header.withColumnsRenamed({"port": "dst_port", "proto": "protocol"}).withColumn("src_port", F.lit(0).cast("long"))
    return h.where(headers.header_space({"dst_ips": [(65536, 16)], "ip_protocols": ["tcp"], "dst_ports": "22,80,443,1000-40000,!3000-3100", "tcp_flags": [{"syn": True, "ack": False}, {"rst": True}]})).select("flow")


@question("SELECT flow, CASE WHEN proto = 17 AND port BETWEEN 53 AND 53 THEN 'dns' WHEN proto = 6 AND port IN (80, 443) THEN 'web' WHEN proto = 1 THEN 'icmp' ELSE 'other' END AS application FROM header")
def applications(f: Facts):
    h = f.header.withColumnsRenamed({"port": "dst_port", "proto": "protocol"})
    is_ = lambda *names: headers.header_space({"applications": list(names)})
    kind = F.when(is_("dns"), "dns").when(is_("http", "https"), "web").when(headers.header_space({"ip_protocols": ["icmp"]}), "icmp").otherwise("other")
    return h.select("flow", kind.alias("application"))


@question("SELECT dst, min(flow) AS flow, count(*) AS flows FROM header GROUP BY dst")
def one_flow_per_destination(f: Facts):
    return f.header.groupBy("dst").agg(F.min("flow").alias("flow"), F.count("*").alias("flows"))
