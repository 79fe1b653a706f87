"""Operators on hand-made cases: rules, ties, nulls, empty tables."""

import collections
import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fabriq.functions import ip6
from fabriq.operators import answers, control, fixpoint, forwarding, headers, intervals, lineage, search, sessions, symbolic, traces
from fabriq.plans import registry, specifiers
from fabriq.plans.policies import Statement, peer_groups


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def same(df, want):
    assert got(df) == sorted(want, key=str)


# Sessions

PEER = "id int, node int, kind string, local_ip long, local_as long, remote_ip long, remote_as long, remote_network long, remote_plen int, num int, multihop boolean"


def test_bgp_statuses(spark):
    rows = [
        (1, 1, "ACTIVE", 11, 1, 22, 2, None, None, None, False), (2, 2, "ACTIVE", 22, 2, 11, 1, None, None, None, False),  # each other's only end
        (3, 1, "ACTIVE", None, 1, 22, 1, None, None, None, False), (4, 1, "ACTIVE", None, 1, 22, 2, None, None, None, True), (5, 1, "ACTIVE", None, 1, 22, 2, None, None, None, False),
        (6, 1, "ACTIVE", 11, None, 22, 2, None, None, None, False), (7, 1, "ACTIVE", 11, 1, None, 2, None, None, None, False), (8, 1, "ACTIVE", 11, 1, 22, None, None, None, None, False),
        (9, 1, "ACTIVE", 99, 1, 22, 2, None, None, None, False), (10, 1, "ACTIVE", 11, 1, 98, 2, None, None, None, False), (11, 1, "ACTIVE", 11, 1, 33, 7, None, None, None, False),
        (12, 3, "PASSIVE", None, 3, None, 4, 44, 32, None, False), (13, 4, "ACTIVE", 44, 4, 33, 3, None, None, None, False), (14, 3, "PASSIVE", None, 3, None, 4, None, None, None, False),
        (15, 3, "PASSIVE", None, 3, None, 9, 0, 0, None, False), (16, 3, "PASSIVE", None, None, None, 9, 0, 0, None, False), (17, 3, "PASSIVE", None, 3, None, None, 0, 0, None, False),
        (18, 5, "UNNUMBERED", None, 5, None, 6, None, None, 1, False), (19, 6, "UNNUMBERED", None, 6, None, 5, None, None, 1, False), (20, 6, "UNNUMBERED", None, 6, None, 8, None, None, 1, False),
        (21, 7, "ACTIVE", 77, 1, 88, 2, None, None, None, False), (22, 8, "ACTIVE", 88, 2, 77, 1, None, None, None, False), (23, 9, "ACTIVE", 88, 2, 77, 1, None, None, None, False),
    ]
    owners = spark.createDataFrame([(11, 1), (22, 2), (33, 3), (44, 4), (77, 7), (88, 8), (88, 9)], "ip long, node int")
    links = spark.createDataFrame([(5, 1, 6, 1), (6, 1, 5, 1)], "node int, num int, remote_node int, remote_num int")
    peers = spark.createDataFrame(rows, PEER)
    out = {r["id"]: r["status"] for r in sessions.bgp_compatibility(peers, owners, links).collect()}
    assert out == {
        1: "UNIQUE_MATCH", 2: "UNIQUE_MATCH", 3: "LOCAL_IP_UNKNOWN_STATICALLY", 4: "LOCAL_IP_UNKNOWN_STATICALLY", 5: "NO_LOCAL_IP", 6: "NO_LOCAL_AS", 7: "NO_REMOTE_IP", 8: "NO_REMOTE_AS",
        9: "INVALID_LOCAL_IP", 10: "UNKNOWN_REMOTE", 11: "HALF_OPEN", 12: "DYNAMIC_MATCH", 13: "UNIQUE_MATCH", 14: "NO_REMOTE_PREFIX", 15: "NO_MATCH_FOUND", 16: "NO_LOCAL_AS", 17: "NO_REMOTE_AS",
        18: "UNIQUE_MATCH", 19: "UNIQUE_MATCH", 20: "HALF_OPEN", 21: "MULTIPLE_REMOTES", 22: "UNIQUE_MATCH", 23: "UNIQUE_MATCH",
    }
    assert set(out.values()) == set(sessions.BGP_STATUSES)
    both = sessions.bgp_compatibility(peers, owners, links)
    up = sessions.bgp_links(peers, owners, links)
    status = {r["id"]: r["established_status"] for r in sessions.bgp_status(both, up, up.where("id = 1")).collect()}
    assert status[1] == "ESTABLISHED" and status[2] == "NOT_ESTABLISHED" and status[11] == "NOT_COMPATIBLE"
    assert sessions.bgp_compatibility(peers.limit(0), owners, links).count() == 0


def test_ospf_statuses(spark):
    base = {"process": "1", "area": 0, "area_valid": True, "passive": False, "stub_type": "NONE", "network_type": "BROADCAST", "plen": 24, "hello": 10, "dead": 40, "nbma_neighbors": None}
    cases = [
        ({}, {}, "ESTABLISHED"), ({"process": None}, {}, "PROCESS_INVALID"), ({"area": None}, {}, "UNKNOWN_COMPATIBILITY_ISSUE"), ({"area_valid": False}, {}, "AREA_INVALID"),
        ({"passive": True}, {"passive": True}, "NO_SESSION"), ({"passive": True}, {}, "PASSIVE_MISMATCH"), ({"area": 1}, {}, "AREA_MISMATCH"), ({"router_id": 5}, {"router_id": 5}, "DUPLICATE_ROUTER_ID"),
        ({"stub_type": "STUB"}, {}, "AREA_TYPE_MISMATCH"), ({"network_type": "POINT_TO_POINT"}, {}, "NETWORK_TYPE_MISMATCH"), ({"network_type": None}, {}, "ESTABLISHED"), ({}, {"ip": 5000}, "NO_SESSION"),
        ({"network_type": "POINT_TO_POINT"}, {"network_type": "POINT_TO_POINT", "ip": 5000}, "ESTABLISHED"), ({"hello": 5}, {}, "HELLO_INTERVAL_MISMATCH"), ({"dead": 5}, {}, "DEAD_INTERVAL_MISMATCH"),
        ({"network_type": "NON_BROADCAST_MULTI_ACCESS"}, {"network_type": "NON_BROADCAST_MULTI_ACCESS"}, "NO_SESSION"),
    ]
    ends, links = [], []
    for k, (a, b, _) in enumerate(cases):
        for side, change in ((0, a), (1, b)):
            ends.append({"node": 2 * k + side, "num": 1, "router_id": 1000 + 2 * k + side, "ip": 2 + side} | base | change)
        links.append((2 * k, 1, 2 * k + 1, 1))
    schema = "node int, num int, router_id int, ip long, process string, area long, area_valid boolean, passive boolean, stub_type string, network_type string, plen int, hello int, dead int, nbma_neighbors array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(e[c] for c in names) for e in ends], schema)
    out = sessions.ospf_compatibility(df, spark.createDataFrame(links, "node int, num int, remote_node int, remote_num int"))
    assert {r["node"] // 2: r["session_status"] for r in out.collect()} == {k: s for k, (_, _, s) in enumerate(cases)}


def test_ipsec_statuses(spark):
    rows = [(1, 1, 2, ["a"], "k", ["x"]), (2, 2, 1, ["a", "b"], "k", ["x"]), (3, 3, 4, ["a"], "k", ["x"]), (4, 4, 3, ["c"], "k", ["x"]), (5, 5, 6, ["a"], "k", ["x"]), (6, 6, 5, ["a"], None, ["x"]), (7, 7, 8, ["a"], "k", ["x"]), (8, 8, 7, ["a"], "k", ["y"]), (9, 9, 10, None, None, None)]
    df = spark.createDataFrame(rows, "id int, local_ip long, remote_ip long, ike_proposals array<string>, ike_key string, ipsec_proposals array<string>")
    out = {r["id"]: r["status"] for r in sessions.ipsec_sessions(df).collect()}
    assert [out[k] for k in (1, 3, 5, 7, 9)] == ["IPSEC_SESSION_ESTABLISHED", "IKE_PHASE1_FAILED", "IKE_PHASE1_KEY_MISMATCH", "IPSEC_PHASE2_FAILED", "MISSING_END_POINT"]


# Filters

BOX = "acl int, line int, action string, x_lo long, x_hi long, y_lo long, y_hi long"


def random_boxes(rnd, n):
    out = []
    for k in range(n):
        a, b = sorted((rnd.randrange(8), rnd.randrange(8)))
        c, d = sorted((rnd.randrange(8), rnd.randrange(8)))
        out.append((k % 3, k // 3, rnd.choice(["PERMIT", "DENY"]), a, b, c, d))
    return out


def test_cells_and_comparisons_against_points(spark):
    """Two fields of eight values: first lines, reachability, witnesses and comparisons by all 64 points."""
    rnd = random.Random(3)
    rows = random_boxes(rnd, 24) + [(0, 90, "PERMIT", 5, 4, 0, 7), (1, 91, "DENY", None, 3, 0, 7)]
    lines = spark.createDataFrame(rows, BOX)

    def first(acl, x, y):
        hits = [(r[1], r[2]) for r in rows if r[0] == acl and r[3] is not None and r[3] <= x <= r[4] and r[5] <= y <= r[6]]
        return min(hits) if hits else None

    points = list(itertools.product(range(8), range(8)))
    cells = headers.cells(lines, ["acl"], ["x", "y"]).collect()
    for acl, (x, y) in itertools.product(range(3), points):
        own = [c["line"] for c in cells if c["acl"] == acl and c["x_lo"] <= x <= c["x_hi"] and c["y_lo"] <= y <= c["y_hi"]]
        assert own == ([first(acl, x, y)[0]] if first(acl, x, y) else [])
    alive = {(acl, first(acl, x, y)[0]) for acl in range(3) for x, y in points if first(acl, x, y)}
    assert {(r["acl"], r["line"]) for r in headers.unreachable(lines, ["acl"], ["x", "y"]).collect()} == {(r[0], r[1]) for r in rows} - alive
    reasons = {(r["acl"], r["line"]): r["reason"] for r in headers.unreachable(lines, ["acl"], ["x", "y"]).collect()}
    assert reasons[0, 90] == reasons[1, 91] == "INDEPENDENTLY_UNMATCHABLE"
    want = {a: min(((x, y) for x, y in points if 2 <= y <= 5 and (f := first(a, x, y)) and f[1] == "DENY"), default=None) for a in range(3)}
    out = {r["acl"]: (r["x"], r["y"]) for r in headers.witnesses(lines, ["acl"], ["x", "y"], F.col("action") == "DENY", {"y": (2, 5)}).collect()}
    assert out == {a: w for a, w in want.items() if w}
    a, b = lines.where("acl = 0").withColumn("acl", F.lit(7)), lines.where("acl = 1").withColumn("acl", F.lit(7))
    say = lambda acl, x, y: first(acl, x, y) or (None, "DENY")
    want = {}
    for x, y in points:
        p, q = say(0, x, y), say(1, x, y)
        if p[1] != q[1]:
            want[p[0], q[0]] = min(want.get((p[0], q[0]), (9, 9)), (x, y))
    assert {(r["line_a"], r["line_b"]): (r["x"], r["y"]) for r in headers.compared(a, b, ["acl"], ["x", "y"]).collect()} == want
    assert headers.cells(lines.limit(0), ["acl"], ["x", "y"]).count() == 0


def test_blockers_as_documented(spark):
    """A narrow deny and a wide permit before a line: the permit covers it, the deny treats most of it otherwise."""
    rows = [(1, 10, "DENY", 5, 5, 0, 60), (1, 20, "PERMIT", 0, 9, 0, 99), (1, 30, "PERMIT", 5, 5, 0, 99), (2, 1, "PERMIT", 0, 4, 0, 9), (2, 2, "PERMIT", 5, 9, 0, 9), (2, 3, "PERMIT", 2, 2, 2, 2), (2, 4, "PERMIT", 0, 9, 0, 9)]
    out = got(headers.blockers(spark.createDataFrame(rows, BOX), ["acl"], ["x", "y"]))
    assert out == sorted([(1, 30, 10, 61.0, True), (1, 30, 20, 39.0, False), (2, 3, 1, 1.0, False), (2, 4, 1, 50.0, False), (2, 4, 2, 50.0, False)], key=str)


def test_nested_filters(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (1, "d")], "flow int, acl string")
    plain = spark.createDataFrame([(1, "a", 9, "PERMIT"), (2, "a", 9, "PERMIT"), (3, "a", 1, "PERMIT"), (1, "c", 5, "DENY"), (3, "c", 5, "DENY")], "flow int, acl string, line int, action string")
    calls = spark.createDataFrame([("a", 2, "b"), ("b", 4, "c")], "acl string, line int, callee string")
    # flow 1: a calls b, which calls c, which denies; flow 2: c says nothing, a's own line; flow 3: a's line stands before the call; d has nothing
    same(headers.nested_verdicts(asked, plain, calls), [(1, "a", 2, "DENY"), (2, "a", 9, "PERMIT"), (3, "a", 1, "PERMIT")])
    with pytest.raises(ValueError, match="circle"):
        headers.nested_verdicts(asked, plain, calls.union(spark.createDataFrame([("c", 1, "a")], calls.schema)))


def test_owners_by_blocks(spark):
    rnd = random.Random(4)
    rows = [(k % 2, k, a, a + rnd.randrange(40)) for k in range(60) for a in [rnd.randrange(200)]]
    out = intervals.owners(spark.createDataFrame(rows, "acl int, line int, lo long, hi long"), ["acl"]).collect()
    for acl, x in itertools.product((0, 1), range(245)):
        want = min((r[1] for r in rows if r[0] == acl and r[2] <= x <= r[3]), default=None)
        assert [r["line"] for r in out if r["acl"] == acl and r["lo"] <= x <= r["hi"]] == ([] if want is None else [want])


def test_header_constraints(spark):
    assert headers.ports("22,80-90,!85") == [(22, 22), (80, 84), (86, 90)] and headers.ports("!0-65534") == [(65535, 65535)]
    for wrong in ("x", "70000", "9-8"):
        with pytest.raises(ValueError):
            headers.ports(wrong)
    with pytest.raises(ValueError, match="unknown"):
        headers.header_space({"nope": 1})
    df = spark.createDataFrame([(1, 6, 80, 2), (2, 6, 80, 18), (3, 17, 53, 0), (4, None, 80, 2)], "id int, protocol int, dst_port int, tcp_flags int")
    pick = lambda **c: [r["id"] for r in df.where(headers.header_space(c)).collect()]
    assert pick(applications=["http", "DNS"]) == [1, 2, 3] and pick(tcp_flags=[{"syn": True, "ack": False}]) == [1] and pick() == [1, 2, 3, 4] and pick(ip_protocols=["udp", "6"], dst_ports="53") == [3]


# Forwarding


def net(spark, routes, **more):
    """1 -10- 2 -20- 3, a LAN of 3 (100 to 103) and a stub port of 2 (200 to 203)."""
    i = spark.createDataFrame([(1, 1, 9, 30), (2, 1, 10, 30), (2, 2, 21, 30), (3, 1, 22, 30), (3, 2, 101, 30), (2, 3, 201, 30)], "node long, num long, ip long, plen int")
    links = spark.createDataFrame([(1, 1, 2, 1), (2, 1, 1, 1), (2, 2, 3, 1), (3, 1, 2, 2)], "node long, num long, remote_node long, remote_num long")
    r = spark.createDataFrame(routes, "node long, network long, plen int, protocol string, next_hop long, out long")
    return forwarding.Network(forwarding.fib(forwarding.connected_routes(i).unionByName(r)), i, links, **more)


def ways(spark, n, packets, ttl=9):
    p = spark.createDataFrame([(k, node, None, 9, dst, 6, port) for k, (node, dst, port) in enumerate(packets)], "flow int, node long, num long, src long, dst long, protocol long, port long")
    return {(r["flow"], tuple(r["path"])): r["disposition"] for r in forwarding.trace(p, n, ttl).collect()}


def test_packets_end_as_they_should(spark):
    routes = [(1, 100, 30, "static", 10, None), (2, 100, 30, "static", 22, None), (1, 300, 30, "static", None, None), (1, 400, 30, "static", 10, None), (2, 400, 30, "static", 9, None), (1, 500, 30, "static", 10, None), (2, 500, 30, "static", None, 3), (1, 600, 30, "static", None, 1)]
    n = net(spark, routes, denied_in=(F.col("node") == 3) & (F.col("port") == 1), denied_out=(F.col("out") == 2) & (F.col("port") == 2), rewritten=[((F.col("node") == 2) & (F.col("port") == 3), F.lit(201).cast("long"))])
    out = ways(spark, n, [(1, 101, 0), (1, 102, 0), (1, 700, 0), (1, 300, 0), (1, 400, 0), (1, 101, 1), (1, 101, 2), (1, 101, 3), (1, 500, 0), (1, 600, 0), (1, None, 0)])
    assert out == {
        (0, (1, 2, 3)): "ACCEPTED", (1, (1, 2, 3)): "DELIVERED_TO_SUBNET", (2, (1,)): "NO_ROUTE", (3, (1,)): "NULL_ROUTED", (4, (1, 2, 1, 2)): "LOOP", (5, (1, 2, 3)): "DENIED_IN",
        (6, (1, 2)): "DENIED_OUT", (7, (1, 2)): "ACCEPTED", (8, (1, 2)): "EXITS_NETWORK", (9, (1,)): "NEIGHBOR_UNREACHABLE", (10, (1,)): "NO_ROUTE",
    }
    assert ways(spark, n, [(1, 101, 0)], ttl=1) == {(0, (1, 2)): "TTL_EXPIRED"} and ways(spark, n, []) == {}


def test_next_hops_resolve_through_others(spark):
    i = spark.createDataFrame([(1, 7, 9, 30)], "node long, num long, ip long, plen int")
    routes = [(1, 100, 30, "bgp", 200, None), (1, 200, 30, "static", 10, None), (1, 300, 30, "bgp", 400, None), (1, 400, 30, "bgp", 300, None), (1, 500, 30, "bgp", 999, None), (1, 600, 30, "bgp", 601, None), (1, 0, 0, "static", 10, None)]
    r = forwarding.connected_routes(i).unionByName(spark.createDataFrame(routes[:-1], "node long, network long, plen int, protocol string, next_hop long, out long"))
    want = [(1, 8, 30, "FORWARD", 7, None), (1, 100, 30, "FORWARD", 7, 10), (1, 200, 30, "FORWARD", 7, 10)]
    same(forwarding.fib(r), want)  # a circle, an unknown next hop and a route over itself are no entries
    r = r.unionByName(spark.createDataFrame(routes[-1:], r.schema))
    assert {x["network"] for x in forwarding.fib(r).collect()} == {0, 8, 100, 200, 500}
    assert {x["network"] for x in forwarding.fib(r, usable=F.col("plen") > 0).collect()} == {0, 8, 100, 200}


def test_answers_sessions_and_packet_policies(spark):
    p = spark.createDataFrame([(1, 10, 20, 1000, 80, 15)], "id int, src long, dst long, src_port int, dst_port int, was long")
    same(forwarding.return_flows(p.drop("was")), [(1, 20, 10, 80, 1000)])
    same(forwarding.return_flows(p, {"dst": "was"}), [(1, 15, 10, 80, 1000)])
    s = spark.createDataFrame([(5, 1, 10, 20, 6, 1000, 80), (4, 1, 10, 20, 6, 1000, 80)], "session int, node int, src long, dst long, protocol int, src_port int, dst_port int")
    back = spark.createDataFrame([(1, 20, 10, 6, 80, 1000), (2, 20, 10, 6, 80, 1000), (1, 10, 20, 6, 1000, 80)], "node int, src long, dst long, protocol int, src_port int, dst_port int")
    assert [r["session"] for r in forwarding.session_matches(back, s).orderBy("node", F.desc("src")).collect()] == [4, None, None]
    Do = forwarding.Do
    out = forwarding.packet_policy(p, [Do(F.col("dst") == 20, {"dst": F.lit(30).cast("long")}), Do(F.col("dst") == 20, action="DROP"), Do(F.col("dst") == 30, action="OUT", argument=F.lit(7)), Do(None, action="DROP")])
    assert out.select("dst", "action", "argument").first() == (30, "OUT", "7") and forwarding.packet_policy(p, []).first()["action"] == "LOOKUP"
    with pytest.raises(ValueError):
        forwarding.packet_policy(p, [Do(None, action="FLY")])


# Fixpoints and the control plane


def test_loops_and_paths(spark):
    hops = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 4, 5), (1, 5, 6), (1, 6, None), (2, 1, 2), (2, 9, 9)], "d int, src int, dst int")
    same(fixpoint.can_loop(hops.where("dst is not null"), ["d"]), [(1, 1), (1, 2), (1, 3), (2, 9)])
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "src long, dst long")
    paths = fixpoint.path_vector(spark.createDataFrame([(7, 1)], "prefix int, node long"), edges)
    assert {r["node"]: r["path"] for r in paths.collect()} == {1: [], 2: [1], 3: [1], 4: [2, 1]}
    assert fixpoint.can_loop(hops.limit(0), ["d"]).count() == 0
    t = spark.createDataFrame([(1, [1, 2, 3], "a"), (1, [1, 3], "b"), (1, [1, 2, 4], "c"), (2, [5], "d")], "k int, path array<int>, id string")
    same(traces.dag(t, ["k"], "path"), [(1, 1, 2, 1, 2), (1, 1, 3, 1, 1), (1, 2, 3, 2, 1), (1, 2, 4, 2, 1)])
    same(traces.pruned(t.select("k", "id"), ["k"], "id", 2), [(1, "a", 3), (1, "b", 3), (2, "d", 1)])


def test_areas_go_through_the_backbone(spark):
    edges = spark.createDataFrame([(1, 2, 1, 1), (2, 3, 1, 0), (3, 4, 1, 2), (1, 4, 1, 1), (4, 5, 1, 2)], "src long, dst long, weight long, area long")
    homes = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 0), (3, 2), (4, 2), (4, 1), (5, 2)], "node long, area long")
    out = {(r["source"], r["source_area"], r["node"], r["area"]): r["cost"] for r in control.area_costs(edges, homes, homes).collect()}
    assert out[1, 1, 4, 1] == 1 and out[1, 1, 4, 2] == 3 and out[1, 1, 5, 2] == 4  # 1-4 is in area 1: the way into area 2 is over the backbone
    ext = spark.createDataFrame([(5, 77, "E2", 1), (3, 77, "E1", 50), (5, 88, "E2", 1)], "node long, network long, kind string, metric long")
    inner = spark.createDataFrame([(5, 1, 1, 4), (3, 1, 1, 2), (5, 9, 2, 1)], "source long, node long, area long, cost long")
    same(control.external_costs(inner, ext, spark.createDataFrame([(2,)], "area long")), [(1, 77, "E1", 52), (1, 88, "E2", 1)])


def test_levels(spark):
    nodes = spark.createDataFrame([(1, 1, 1), (2, 1, 12), (3, 2, 12), (4, 2, 2)], "node long, area long, levels int")
    edges = spark.createDataFrame([(a, b, 1) for x, y in ((1, 2), (2, 3), (3, 4), (1, 4)) for a, b in ((x, y), (y, x))], "src long, dst long, weight long")
    same(control.level_costs(edges, nodes).where("source < 3"), [(1, 1, 1, 0), (1, 2, 1, 1), (2, 1, 1, 1), (2, 2, 1, 0), (2, 3, 2, 1), (2, 4, 2, 2)])


def test_propagation_rules(spark):
    ses = lambda *rows: spark.createDataFrame(list(rows), "src long, dst long, kind string, client boolean")
    origin = spark.createDataFrame([(9, 1)], "prefix long, node long")
    plain = ses((1, 2, "IBGP", False), (2, 3, "IBGP", False), (2, 4, "EBGP", False), (4, 5, "CONFED", False))
    same(control.bgp_propagation(origin, plain), [(9, 1, 0, 0), (9, 2, 2, 0), (9, 4, 0, 1), (9, 5, 0, 1)])  # 3 gets nothing: learned over IBGP
    reflected = ses((1, 2, "IBGP", True), (2, 3, "IBGP", False))
    same(control.bgp_propagation(origin, reflected), [(9, 1, 0, 0), (9, 2, 1, 0), (9, 3, 2, 0)])  # from a client to others
    paths = spark.createDataFrame([([1, 2, 1],), ([3, 1],), ([4],)], "path array<int>")
    assert control.loop_free(paths, "path", F.lit(1)).count() == 1 and control.loop_free(paths, "path", F.lit(1), 1).count() == 2
    assert control.loop_free(paths, "path", F.lit(9), 0, F.lit(4), remote_out=False).count() == 2


def test_multipath_and_local_origination(spark):
    r = spark.createDataFrame([(1, 5, [1, 2]), (1, 5, [1, 3]), (1, 5, [2, 3]), (1, 5, [1]), (1, 4, [1, 2]), (2, 1, [])], "k int, pref int, path array<int>")
    pick = lambda mode: got(control.multipath(r, ["k"], [F.desc("pref")], "path", mode).where("k = 1").select("path"))
    assert pick("EXACT_PATH") == [([1],)] and pick("FIRST_AS") == [([1],)]
    more = r.where("size(path) <> 1")
    pick = lambda mode: len(control.multipath(more, ["k"], [F.desc("pref")], "path", mode).where("k = 1").collect())
    assert [pick(m) for m in ("EXACT_PATH", "FIRST_AS", "PATH_LENGTH")] == [1, 2, 3]
    with pytest.raises(ValueError):
        control.multipath(r, ["k"], [], "path", "NONE")
    o = spark.createDataFrame([(1, "NETWORK", 9), (1, "REDISTRIBUTE", 1), (1, "NETWORK", 3)], "k int, origin_kind string, next_hop int")
    same(control.local_origination(o, ["k"]), [(1, "NETWORK", 3)])
    same(control.local_origination(o, ["k"], "NO_PREFERENCE", "HIGHEST_NEXT_HOP_IP"), [(1, "NETWORK", 9)])


def test_rib_delta_tracks_and_shares(spark):
    rib = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "net int, metric int, via string")
    more = spark.createDataFrame([(1, 3, "c"), (2, 5, "d"), (3, 1, "e"), (1, 5, "a")], rib.schema)
    same(control.merge_delta(rib, more, ["net"], [F.asc("metric")]), [(1, "ADD", 3, "c"), (1, "REPLACE", 5, "a"), (2, "ADD", 5, "d"), (3, "ADD", 1, "e")])
    c = spark.createDataFrame([("t", "VALUE", "x", False), ("t", "TRACK", "u", True), ("u", "VALUE", "gone", False), ("v", "VALUE", "x", True)], "track string, kind string, of string, negate boolean")
    v = spark.createDataFrame([("x", True), ("x", True)], "of string, up boolean")
    same(control.tracks(c, v), [("t", True), ("u", False), ("v", False)])
    with pytest.raises(ValueError, match="circle"):
        control.tracks(spark.createDataFrame([("a", "TRACK", "b", False), ("b", "TRACK", "a", False)], c.schema), v)
    assert [control.shard_count(n) for n in (0, 1, 256, 257, 10**6)] == [1, 1, 1, 2, 16]
    w = spark.createDataFrame([(k, k) for k in range(1, 9)], "node int, weight int")
    total = control.partitioned(w, "WEIGHTED", 2).join(w, "node").groupBy("part").agg(F.sum("weight"))
    same(total, [(0, 18), (1, 18)])
    assert control.partitioned(w.withColumn("hostname", F.concat(F.lit("n"), "node")), "NAME_ORDERED", 4).groupBy("part").count().where("count = 2").count() == 4
    with pytest.raises(ValueError):
        control.partitioned(w, "MAGIC", 2)


# Symbolic sets


def test_sets_of_headers(spark):
    rows = [(1, 2, 0, 9), (2, 3, 5, 20), (1, 3, 8, 8), (3, 4, 0, 100), (2, 5, None, 3)]
    c = spark.createDataFrame(rows, "src long, dst long, x_lo long, x_hi long")
    atoms, edges = symbolic.atomised(c, ["x"], ["src", "dst"])
    start = atoms.select(F.lit(1).cast("long").alias("node"), "atom")
    values = lambda df: {x for r in df.join(atoms, "atom").collect() for x in range(r["x_lo"], r["x_hi"] + 1)}
    at = symbolic.forward(start, edges)
    assert values(at.where("node = 3")) == set(range(5, 10)) == values(at.where("node = 4")) and at.where("node = 5").count() == 0
    goal = atoms.select(F.lit(4).cast("long").alias("node"), "atom")
    assert values(symbolic.backward(goal, edges).where("node = 2")) == set(range(5, 21)) and values(symbolic.between(start, goal, edges).where("node = 2")) == set(range(5, 10))
    same(symbolic.witnesses(at.where("node > 2"), atoms, ["node"], ["x"]).select("node", "x"), [(3, 5), (4, 5)])
    low, high = atoms.where("x_lo = 0").first()["atom"], atoms.where("x_lo = 10").first()["atom"]
    maps = spark.createDataFrame([(2, low, high)], "node long, atom long, to_atom long")
    assert values(symbolic.rewriting(start, edges, maps).where("node = 3")) == set(range(5, 21))  # 0 to 4 become 10 to 20 at node 2
    same(symbolic.inverse(maps), [(2, high, low)])
    fewer = symbolic.forward(start, edges.where("src <> 1 or dst <> 2"))
    assert values(symbolic.difference(at, fewer, ["node"]).where("node = 3 and change = 'decreased'")) == {5, 6, 7, 9}


# Specifiers, answers, IPv6


def test_specifiers(spark):
    p = spark.createDataFrame([("a1", "e0", "red", "in", "PHYSICAL", 167772161, "X", True, "INTERFACE"), ("a1", "e1", "blue", None, "LOOPBACK", 167772417, "X", True, "ENTER"), ("b1", "e0", "blue", "out", None, None, None, False, "INTERFACE")], "hostname string, interface string, vrf string, zone string, type string, ip long, role string, active boolean, kind string")
    pick = lambda kind, text: [(r["hostname"], r["interface"]) for r in specifiers.resolve(kind, p, text).orderBy("hostname", "interface").collect()]
    a0, a1, b0 = ("a1", "e0"), ("a1", "e1"), ("b1", "e0")
    assert pick("interface", "E0") == [a0, b0] and pick("interface", "a1[/e./]") == [a0, a1] and pick("interface", r"vrf(blue) \ type(loopback)") == []
    assert pick("interface", "connectedTo(10.0.0.0/24, 10.0.1.1)") == [a0, a1] and pick("interface", "!e0") == [a1] and pick("interface", "(e0 & vrf(red)), zone(out)") == [a0, b0]
    assert pick("location", "a1") == [a0] and pick("location", "enter(a1[e1]), b1[e0]") == [a1, b0] and pick("location", "role(x)") == [a0]
    assert pick("node", r"/^a/ \ role(y)") == [a0, a1] and pick("node", r"/^b/ \ role(y)") == []  # a role that isn't known is not known to be another
    for kind, text in (("interface", "a1["), ("interface", "nope(x)"), ("ip", "1.2.3"), ("ip", "1.2.3.4/40"), ("ip", "/x/"), ("protocol", "blub"), ("application", "tcp/x"), ("node", "a,,b"), ("node", "(a"), ("node", "a b"), ("blub", "x")):
        with pytest.raises(specifiers.SpecifierError):
            specifiers.resolve(kind, p, text)
    assert specifiers.validated("interface", p, "e9") == ("NO_MATCH", "") and specifiers.validated("interface", p, "e0")[0] == "VALID" and specifiers.validated("node", p, "(")[0] == "INVALID"
    assert specifiers.values("igp, !rip, ebgp", ["rip", "ebgp", "ospf-intra", "static"], specifiers.PROTOCOL_GROUPS) == ["ebgp", "ospf-intra"] and specifiers.values("!/^o/", ["a", "ob"]) == ["a"]
    names = spark.createDataFrame([("node", "ab"), ("node", "ABC"), ("node", "xab"), ("vrf", "ab"), ("node", None)], "kind string, text string")
    assert [r["text"] for r in specifiers.suggestions(names, "node", "AB").collect()] == ["ab", "ABC", "xab"]


def test_covers_and_row_ids(spark):
    df = spark.createDataFrame([(1, {"k": "v", "n": "x"}, [(1, "p"), (2, "q")], True), (2, None, [], None)], "id int, m map<string,string>, l array<struct<a:int,b:string>>, f boolean")
    covers = lambda spec: [r["id"] for r in answers.covered(df, [spec]).collect()]
    assert covers({"m": {"k": "v"}}) == [1] and covers({"m": {"k": "w"}}) == [] and covers({"m": {"z": "v"}}) == [] and covers({"f": True}) == [1] and covers({"f": None}) == [2]
    assert covers({"l": [{"b": "q"}, {"a": 1}]}) == [1] and covers({"l": [{"a": 1, "b": "q"}]}) == [] and covers({"l": []}) == [1, 2] and covers({"nope": 1}) == [] and covers({"id": {"x": 1}}) == [] and covers({}) == [1, 2]
    assert answers.uncovered(df, [{"id": 1}]).count() == 1 and answers.uncovered(df, []).count() == 2
    many = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert answers.row_ids(many, ["x"]).where("id <> x + 1").count() == 0 and answers.row_ids(many.limit(0), ["x"]).count() == 0
    assert answers.status_of(df, F.col("f")).first() == ("FAILURE", 2) and answers.status_of(df.limit(0)).first() == ("SUCCESS", 0)


def test_answers_with_parameters(spark, data):
    ask = lambda name="edges_bgp", **p: registry.answer(spark, data, name, **p)
    all_ = ask().count()
    assert 0 < ask(nodes="n1, n2").count() < all_ and ask(exclusions=[{"kind": "IBGP"}]).where("kind = 'IBGP'").count() == 0
    assert ask(columns=["kind"], unique=True, sort=[("kind", False)], rows=1).columns == ["kind"] and ask(filters=[("local_as", ">=", 65010)]).where("local_as < 65010").count() == 0
    for wrong in ({"blub": 1}, {"rows": "x"}, {"columns": ["nope"]}, {"filters": [("nope", "==", 1)]}):
        with pytest.raises(ValueError):
            ask(**wrong)
    with pytest.raises(ValueError):
        ask("nope")
    with pytest.raises(ValueError):
        ask("warning_summary", nodes="n1")
    with pytest.raises(ValueError):
        registry.Variable("x", str, optional=False).check(None)
    with pytest.raises(ValueError):
        registry.Variable("x", str, allowed=("a",)).check("b")
    assert registry.answer_diff(spark, data, data, "node_properties", ["hostname"]).count() == 0


def test_ipv6(spark):
    import ipaddress

    texts = ["::", "::1", "fe80::1:2", "2001:DB8:0:0:8:800:200C:417A", "1:2:3:4:5:6:7:8", "1::", "1:2:3:4:5:6:7::"]
    df = spark.createDataFrame([(t,) for t in texts + ["", ":", ":::", "1::2::3", "12345::", "g::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", None]], "t string")
    out = {r["t"]: r["d"] for r in df.select("t", ip6.parse(F.col("t")).alias("d")).collect()}
    assert all(out[t] == f"{int(ipaddress.ip_address(t)):032x}" for t in texts) and all(d is None for t, d in out.items() if t not in texts)
    sizes = spark.createDataFrame([(f"{int(ipaddress.ip_address(t)):032x}", p) for t in texts for p in (0, 1, 7, 28, 64, 127, 128)], "d string, p int")
    for d, p, lo, hi in sizes.select("d", "p", ip6.network(F.col("d"), F.col("p")), ip6.last(F.col("d"), F.col("p"))).collect():
        n = ipaddress.IPv6Network((int(d, 16), p), strict=False)
        assert (int(lo, 16), int(hi, 16)) == (int(n.network_address), int(n.broadcast_address))


def test_peer_groups(spark):
    peers = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "d", "y"), (3, "e", "x"), (3, "f", "y")], "group int, peer string, policy string")
    policies = {"x": [Statement(F.col("n") > 1, accept=False), Statement(None, accept=True)], "y": [Statement(None, {"n": F.col("n") + 1}, accept=True)]}
    out = peer_groups(peers, policies, spark.createDataFrame([(1,), (2,)], "n int").withColumn("k", F.col("n")), [], ["k"])
    same(out, [(g, "y", "x", 2, "PERMIT", "DENY") for g in (1, 3)])


# Broadcasts


def test_large_tables_of_small_files_are_not_broadcast(spark):
    big = lineage.cut(spark.range(lineage.ROWS + 1).select(F.lit(1).cast("long").alias("k"), F.lit(7).alias("v")))
    small = lineage.cut(spark.range(3).select(F.col("id").alias("k")))
    plan = lambda a, b: a.join(b, "k")._jdf.queryExecution().executedPlan().toString()
    other = spark.range(10_000_000).withColumnRenamed("id", "k")
    assert "Broadcast" not in plan(other, big) and "Broadcast" not in plan(other, big.groupBy("k").agg(F.min("v")))
    assert "Broadcast" in plan(other, small) and "Broadcast" in plan(big, F.broadcast(small))
    assert lineage.counted(small.where("k < 0"))[1] == 0


FILTERS = ["symbolic_validation", "permit_and_deny", "filter_line_reachability_headers", "filter_blockers", "search_filters_headers"]


@pytest.mark.parametrize("name", FILTERS)
def test_filters_have_no_broadcast_by_the_size_of_files(spark, data, name, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS", 10, raising=False)
    monkeypatch.setattr(lineage, "BYTES", 0, raising=False)
    assert "BroadcastHashJoin" not in registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()


# Searches source by source


@pytest.fixture
def tangle(spark):
    """A random graph with dead ends, edges of weight 0, sources that no edge has, null nodes, and sources with several starts."""
    dice = random.Random(5)
    edges = [(dice.randrange(40), dice.randrange(40), dice.randrange(4)) for _ in range(70)] + [(None, 3, 1), (4, None, 1)]
    start = [(s, s) for s in range(0, 45, 2)] + [(1, 7), (1, 9), (1, 7), (3, 99), (5, None)]
    return spark.createDataFrame(start, "source long, node long"), spark.createDataFrame(edges, "src long, dst long, weight long")


def both_ways(monkeypatch, ask):
    """What ask says source by source, which has to be what it says by rounds."""
    made = []
    real = search.by_source
    monkeypatch.setattr(search, "by_source", lambda *a, **k: made.append(1) or real(*a, **k))
    one = got(ask())
    assert made
    monkeypatch.setattr(search, "EDGES", 0)
    assert got(ask()) == one and len(made) == 1
    return one


def test_reach_goes_source_by_source(tangle, monkeypatch):
    start, edges = tangle
    assert both_ways(monkeypatch, lambda: fixpoint.reach(start, edges, keep=["source"]))


@pytest.mark.parametrize("most", [None, 3])
def test_least_cost_goes_source_by_source(tangle, monkeypatch, most):
    start, edges = tangle
    assert both_ways(monkeypatch, lambda: fixpoint.least_cost(start, edges, most=most))


def test_path_vector_goes_source_by_source(tangle, monkeypatch):
    start, edges = tangle
    origins = start.withColumnRenamed("source", "prefix").where("node is not null")
    monkeypatch.setattr(search, "STATES", 5)
    assert both_ways(monkeypatch, lambda: fixpoint.path_vector(origins, edges).select("prefix", "node", F.col("path").cast("string")))


def test_side_by_side_goes_source_by_source(tangle, monkeypatch):
    start, edges = tangle
    assert both_ways(monkeypatch, lambda: fixpoint.side_by_side(start, edges, edges.where("dst % 5 <> 1"), ["source"]))


def test_rounds_and_odd_weights_are_left_to_rounds(spark, monkeypatch):
    monkeypatch.setattr(search, "by_source", None)
    start = spark.createDataFrame([(1, 1)], "source long, node long")
    edges = spark.createDataFrame([(1, 2, -1), (2, 3, 5)], "src long, dst long, weight long")
    same(fixpoint.least_cost(start, edges), [(1, 1, 0), (1, 2, -1), (1, 3, 4)])
    same(fixpoint.least_cost(start, edges.withColumn("weight", F.lit(0.5))), [(1, 1, 0), (1, 2, 0.5), (1, 3, 1.0)])
    with pytest.raises(RuntimeError):
        fixpoint.reach(start, edges, keep=["source"], rounds=1)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_walks_to_goals_against_sql_of_random_graphs(spark, monkeypatch, bound):
    """Kinds, goals without edges, nodes that loop on themselves, more goals than a word has bits; source by source and in rounds."""
    rnd = random.Random(5)
    edges = [(rnd.randrange(40), rnd.randrange(40), rnd.choice([None, None, 0, 1])) for _ in range(45)] + [(3, 3, None), (None, 4, None), (4, None, 1)]
    goals = [(k, k % 3) for k in range(100)] + [(5, 2), (None, 0)]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (src BIGINT, dst BIGINT, kind BIGINT)").executemany("INSERT INTO e VALUES (?, ?, ?)", edges)
    con.execute("CREATE TABLE g (goal BIGINT, kind BIGINT)").executemany("INSERT INTO g VALUES (?, ?)", goals)
    walk = """WITH RECURSIVE hop AS (SELECT DISTINCT goal, src, dst FROM g JOIN e ON e.src IS NOT NULL AND dst IS NOT NULL AND goal <> src AND (e.kind IS NULL OR e.kind = g.kind)), r AS (SELECT goal, src AS a, dst AS b FROM hop UNION SELECT r.goal, a, h.dst FROM r JOIN hop h ON h.goal = r.goal AND h.src = r.b),
     looping AS (SELECT DISTINCT r.goal, r.a AS node FROM r JOIN r c ON c.goal = r.goal AND c.a = r.b AND c.b = r.b), ends AS (SELECT goal, a AS node, bool_or(b = goal) AS ok, bool_or(b <> goal AND NOT EXISTS (SELECT 1 FROM hop h WHERE h.goal = r.goal AND h.src = r.b)) AS bad FROM r GROUP BY ALL) """
    monkeypatch.setattr(fixpoint.search, "EDGES", bound)
    e, g = spark.createDataFrame(edges, "src long, dst long, kind long"), spark.createDataFrame(goals, "goal long, kind long")
    for what, sql in (("looping", "SELECT goal, node FROM looping"), ("divided", "SELECT goal, node FROM ends LEFT JOIN looping l USING (goal, node) WHERE ok AND (bad OR l.node IS NOT NULL)")):
        want = sorted(con.execute(walk + sql).fetchall())
        assert want and sorted(map(tuple, fixpoint.walks(g, e, what).collect())) == want


@pytest.mark.parametrize("name", ["detect_loops", "multipath_consistency"])
def test_walks_write_no_table_for_each_round_or_destination(spark, data, monkeypatch, name):
    written = []
    for module in (fixpoint, lineage):
        monkeypatch.setattr(module, "cut", lambda df, *a, f=lineage.cut: written.append(0) or f(df, *a))
    registry.queries()[name](spark, data).collect()
    assert len(written) <= 1


def test_forwarding_looks_up_what_is_asked(spark, monkeypatch):
    """Routes are made for the addresses that packets have at their nodes, not for all nodes and destinations, and next hops are resolved once for each."""
    from fabriq.plans import forward
    from fabriq.sources.project import Facts

    f = Facts(spark, "/root/testdata/sf0.001")
    every, asked = got(f.static), spark.createDataFrame([(1, 167772160 + 256 * 3 + 7), (1, 167772160 + 256 * 3 + 9), (2, 5), (2, None), (4, 167772160)], "node long, ip long")
    wanted = {(1, 167772160 + 256 * 3), (4, 167772160)}
    assert got(f.static_routes(asked)) == [r for r in every if r[:2] in wanted] and len(set(every)) == len(every)
    counts, real = [], forwarding.cut
    monkeypatch.setattr(forwarding, "cut", lambda df, *a: counts.append((out := real(df, *a))._rows) or out)
    forward._fib(f)
    assert max(counts) <= 2 * f.node.count()


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_ways_to_goals_against_sql_of_random_graphs(spark, monkeypatch, bound):
    """Kinds, goals and starts without edges, null and more than once, more goals than are gone through at once; all ways and the first three."""
    rnd = random.Random(7)
    edges = [(rnd.randrange(30), rnd.randrange(30), rnd.choice([None, None, 0, 1])) for _ in range(50)] + [(3, 3, None), (None, 4, None), (4, None, 1)]
    goals = [(k, k % 3) for k in range(70)] + [(5, 2), (5, 2), (None, 0)]
    starts = [(k,) for k in range(32)] + [(7,), (8,), (8,), (None,)]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (src BIGINT, dst BIGINT, kind BIGINT)").executemany("INSERT INTO e VALUES (?, ?, ?)", edges)
    con.execute("CREATE TABLE g (goal BIGINT, kind BIGINT)").executemany("INSERT INTO g VALUES (?, ?)", goals)
    con.execute("CREATE TABLE s (node BIGINT)").executemany("INSERT INTO s VALUES (?)", starts)
    sql = """WITH RECURSIVE hop AS (SELECT DISTINCT goal, src, dst FROM g JOIN e ON src IS NOT NULL AND dst IS NOT NULL AND goal <> src AND (e.kind IS NULL OR e.kind = g.kind)),
     t AS (SELECT goal, s.node AS start, s.node, [s.node] AS path, false AS looped FROM g, s UNION ALL SELECT t.goal, t.start, h.dst, list_append(t.path, h.dst), list_contains(t.path, h.dst) FROM t JOIN hop h ON h.goal = t.goal AND h.src = t.node WHERE NOT looped AND len(path) <= 4),
     u AS (SELECT *, EXISTS (SELECT 1 FROM hop h WHERE h.goal = t.goal AND h.src = t.node) AS goes_on FROM t),
     v AS (SELECT goal, start, array_to_string(path, '>') AS path, CASE WHEN looped THEN 'LOOP' WHEN node = goal THEN 'ACCEPTED' WHEN goes_on THEN 'TTL_EXPIRED' ELSE 'NO_ROUTE' END AS disposition FROM u WHERE looped OR NOT goes_on OR len(path) = 5)
     SELECT goal, start, path, disposition, traces FROM (SELECT *, row_number() OVER (PARTITION BY goal, start ORDER BY path) AS k, count(*) OVER (PARTITION BY goal, start) AS traces FROM v) WHERE k <= """
    monkeypatch.setattr(fixpoint.search, "EDGES", bound)
    e, g, s = spark.createDataFrame(edges, "src long, dst long, kind long"), spark.createDataFrame(goals, "goal long, kind long"), spark.createDataFrame(starts, "node long")
    for first in (None, 3):
        want = con.execute(sql + str(first or 1_000_000)).fetchall()
        assert {r[3] for r in want} == set(fixpoint.search.WAYS) and max(r[4] for r in want) > 3
        same = lambda rows: sorted(tuple(map(str, r)) for r in rows)
        assert same(fixpoint.ways(g, s, e, 4, first).collect()) == same(want)


@pytest.mark.parametrize("name", ["traceroute", "traceroute_pruned"])
def test_traces_write_no_table_for_each_hop_and_sort_nothing(spark, data, monkeypatch, name):
    written = []
    for module in (fixpoint, lineage):
        monkeypatch.setattr(module, "cut", lambda df, *a, f=lineage.cut: written.append((out := f(df, *a))._rows) or out)
    nodes = spark.read.parquet(f"{data}/supplier.parquet").count()
    plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and max(written) <= 2 * nodes


@pytest.mark.parametrize("weights", [[1], [0, 1, 7], [3, search.LIGHT + 1]])
def test_sources_are_searched_together(weights):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(len(weights))
    graphs = [(400, np.arange(399), np.arange(1, 400))] + [(n, *rng.integers(0, n, (2, m))) for n, m in rng.integers(1, 80, (30, 2))]  # a chain of more levels than a byte has
    for n, src, dst in graphs:
        g = search.Graph(pa.array(np.arange(n)), pa.table({"src": src, "dst": dst, "weight": rng.choice(weights, len(src))}))
        at, start = np.append(np.arange(64), 0), rng.integers(0, n, 65)  # source 0 has two starts
        for most in (None, 5):
            one, all_ = g.costs(at, start, 64, n, most).reshape(64, n).T, g.together(at, start, 64, n, most)
            assert ((all_ == np.iinfo(all_.dtype).max) == (one == search.FAR)).all()
            assert (np.where(one == search.FAR, 0, one) == np.where(one == search.FAR, 0, all_)).all()


def test_answers_of_many_nodes_are_written_small(spark, tmp_path):
    import os

    n = 6000
    edges = spark.range(n).selectExpr("id as src", f"explode(array((id + 1) % {n}, (3 * id + 1) % {n})) as dst", "1 + id % 7 as weight").where("src <> dst")
    costs = fixpoint.least_cost(spark.range(256).selectExpr("id as source", "id as node"), edges)
    loops = fixpoint.walks(spark.range(256).selectExpr("id as goal", "0L as kind"), edges.selectExpr("src", "dst", "0L as kind"), "looping")
    for k, (df, most) in enumerate(((costs, 2), (loops, 1))):  # bytes a row
        df.write.parquet(f"{tmp_path}/{k}")
        assert sum(os.path.getsize(f) for f in tmp_path.glob(f"{k}/*.parquet")) < most * spark.read.parquet(f"{tmp_path}/{k}").count()


def test_filters_of_few_lines_are_worked_on_in_tasks(spark, monkeypatch):
    """As by rows of cells, which only filters of more than LINES lines take; ends may be null or the wrong way round."""
    rng = random.Random(5)
    fields, rows = ["a", "b"], []
    for acl, many in [(k, rng.randrange(1, 9)) for k in range(25)] + [(25, 70), (None, 3)]:
        for line in range(many):
            box = [x for _ in fields for lo in [rng.randrange(12)] for x in (lo, lo + rng.randrange(-1, 7))]
            rows.append((acl, 3 * line, rng.choice(["PERMIT", "DENY"]), *(None if rng.random() < 0.02 else x for x in box)))
    made = spark.createDataFrame(rows, "acl long, line long, action string, a_lo long, a_hi long, b_lo long, b_hi long").cache()
    one, two = made.where("line % 2 = 0 or acl % 3 = 0"), made.where("line % 2 = 1")
    said = lambda df: sorted(map(tuple, df.collect()), key=str)
    both = lambda: (said(headers.blockers(made, ["acl"], fields)), said(headers.compared(one, two, ["acl"], fields)))
    got = both()
    monkeypatch.setattr(headers, "_by_filter", lambda lines, *rest: (None, lines))
    assert got == both() and len(got[0]) > 20 and len(got[1]) > 50 and any(r[0] == 25 for r in got[0])
    monkeypatch.undo()
    monkeypatch.setattr(headers, "covers", None)  # not asked for small ones
    small = made.where("acl < 25")
    assert said(headers.blockers(small, ["acl"], fields)) == [r for r in got[0] if r[0] < 25]
    assert said(headers.compared(small.limit(0), small, ["acl"], fields))


def test_path_texts_are_made_in_tasks(spark, monkeypatch):
    """As by path_vector()'s lists, which large graphs and nodes without edges of one type take."""
    edges = spark.range(40).selectExpr("id as src", "explode(array((id + 1) % 40, (3 * id + 1) % 40)) as dst").where("src <> dst and src <> 7")
    origins = spark.createDataFrame([(k, k) for k in (0, 5, 7, 99)] + [(3, None)], "prefix long, node long")
    said = lambda: sorted(map(tuple, fixpoint.path_texts(origins, edges).collect()), key=str)
    lists = fixpoint.path_vector(origins, edges).collect()
    want = sorted([(r.prefix, r.node, len(r.path), ",".join(map(str, r.path))) for r in lists], key=str)
    with monkeypatch.context() as m:
        m.setattr(fixpoint, "path_vector", None)  # no lists in Spark's rows
        assert said() == want and len(want) > 80


def test_best_states_are_chosen_where_they_are_found(spark, monkeypatch):
    """As by grouping all states, which only large graphs do; starts without edges, null ones, negative nodes and several starts; nothing is exchanged after the search."""
    rnd = random.Random(9)
    edges = spark.createDataFrame([(rnd.randrange(-20, 60), rnd.randrange(-20, 60), rnd.randrange(3)) for _ in range(160)] + [(7, 301, 1), (None, 3, 0)], "src long, dst long, weight long")
    start = spark.createDataFrame([(k % 70, 3 * rnd.randrange(-6, 20)) for k in range(90)] + [(1, 300), (1, 7), (2, 900), (3, None)], "source long, node long")
    said = lambda: sorted(map(tuple, fixpoint.least_state(start, edges, 3).collect()), key=str)
    plan = fixpoint.least_state(start, edges, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("MapInArrow")]
    monkeypatch.setattr(search, "STATES", 50)
    few = said()
    monkeypatch.setattr(search, "EDGES", 0)
    assert few == said() and (1, 100, 0, 0) in few and (2, 300, 0, 0) in few and (3, None, None, 0) in few and len(few) > 500


@pytest.mark.parametrize("name", ["traceroute_hops", "bidirectional_traceroute", "subnet_multipath_consistency"])
def test_packets_go_on_to_their_ends(spark, data, name):
    """No time to live ends them; at most six nodes were passed before."""
    rows = registry.queries()[name](spark, data).collect()
    assert not any("TTL_EXPIRED" in str(r) for r in rows)
    if name == "traceroute_hops":
        assert max(collections.Counter(r["flow"] for r in rows if r["to_node"] is not None).values()) > 6
    else:
        assert any("LOOP" in r["ends"] for r in rows)


def test_fates_and_hops_are_those_of_all_ways(spark):
    """As by listing the ways, over a chain of twenty nodes with branches, loops, filters and rewriting."""
    n = 20
    i = spark.createDataFrame([(k, 2 * k, 8 * k + 1, 30) for k in range(n)] + [((k + 1) % n, 2 * k + 1, 8 * k + 2, 30) for k in range(n)] + [(k, 100 + k, 1001 + 4 * k, 30) for k in range(n)], "node long, num long, ip long, plen int")
    links = spark.createDataFrame([r for k in range(n) for r in ((k, 2 * k, (k + 1) % n, 2 * k + 1), ((k + 1) % n, 2 * k + 1, k, 2 * k))], "node long, num long, remote_node long, remote_num long")
    on = lambda k, net: (k, net, 30, "static", 8 * k + 2, None)
    back = lambda k, net: (k, net, 30, "static", 8 * (k - 1) + 1, None)
    routes = [on(k, 1076) for k in range(19)] + [on(k, 1040) for k in range(10)] + [back(4, 1040), (15, 1076, 30, "static", None, 115)] + [on(k, 1060) for k in range(15)] + [on(k, 2000) for k in range(n)] + [on(12, 3000), (13, 3000, 30, "static", None, None)]
    routes = spark.createDataFrame(routes, "node long, network long, plen int, protocol string, next_hop long, out long")
    fib = forwarding.fib(forwarding.connected_routes(i).unionByName(routes))
    net = forwarding.Network(fib, i, links, denied_in=(F.col("num") == 15) & (F.col("port") == 1), denied_out=(F.col("out") == 4) & (F.col("port") == 2), rewritten=[((F.col("node") == 3) & (F.col("dst") == 1061), F.lit(1041).cast("long"))])
    asked = [(k, goal, port) for k in (0, 3, 5, 12, 14) for goal in (1077, 1041, 1042, 1061, 2001, 3001, 9999) for port in (0, 1, 2)]
    packets = spark.createDataFrame([(f, k, None, 9, goal, 6, port) for f, (k, goal, port) in enumerate(asked)], "flow long, node long, num long, src long, dst long, protocol long, port long")
    ways = {}
    for r in forwarding.trace(packets, net, 60).collect():
        ways.setdefault(r["flow"], []).append((r["disposition"], r["path"]))
    assert {d for w in ways.values() for d, _ in w} >= {"ACCEPTED", "LOOP", "NO_ROUTE", "NULL_ROUTED", "DENIED_IN", "DENIED_OUT", "DELIVERED_TO_SUBNET"} and max(len(p) for w in ways.values() for _, p in w) > 15
    probes = packets.select("flow", "node", F.col("dst").alias("goal"), F.col("port").alias("header"))
    headers_ = [{"port": k} for k in range(3)]
    fates = {(r["node"], r["goal"], r["header"]): (r["ends"], sorted(r["taken"])) for r in forwarding.fates(probes, net, headers_).collect()}
    hops = {}
    for r in forwarding.hops(probes, net, headers_).collect():
        hops.setdefault(r["flow"], []).append(r)
    for f, one in enumerate(asked):
        w = ways[f]
        assert fates[one] == (",".join(sorted({d for d, _ in w})), sorted({p[-1] for d, p in w if d == "ACCEPTED"}))
        assert {r["disposition"] for r in hops[f]} - {None} == {d for d, _ in w} - {"LOOP"}
        assert {(r["node"], r["to_node"]) for r in hops[f] if r["to_node"] is not None} == {e for _, p in w for e in zip(p, p[1:])} and len(set(hops[f])) == len(hops[f])


@pytest.mark.parametrize("first", [None, 3])
def test_answers_of_ways_are_written_small(spark, tmp_path, first):
    """Way by way, each for many goals."""
    import os

    n = 3000
    edges = spark.range(n).selectExpr("id as src", f"explode(array((id + 1) % {n}, (3 * id + 1) % {n})) as dst", "cast(null as long) as kind").where("src <> dst")
    goals, starts = spark.range(500).selectExpr("id as goal", "0L as kind"), spark.range(n).selectExpr("id as node")
    fixpoint.ways(goals, starts, edges, 4, first).write.parquet(f"{tmp_path}/ways")
    rows = spark.read.parquet(f"{tmp_path}/ways").count()
    size = sum(os.path.getsize(f) for f in tmp_path.glob("ways/*.parquet")) / rows
    assert rows > 500_000 and size < 0.9, size
